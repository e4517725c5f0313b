from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import lines, sharding
from tests.llm import brute


def test_later_windows_go(odd_docs, odd_rows):
    expected = brute.deduplicated_lines([r for r in odd_rows if r[0] is not None])
    rows = lines.dedup_lines(odd_docs.where("doc_id IS NOT NULL").join(
        odd_docs.sparkSession.createDataFrame([(14,)], "doc_id long"), "doc_id", "left_anti")).collect()
    single = {r.doc_id: r.text for r in rows}
    assert single == {i: t for (i, _), t in expected.items() if i != 14}
    assert single[15] == "line" and single[16] == "\n\n\n\n" and single[4] is None and single[5] == ""


def test_counts_and_passages_across_documents(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(6))
    rows = [(3, f"a\n{passage}\nb"), (1, f"{passage}\nend"), (2, "c\nd"), (4, "line 0 of the passage\nline 1 of the passage\nother")]
    found = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].text == rows[1][1] and found[1].n_removed == 0
    assert found[3].text == "a\nb" and (found[3].n_lines, found[3].n_removed) == (8, 6)
    assert found[4].n_removed == 0 and found[2].n_lines == 2


def test_every_row_and_column_stays(clashing, no_docs):
    found = lines.dedup_lines(clashing)
    assert found.count() == clashing.count()
    assert set(clashing.columns) <= set(found.columns)
    assert found.where("key_hash <> 'mine' OR lines <> 'mine'").count() == 0
    assert lines.dedup_lines(no_docs).count() == 0


def test_shards_are_exact_and_slots_gapless(clashing):
    found = sharding.uniform_shards(clashing, 7, cells=13)
    rows = found.collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == clashing.count() and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.uniform_shards(clashing.repartition(5), 7, cells=13).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.lang, r.shard, r.slot)
    count = lambda rows: collections.Counter((r.doc_id, r.text, r.lang, r.shard, r.slot) for r in rows)
    assert count(rows) == count(again) and sorted(map(key, rows)) == sorted(map(key, again))


def test_few_and_no_rows(no_docs, spark):
    assert sharding.uniform_shards(no_docs, 40).count() == 0
    few = sharding.uniform_shards(spark.range(3), 40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_matrix_keeps_both_margins_and_is_spread_evenly():
    sizes = [1000, 0, 333, 5000, 1]
    m = sharding.matrix(sizes, 9, seed=3)
    assert m.sum(axis=1).tolist() == sizes and set(m.sum(axis=0).tolist()) <= {703, 704}
    mean = np.mean([sharding.matrix([20, 30], 4, seed=s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 5, atol=0.4)


def test_a_uniform_shuffle_mixes_neighbours(spark):
    found = sharding.uniform_shards(spark.range(4000), 4).where("id < 1000").groupBy("shard").count()
    assert found.agg(F.min("count")).first()[0] > 180

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import arrays, bloom, jaccard
from tests.llm import brute


def found(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("n", "above", "below"), [(4, 85, 100), (5, 4, 5)])
def test_components_match_brute_force(odd_docs, odd_rows, n, above, below):
    expected = brute.jaccard_components(odd_rows, n, above, below)
    # Rows of a null id in a group with ids get the group's smallest id, alike in both.
    assert found(jaccard.jaccard_components(odd_docs, n, above, below)) == expected


def test_large_group_of_near_copies_in_small_chunks(spark, monkeypatch):
    """Chunks of a few rows: links across chunks are found as well."""
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 7)
    monkeypatch.setattr(jaccard, "CENTRES", 2)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.jaccard_components(docs, 4, 85, 100)) == brute.jaccard_components(rows, 4, 85, 100)


def test_sets_are_shuffled_by_node_once_and_by_unit_once(spark, monkeypatch):
    plans, real = {}, jaccard.written

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(jaccard, "written", recorded)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = random.Random(4)
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows = [(i % 25, " ".join([*words[:-1 - i % 3], *(f"n{i}" for _ in range(i % 3))])) for i in range(60)]
        rows += [(None, rows[1][1]), (None, rows[1][1]), (3, rows[3][1]), (70, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(jaccard.jaccard_components(docs, 4, 85, 100)) == brute.jaccard_components(rows, 4, 85, 100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of the sets and one of the units, then nothing but the one by unit and that of the links.
    assert plans["sets"].count("Exchange hashpartitioning(") - plans["sets"].count("ReusedExchange") <= 3
    assert "Exchange hashpartitioning(rep" not in plans["sets"] and ", rep#" not in plans["sets"]
    assert "Join" not in plans["links"] and plans["links"].count("Exchange hashpartitioning(") == 2
    assert plans["late-links"].count("MapInArrow") == 2


def test_only_sets_whose_sketch_is_near_another_go_to_their_units(spark, monkeypatch):
    """Texts with a passage in common share blocks; their sketches tell that they are not similar."""
    tables, real = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(120)]
    own = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(60)]
    rows = [(i, " ".join(passage + words)) for i, words in enumerate(own)]
    rows += [(100 + i, " ".join([*passage, *own[i][:-1], "other"])) for i in range(5)] + [(None, rows[9][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.jaccard_components(docs, 5, 4, 5)) == brute.jaccard_components(rows, 5, 4, 5)
    assert tables["placed"].select("node").distinct().count() > 30
    assert tables["near"].select("node").distinct().count() == tables["sets"].count() == 12


def test_chains_of_shared_blocks_are_no_group(spark, monkeypatch):
    """Texts that share blocks with their neighbours only, and are not similar: no group holds the whole chain."""
    tables, real = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    rng = random.Random(14)
    links = [[f"p{i}w{rng.randrange(10**6)}" for _ in range(90)] for i in range(41)]
    rows = [(i, " ".join(links[i] + links[i + 1])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.jaccard_components(docs, 5, 4, 5)) == brute.jaccard_components(rows, 5, 4, 5)
    groups = tables["placed"].groupBy("wide", "band").count().collect()
    assert len(groups) > 3 and max(r["count"] for r in groups) <= 3


def test_sketches_fold_to_the_length_of_shorter_ones():
    rng = np.random.default_rng(2)
    sizes = np.array([900, 0, 40, 1, 300])
    hashes = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    words, begin = jaccard.whole_sketches(np.repeat(np.arange(5), sizes), hashes, sizes)
    assert np.diff(begin).tolist() == [32, 0, 2, 1, 16]
    rows = [words[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    for length, chosen in ((16, [0, 4]), (2, [0, 2, 4]), (1, [0, 2, 3, 4])):
        folded = jaccard._folded([rows[i] for i in chosen])
        for row, i in zip(folded, chosen, strict=True):
            bits = np.bincount((arrays.mix(parts[i]) % np.uint64(64 * length)).astype(int), minlength=64 * length) % 2
            assert np.unpackbits(row.view(np.uint8), bitorder="little").tolist() == bits.tolist()


def test_one_of_each_keeps_the_smallest_and_all_columns(clashing, no_docs):
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and not {2, 3}.intersection(ids)
    assert {4, 5, 6, 14}.issubset(ids) and ids.count(14) == 2
    assert jaccard.one_of_each(no_docs).count() == 0


def test_a_block_agrees_in_every_similar_pair():
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(85, 100)
    for size in (6, 7, 11, 12, 40, 333, 2000):
        for _ in range(20):
            one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            d = int(bands.difference(len(one)))
            dropped = int(rng.integers(0, max(d // 3, 0) + 1))
            extra = rng.integers(0, 2**63, max(d - 2 * dropped, 0), dtype=np.uint64)
            two = np.unique(np.concatenate([one[dropped:], extra]))
            common = len(np.intersect1d(one, two))
            if 100 * common < 85 * (len(one) + len(two) - common) or len(one) == len(two) == common:
                continue
            text = np.repeat([0, 1], [len(one), len(two)])
            owner, keys = jaccard.sketch_keys(text, np.concatenate([one, two]), np.array([len(one), len(two)]), bands)
            first, second = (set((keys[owner == i] >> np.uint64(1)).tolist()) for i in (0, 1))
            probes = {int(k) >> 1 for k in keys[(keys & np.uint64(1)) > 0].tolist()}
            assert first & second & probes


def test_shingles_of_texts_next_to_each_other_do_not_mix():
    texts = [b"a b c d e", b"", b"A B C D E", b"a b", b"x"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    text, hashes = jaccard.shingles(data, offsets, 4)
    assert np.bincount(text, minlength=5).tolist() == [2, 0, 2, 1, 1]
    assert set(hashes[text == 0]) == set(hashes[text == 2])
    assert len(arrays.mix(hashes)) == 6


def test_keys_are_shuffled_packed_and_only_shared_ones_whole(spark):
    rng = random.Random(8)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join(words[i])) for i in range(20)]
    rows += [(200 + i, " ".join([*words[i][:-1], "other"])) for i in range(3)]
    info = jaccard.nodes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    reps = info.groupBy("node").agg(F.min("doc_id").alias("rep")).cache()
    nodes = {r.node: r["keys"] for r in info.collect()}
    holders = collections.defaultdict(list)
    for node, keys in nodes.items():
        for k in keys:
            holders[(k % 2**64) >> 1].append((node, k))
    wanted = {h for own in holders.values() if len(own) > 1 and any(k & 1 for _, k in own) for h in own}
    assert sorted(r.node for r in jaccard._one_of_each_node(info, reps).collect()) == sorted(nodes)
    found = [(r.node, r.tagged) for r in jaccard._shared_keys(info, reps).collect()]
    assert wanted <= set(found) and len(found) == len(set(found)) < len(wanted) + sum(map(len, nodes.values())) / 20
    assert {n for n, _ in wanted} == {r.node for r in info.where("doc_id < 3 OR doc_id >= 200").collect()}
    maybe = jaccard._maybe_shared(jaccard._one_of_each_node(info, reps), 6)
    assert maybe.count() == len({(k % 2**64) >> 1 for _, k in wanted})


def test_the_field_of_shared_keys_may_be_small_or_left_out(odd_docs, odd_rows, monkeypatch):
    expected = brute.jaccard_components(odd_rows, 4, 85, 100)
    for most in (9, 16):
        monkeypatch.setattr(bloom, "MOST_BITS", most)
        assert found(jaccard.jaccard_components(odd_docs, 4, 85, 100)) == expected
    assert bloom.bits_for(0) == bloom.bits_for(1) == 16
    assert bloom.bits_for(2**15) is not None and bloom.bits_for(2**15 + 1) is None

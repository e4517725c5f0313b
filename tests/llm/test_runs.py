"""Periodic runs against a search of all periods, on words and on whole tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import runs
from spanloom.llm.queries import QUERIES
from tests.conftest import SF_DIR
from tests.llm import brute


def made(rng: random.Random, size: int) -> list[int]:
    """Words with many repeats, nested and side by side."""
    words: list[int] = []
    while len(words) < size:
        kind = rng.randrange(3)
        some = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(1 + rng.randrange(11))]
        if kind == 0:
            words += some
        elif kind == 1:
            words += (some * 80)[: 1 + rng.randrange(70)]
        elif words:
            at = rng.randrange(len(words))
            words += (words[at : at + 1 + rng.randrange(20)] * 9)[: rng.randrange(60)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_against_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [made(rng, rng.randrange(160)) for _ in range(1 + rng.randrange(4))]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        found = runs.runs_of(np.array(sum(docs, []), dtype=np.int64), offsets)
        for k, words in enumerate(docs):
            assert found.get(k, []) == brute.periodic_runs(words)


def test_equal_documents_side_by_side_share_nothing():
    words = [1, 2, 3] * 12
    found = runs.runs_of(np.array(words * 3), np.array([0, 36, 72, 108]))
    assert found == {k: [(0, 36, 3)] for k in range(3)}


def test_strongest_compares_exactly():
    assert runs.strongest([]) is None
    assert runs.strongest([(5, 30, 3), (0, 40, 4), (2, 20, 2)]) == (5, 30, 3)
    big = 10**9
    assert runs.strongest([(0, 3 * big, big), (1, 3 * big + 1, big)]) == (1, 3 * big + 1, big)


@pytest.mark.parametrize("words", [[7] * 100_000, [1, 2, 3] * 40_000, ([0] * 40 + [1]) * 2_500])
def test_long_repeats_take_linear_time(words):
    found = runs.runs_of(np.array(words), np.array([0, len(words)]))[0]
    assert max(n for _, n, _ in found) == len(words)


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        crc = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if words and crc % 10 == 0:
            g = crc // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute.periodic_runs(words)
        dropped = {i for s, n, p in found for i in range(s + p, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(found), *more, brute.sha256(listed), brute.sha256(kept)))
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = QUERIES["op13_periodic_runs"](spark, SF_DIR)
    longs = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert found.dtypes == [(c, "bigint") for c in longs] + [("runs_sha256", "string"), ("collapsed_sha256", "string")]
    found = sorted(map(tuple, found.collect()))
    assert found == sorted(expected(rows)) and any(r[1] for r in found)


def test_odd_rows(spark, clashing, odd_rows, no_docs):
    docs = clashing.withColumns({c: F.lit("mine") for c in ("period", "start", "_crc", "Runs", "collapsed")})
    got = runs.periodic_runs(docs, prepared=True)
    assert set(docs.columns) - {"Runs", "collapsed"} < set(got.columns)
    got = got.select("doc_id", F.sha2("text", 256), "n_words", "runs", "strongest", "collapsed", "period", "shard").collect()
    assert len(got) == len(odd_rows) and all(r.period == r.shard == "mine" for r in got)
    by_id = {r.doc_id: r for r in got}
    for doc_id, n, runs_hash, kept in [(e[0], e[1], e[6], e[7]) for e in expected([r for r in odd_rows if r[0] not in (None, 14)])]:
        r = by_id[doc_id]
        assert len(r.runs) == n and brute.sha256(r.collapsed) == kept
        assert brute.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)) == runs_hash
    for doc_id in (4, 5, 6):
        assert (by_id[doc_id].n_words, by_id[doc_id].runs, by_id[doc_id].strongest, by_id[doc_id].collapsed) == (0, [], None, "")
    assert by_id[13].strongest.period == 4 or by_id[13].runs
    assert runs.periodic_runs(no_docs).collect() == []


def test_separators_and_scripts(spark):
    text = "\x1f\x85 é".join(["\x0bα\x00 β\x0c"] * 30)
    rows = [(1, text), (2, "ein zwei " * 12), (3, "ein zwei " * 11 + "ein"), (4, "x y z " * 8)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert got[1].n_words == len(words)
    assert [tuple(r) for r in got[1].runs] == brute.periodic_runs(words)
    assert [tuple(r) for r in got[2].runs] == [(0, 24, 2)] and got[2].collapsed == "ein zwei"
    assert got[3].runs == [] and got[3].collapsed == text_of(rows[2][1])
    assert tuple(got[4].strongest) == (0, 24, 3)


def text_of(text: str) -> str:
    return " ".join(text.split())

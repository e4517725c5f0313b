from __future__ import annotations

import collections
import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import decontamination, language, topk
from spanloom.llm.queries import vocabulary
from tests.llm import brute


def contaminated(docs, items, **kind):
    rows = decontamination.contamination(docs, items, **kind).collect()
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in rows)


@pytest.fixture(scope="module")
def benchmark(odd_rows):
    long = " ".join(brute.item_words(odd_rows[-1][1])[5:40])
    return [
        (1, long), (2, "one"), (3, "that id, of"), (4, None), (5, ""), (6, "?!"), (None, long), (7, long),
        (8, "a b c d a b c d a b c d"), (9, " ".join(f"unseen{i}" for i in range(20))), (7, "TEXTS of"),
    ]


def test_contamination_matches_brute_force(odd_docs, odd_rows, benchmark, spark):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    assert contaminated(odd_docs, items) == brute.contamination(odd_rows, benchmark)


def test_no_documents_or_items(odd_docs, odd_rows, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(odd_docs, none) == brute.contamination(odd_rows, [])
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert contaminated(no_docs, some) == collections.Counter()


def test_clean_documents_stay_with_all_columns(clashing, benchmark, spark):
    items = spark.createDataFrame(benchmark[:1], "item_id long, text string")
    kept = decontamination.clean_documents(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 1


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "alpha beta x gamma delta"), (3, "delta x x x x gamma beta alpha")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    found = lambda slop: {r.key_id for r in decontamination.matches(docs, items, slop=slop).collect()}
    assert found(0) == {1} and found(1) == {1, 2}


def test_proximity_at_the_beginning_of_a_text(spark):
    texts = [(1, "beta alpha gamma"), (2, "x beta alpha gamma"), (3, "alpha gamma"), (4, "gamma x x x beta alpha"), (5, None), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = lambda slop: sorted((r.key_id, r.at) for r in decontamination.matches(docs, items, slop=slop).collect())
    # Of the three words beta is the rarest; in the first text the phrase would begin one word before it.
    assert found(2) == [(1, 0), (2, 0)] and found(0) == []


def searched(spark, vectors, queries, k):
    schema = "vec_id long, embedding array<float>"
    found = topk.top_k(spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize(("many", "k"), [(300, 10), (7, 10), (1, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, many, k):
    monkeypatch.setattr(topk, "PACK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(many)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=6), 1).astype(np.float32)]) for i in range(many)]
    queries = vectors[::3]
    odd = [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 4), (9004, [math.nan] * 6), (9005, [math.inf] * 6), (9006, [1.0])]
    fixed = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in vectors}
    expected = []
    for q, _ in queries:
        best = sorted(((-int(fixed[q] @ v), i) for i, v in fixed.items() if i != q))[:k]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert searched(spark, vectors + odd, queries + odd[:5], k) == expected
    assert searched(spark, vectors, [], k) == [] == searched(spark, [], queries, k)


def test_forward_sums_over_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b" ab", b"aba", b"bb"]
    table = language.Pieces(pieces)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces), 2)) / 50 + 1e-4
    known = dict(zip(pieces, p, strict=True))

    def plain(word: bytes) -> np.ndarray:
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            if all(x in known for x in parts):
                total += np.prod([known[x] for x in parts], axis=0)
        return np.log(total)

    words = ["a", "ab", "abab", "babba", "é", "abbabab", ""]
    sums = language.log_sums(table, p, pa.array(words))
    for word, found in zip(words, sums, strict=True):
        assert np.allclose(found, plain((" " + word).encode()))
    long = language.log_sums(table, p, pa.array(["ab" * 20, "ab" * 400]))
    assert np.isfinite(long).all() and (long[1] < long[0]).all()


def test_expected_counts_are_the_words_pieces():
    pieces = [bytes([b]) for b in range(256)] + [b" ab", b"ab"]
    counts = language.expected_counts(
        language.Pieces(pieces), language.rank_prior(len(pieces)), pa.array(["ab", "q" * 50]), np.array([[2.0], [1.0]])
    )
    spelled = sum(counts[i, 0] * len(x) for i, x in enumerate(pieces))
    assert math.isclose(spelled, 2 * 3 + 51)


def test_languages(odd_docs, no_docs, clashing, spark):
    rng = random.Random(1)
    parts = {"xx": ["tion", "the", "ing", "and"], "yy": ["ung", "sch", "ein", "keit"]}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=2)) for _ in range(40))
    rows = [(i, text("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(60)] + [(99, text("xx"), None), (98, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id >= 20"), language.read_pieces(vocabulary("byte_bpe_50k.tiktoken")))
    assert model.languages == ["xx", "yy"]
    held = language.identify(docs.where("doc_id < 20 OR doc_id = 99"), model).collect()
    assert all(r.lang_pred == (r.lang or "xx") and 0.5 < r.score <= 1 for r in held)
    odd = {(r.doc_id, r.text): r for r in language.identify(odd_docs, model).collect()}
    assert [odd[k].lang_pred for k in [(4, None), (5, ""), (6, " \n "), (10, "!!! 12 ...")]] == ["und"] * 4
    assert language.identify(clashing, model).count() == clashing.count()
    assert language.identify(no_docs, model).count() == 0
    empty = language.fit(no_docs, model.pieces)
    assert {r.lang_pred for r in language.identify(odd_docs, empty).collect()} == {"und"}


@pytest.mark.parametrize(("held", "repeats"), [(8_000_000, 1), (1, 40)])
def test_learning_works_a_word_out_once_for_many_slices(monkeypatch, held, repeats):
    monkeypatch.setattr(language, "HELD_BYTES", held)
    rng = random.Random(5)
    rows = [(rng.choice(["a b", "a", "B c  d", None, "", "é d d"]), rng.choice("xy")) for _ in range(40)]
    columns = list(zip(*rows, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 1], pa.string()) for c in columns], ["text", "lang"]) for i in range(40)]
    tables = list(language._word_counts(iter(batches)))
    found = collections.Counter()
    times = collections.Counter()
    for t in tables:
        times.update({(r["word"], r["lang"]) for r in t.to_pylist()})
        for r in t.to_pylist():
            found[r["word"], r["lang"]] += r["n"]
    found = collections.Counter({k: n for k, n in found.items() if k[0]})  # splitting may leave empty words
    assert found == collections.Counter((w, lang) for text, lang in rows for w in (text or "").lower().split())
    assert len(tables) <= repeats and max(times.values()) <= repeats


def test_learning_holds_little_at_once():
    """Two workers of an executor learn beside a grown heap."""
    pieces = language.read_pieces(vocabulary("byte_bpe_50k.tiktoken"))
    table, prior = language.Pieces(pieces), language.rank_prior(len(pieces))
    rng = np.random.default_rng(6)
    words = pa.array(["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 12))) for _ in range(100_000)])
    weights = rng.integers(0, 3, (len(words), 2)).astype(float)
    tracemalloc.start()
    counts = language.expected_counts(table, prior, words, weights)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30_000_000
    lengths = np.array([len(p) for p in pieces])
    letters = np.array([len(w) + 1 for w in words.to_pylist()])
    assert np.allclose(lengths @ counts, letters @ weights)


def test_very_long_words_are_summed_in_blocks(monkeypatch):
    """One unbroken word, in blocks of places, gives what all places at once give, and takes no memory for all of them."""
    import random

    import numpy as np
    import pyarrow as pa

    from spanloom.llm import language
    from spanloom.llm.queries import vocabulary

    pieces = language.read_pieces(vocabulary("byte_bpe_50k.tiktoken"))
    table = language.Pieces(pieces)
    rng = random.Random(1)
    word = "".join(rng.choice(["ta", "re", "mon", "é", "ing", "x", "日"]) for _ in range(1500))
    words = pa.array([word, "abc", word[:700], "z" * 900])
    p = np.maximum(np.random.default_rng(0).random((len(pieces), 3)) * 1e-3, language.LEAST)
    weights = np.arange(8.0).reshape(4, 2)
    prior = language.rank_prior(table.count)
    found = {}
    for long in (1 << 20, 512):
        monkeypatch.setattr(language, "LONG", long)
        found[long] = language.log_sums(table, p, words), language.expected_counts(table, prior, words, weights)
    assert np.allclose(found[512][0], found[1 << 20][0], rtol=1e-12)
    assert np.allclose(found[512][1], found[1 << 20][1], rtol=1e-6, atol=1e-6)


def test_cached_sums_are_the_sums():
    import numpy as np
    import pyarrow as pa

    from spanloom.llm import language

    pieces = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"ba", b"bab"]
    table = language.Pieces(pieces)
    p = np.random.default_rng(3).random((len(pieces), 2)) / 100
    cache = language._Cache(2)
    cache.keys, cache.sums, cache.shift = cache.keys[:4], cache.sums[:4], np.uint64(62)  # collisions
    rng = np.random.default_rng(4)
    for _ in range(5):
        words = pa.array(["".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(40)] + ["a" * 100])
        assert np.allclose(cache.look_up(table, p, words), language.log_sums(table, p, words))

"""Benchmark decontamination with a positional inverted index.

Benchmark items are cut into windows of consecutive words. The index holds, by
term and document, the positions of the term in the document (a posting). A
window is looked up from its two rarest terms: their position lists, each less
the term's offset in the window, are intersected, which leaves the places where
the window may begin; the postings of its other terms decide.

Only the index is sharded by term; the three passes over the documents are
narrow. They tell apart the terms that matter by a bit field of fixed size, so
nothing that grows with either table is broadcast: first the terms of the test
set are counted, then postings of the windows' two rarest terms are stored, then
postings of all terms of the candidates' windows, in the candidates' documents
only. A term as common as a third of all words is expanded only where it is the
rarest of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays, bloom
from spanloom.llm.common import KEY, packed, row_key, written

WORD_BYTES = arrays.flags((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WINDOW = 10
ANCHORS = 2


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, 64-bit term) of every word, A-Z lower-cased."""
    starts, ends, text = arrays.spans(data, offsets, WORD_BYTES)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    return text, np.arange(len(text)) - first[text], arrays.span_hashes(arrays.LOWER[data], starts, ends)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, start, length, terms array<long>) of the items' windows.

    An item of fewer words is one window, one without words or text has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            text, _, found = terms(data, offsets)
            bounds = np.searchsorted(text, np.arange(len(rows) + 1))
            ids = rows.column(0).to_pylist()
            out = []
            for i, item in enumerate(ids):
                own = found[bounds[i] : bounds[i + 1]].view(np.int64)
                for start in range(max(len(own) - window + 1, min(len(own), 1))):
                    out.append((item, start, own[start : start + window].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], rows.column(0).type),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(pa.int64())),
                ],
                ["item_id", "start", "terms"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, start long, terms array<long>")


def _term_counts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n): occurrences of the terms that the field may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in arrays.slices(batches):
            _, _, found = terms(data, offsets)
            kinds, n = np.unique(found, return_counts=True)
            keep = bloom.holds(wanted, kinds)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[keep].view(np.int64)), pa.array(n[keep])], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, wanted: np.ndarray, within: np.ndarray | None = None) -> DataFrame:
    """The inverted index: (term, key, positions array<int>), sorted positions.

    Terms are those the field ``wanted`` may hold; documents all, or those whose
    key the field ``within`` may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            keys = [rows.column(rows.schema.get_field_index(k)) for k in KEY]
            text, place, found = terms(data, offsets)
            keep = bloom.holds(wanted, found)
            if within is not None:
                marks = keys[0].to_numpy().view(np.uint64) ^ keys[1].to_numpy().view(np.uint64)
                keep &= bloom.holds(within, arrays.mix(marks))[text]
            text, place, found = text[keep], place[keep], found[keep]
            order = np.lexsort((place, found, text))
            text, place, found = text[order], place[order], found[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first, len(text)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            owner = pa.array(text[first])
            columns = [pa.array(found[first].view(np.int64)), *(k.take(owner) for k in keys), lists]
            yield pa.RecordBatch.from_arrays(columns, ["term", *KEY, "positions"])

    return docs.select("text", *row_key()).mapInArrow(
        run, "term long, key_id long, key_hash long, key_size long, positions array<int>"
    )


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mark = batch.column(0).to_numpy().view(np.uint64) ^ batch.column(1).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(arrays.mix(mark).view(np.int64))], ["mark"])


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(item_id, start, key, at, length): where windows of items occur in documents.

    With ``slop`` 0 these are exact phrases beginning at word ``at``. Otherwise
    every word may stand up to ``slop`` words before or after its place in the
    phrase that begins at ``at``, as told by the rarest word (a proximity match);
    one that would begin before the text is told at its first word.
    Windows of the same words are found alike for each item that has them.
    """
    windows = item_windows(items, window)
    phrases = windows.select("terms").distinct().select("terms", F.monotonically_increasing_id().alias("phrase"))
    phrases = written(phrases, "phrases")
    words = phrases.select("phrase", F.posexplode("terms").alias("offset", "term"))
    vocabulary = written(words.select("term").distinct(), "vocabulary")
    counts = _term_counts(docs, bloom.build(vocabulary, "term"))
    counts = written(vocabulary.join(counts, "term", "left").fillna(0, ["n"]), "term-counts")

    # A term's first place in the phrase will do for an anchor; a phrase of one kind of word has one anchor.
    kinds = words.groupBy("phrase", "term").agg(F.min("offset").alias("offset")).join(counts, "term")
    ranked = kinds.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("ranked"))
    present = ranked.where("ranked[0].n > 0")  # a word that no document has
    anchors = written(
        present.select("phrase", *(F.get("ranked", F.lit(i)).alias(f"anchor_{i}") for i in range(ANCHORS))), "anchors"
    )
    wanted = anchors.select(F.explode(F.array(*(f"anchor_{i}.term" for i in range(ANCHORS)))).alias("term"))
    index = written(postings(docs, bloom.build(wanted.where("term IS NOT NULL").distinct(), "term")), "postings")

    first = anchors.select("phrase", "anchor_0.term", "anchor_0.offset", "anchor_1")
    # Of a text's first words some may stand before their places, so that the phrase would begin before the text.
    begins = F.filter(F.transform("positions", lambda p: p - F.col("offset")), lambda b: b >= -slop)
    found = index.join(first, "term").select("phrase", *KEY, "anchor_1", begins.alias("begins")).where("size(begins) > 0")
    second = index.select(F.col("term").alias("term_1"), *KEY, F.col("positions").alias("positions_1"))
    narrowed = found.withColumns({"term_1": F.col("anchor_1.term"), "offset_1": F.col("anchor_1.offset")})
    alone = narrowed.where("term_1 IS NULL").select("phrase", *KEY, "begins")
    narrowed = narrowed.where("term_1 IS NOT NULL").join(second, ["term_1", *KEY])
    narrowed = narrowed.select("phrase", *KEY, _near("begins", "positions_1", "offset_1", slop).alias("begins"))
    candidates = written(narrowed.union(alone).where("size(begins) > 0"), "candidates")

    marks = candidates.select("key_id", "key_hash").distinct().mapInArrow(_marks, "mark long")
    searched = candidates.select("phrase").distinct().join(words, "phrase")
    searched = written(searched.select("phrase", "offset", "term"), "searched")
    full = postings(docs, bloom.build(searched.select("term").distinct(), "term"), bloom.build(marks, "mark"))
    full = written(full, "candidate-postings")
    asked = candidates.join(searched, "phrase").join(full.dropDuplicates(["term", *KEY]), ["term", *KEY])
    agreeing = asked.select(
        "phrase", *KEY, "offset", F.explode(_near("begins", "positions", "offset", slop)).alias("at")
    ).distinct()
    whole = written(agreeing.groupBy("phrase", *KEY, "at").agg(F.count("*").alias("agreeing")), "agreeing")
    where = windows.join(phrases, "terms").select("phrase", "item_id", "start", F.size("terms").alias("length"))
    found = whole.join(written(where, "windows"), "phrase").where("agreeing = length")
    if not slop:
        return found.select("item_id", "start", *KEY, "at", "length")
    return found.select("item_id", "start", *KEY, F.greatest("at", F.lit(0)).alias("at"), "length").distinct()


def _near(begins: str, positions: str, offset: str, slop: int):
    """Those begins at which the word with that offset stands, or within ``slop`` words of there."""
    moved = F.transform(positions, lambda p: p - F.col(offset))
    if not slop:
        return F.array_intersect(F.col(begins), moved)
    return F.filter(begins, lambda b: F.exists(moved, lambda m: F.abs(m - b) <= slop))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in arrays.slices(batches):
        _, _, text = arrays.spans(data, offsets, WORD_BYTES)
        columns = [rows.column(i) for i in range(4)] + [pa.array(np.bincount(text, minlength=len(rows)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *KEY, "n_words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids) for every row of ``docs``.

    ``n_hit`` counts the words inside any exact occurrence of any window of
    ``items``, ``item_ids`` holds the items with such windows as text, sorted.
    Null texts have no words. Rows that agree in doc_id and text get the same;
    null and repeated item ids are ids like others. Other columns are ignored.
    """
    found = written(matches(docs, items, window), "matches")
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length").cast("int") - 1))
    hits = found.select(*KEY, "at", "length").distinct().select(*KEY, covered.alias("word")).distinct()
    hits = hits.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = found.select(*KEY, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    per_doc = written(hits.join(named, KEY), "hits")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", *row_key(), "text").mapInArrow(
        _word_counts, f"doc_id {kind}, key_id long, key_hash long, key_size long, n_words long"
    )
    joined = counted.join(per_doc, KEY, "left")
    return joined.select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs; all columns stay."""
    hit = written(matches(docs, items, window).select(*KEY).distinct(), "contaminated")
    return packed(docs).join(hit, KEY, "left_anti").select("row.*")

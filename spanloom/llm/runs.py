"""Periodic runs of words, from maximal pairs.

A run is a stretch of words that repeats with a smallest period, three times or
more, and that no neighbouring word extends. Whatever starts a run at word i with
period q occurs again at i + q: the two occurrences agree for length - q words,
differ in the word to their left, and differ in the word that follows. So runs
are exactly the maximal pairs (i, j) whose common prefix is at least twice their
distance; of several distances with one stretch the smallest is the period.

Maximal pairs are read from the tree of LCP intervals, bottom-up: an interval's
places are the union of its children's, kept in text order with the class of the
word to the left; a pair forms where neighbours come from different children and
different classes. (Neighbours suffice: between two occurrences at a smallest
period no third one fits.) Smaller lists go into larger ones.

Only repeats of PERIODS - 1 periods matter, so the tree is cut off at their least
length; suffixes whose first so many words occur once in a document stay out
of it. Words are numbered, not hashed, and sorted by prefix doubling for all
documents of a slice at a time, so nothing rests on chance. Tasks work alone, on
slices of about a megabyte; one longer text forms a slice of its own, with memory
in proportion to its words (times the log of its longest repeat).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm import arrays
from spanloom.llm.common import free_name

LEAST_LENGTH = 24
PERIODS = 3
"""A run is at least so many words and so many periods long."""
CUT = LEAST_LENGTH - LEAST_LENGTH // PERIODS
"""The common prefix of such a pair is no shorter: it is length - period, and period <= length / PERIODS."""
_WORD = arrays.flags((0, 8), (14, 31), (33, 255))

Run = tuple[int, int, int]
"""start, length, period"""


def periodic(words: np.ndarray, crc: int) -> np.ndarray:
    """Places the words come from when a document of this checksum is made periodic from some word on."""
    n = len(words)
    if not n or crc % 10:
        return words
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _levels(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes that share CUT words or more with another of their document, in suffix order, and ranks by prefix length.

    Suffixes are sorted by prefix doubling; a rank is the place of a suffix's
    group among all. Suffixes alone in their group are not sorted any further.
    Prefixes that reach over the end of a document equal no other.
    """
    n = len(ids)
    words = owner * (int(ids.max()) + 1) + ids
    order = np.argsort(words)
    new = np.append(True, words[order][1:] != words[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = order[~(new & np.append(new[1:], True))]
    levels: list[tuple[int, np.ndarray]] = []
    kept = active
    length = 1
    while len(active):
        step = length
        if length >= CUT:
            kept = kept if levels else active
            levels.append((length, rank.copy()))
        else:
            step = min(length, CUT - length)
        after = active + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], n + active)
        order = np.argsort(rank[active] * (2 * n) + second)
        active, second = active[order], second[order]
        group = rank[active]
        head = np.append(True, group[1:] != group[:-1])
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        places = np.arange(len(active))
        first = np.maximum.accumulate(np.where(head, places, 0))
        rank[active] = group + np.maximum.accumulate(np.where(new, places, 0)) - first
        active = active[~(new & np.append(new[1:], True))]
        length += step
    if not levels:
        return np.zeros(0, dtype=np.int64), []
    return kept[np.argsort(rank[kept])], levels


def _common(a: np.ndarray, b: np.ndarray, ids: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b`` if it is CUT or more, else 0."""
    last = len(ids) - 1
    same = np.zeros(len(a), dtype=np.int64)
    for length, rank in reversed(levels):
        x, y = a + same, b + same
        equal = (np.maximum(x, y) <= last) & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])
        same[equal] += length
    left = np.flatnonzero(same)
    while len(left):  # fewer than CUT words to go
        x, y = a[left] + same[left], b[left] + same[left]
        left = left[(np.maximum(x, y) <= last) & (ids[np.minimum(x, last)] == ids[np.minimum(y, last)])]
        same[left] += 1
    return same


def _pairs(suffixes: list[int], common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, j, length of the common prefix): maximal pairs whose prefix is PERIODS - 1 distances or more.

    ``common`` holds the common prefix of each suffix with the next one, less
    than CUT where a tree ends. ``left`` is the class of the word to the left of
    each suffix.
    """
    classes = dict(zip(suffixes, left, strict=True))
    open_intervals: list[tuple[int, list[int]]] = []
    for suffix, prefix in zip(suffixes, common, strict=True):
        places = [suffix]
        # Intervals deeper than what this suffix shares with the next end here.
        while open_intervals and open_intervals[-1][0] >= prefix:
            depth, more = open_intervals.pop()
            fewer, places = (places, more) if len(places) <= len(more) else (more, places)
            yield from _united(depth, fewer, places, classes)
        if prefix >= CUT:
            open_intervals.append((prefix, places))


def _united(depth: int, fewer: list[int], places: list[int], classes: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """Put one child's places into those of its siblings; yields the maximal pairs of neighbours this makes."""
    own = set(fewer)
    if len(fewer) * 16 > len(places):
        places += fewer
        places.sort()
    else:
        for x in fewer:
            insort(places, x)
    widest = depth // (PERIODS - 1)
    for x in fewer:
        k = bisect_left(places, x)
        if k:
            i = places[k - 1]
            if x - i <= widest and i not in own and classes[i] != classes[x]:
                yield i, x, depth
        if k + 1 < len(places):
            j = places[k + 1]
            if j - x <= widest and j not in own and classes[j] != classes[x]:
                yield x, j, depth


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> dict[int, list[Run]]:
    """Runs of each document, by its number: ``ids`` are the words of all, ``offsets`` where each begins.

    Starts count from the document's first word; runs come by start, then period.
    """
    n = len(ids)
    if n < LEAST_LENGTH:
        return {}
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    suffixes, levels = _levels(ids, owner)
    if not len(suffixes):
        return {}
    of = owner[suffixes]
    starts, ends = offsets[:-1][of], offsets[1:][of]
    common = np.zeros(len(suffixes), dtype=np.int64)
    # The words behind the cut may go on alike in the next document: prefixes end with their own.
    to_end = ends - suffixes
    shared = _common(suffixes[:-1], suffixes[1:], ids, levels)
    common[:-1] = np.minimum(shared, np.minimum(to_end[:-1], to_end[1:]))
    left = np.where(suffixes > starts, ids[np.maximum(suffixes - 1, 0)], -1)
    periods: dict[tuple[int, int], int] = {}
    for i, j, prefix in _pairs(suffixes.tolist(), common.tolist(), left.tolist()):
        stretch, period = (i, j + prefix), j - i
        if period + prefix >= LEAST_LENGTH and period < periods.get(stretch, n):
            periods[stretch] = period
    found: dict[int, list[Run]] = {}
    for (start, end), period in sorted(periods.items(), key=lambda x: (x[0][0], x[1])):
        k = int(owner[start])
        found.setdefault(k, []).append((start - int(offsets[k]), end - start, period))
    return found


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _sliced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of all words of a slice, and each document's first word."""
    starts, ends, number = arrays.spans(data, offsets, _WORD)
    first = np.searchsorted(number, np.arange(len(offsets)))
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    kind = pa.large_binary()
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[_WORD[data]])])
    ids = np.asarray(words.dictionary_encode().indices).astype(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    return starts, lengths, ids, first


def _spelled(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The given words one after another, a space behind each, and where each ends (with its space)."""
    sizes = lengths[words] + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(starts[words] - (ends - sizes), sizes) + np.arange(total)
    out = data[np.minimum(source, len(data) - 1)] if total else np.zeros(0, dtype=np.uint8)
    out[ends - 1] = 32
    return out.tobytes(), ends


def periodic_runs(docs: DataFrame, prepared: bool = False) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period), ``n_words``, ``strongest`` and ``collapsed``.

    A word is a stretch without white space (``[^\\x20\\x09-\\x0D]+``). ``runs``
    come by start, then period; ``strongest`` is the one of the greatest length /
    period, null without runs. ``collapsed`` is the text with single spaces,
    without the words that some run holds after its first period.

    With ``prepared`` every document whose crc32 of the decimal doc_id is
    divisible by 10 is first made periodic from some word on (:func:`periodic`);
    a null doc_id counts as empty text. Null and empty texts, and texts of white
    space, have no words, no runs and an empty ``collapsed``. Columns of the four
    names are replaced, all others stay as they are; equal rows get equal results.
    """
    docs = docs.drop("runs", "n_words", "strongest", "collapsed")
    names = docs.columns
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) if prepared else F.lit(1)
    run_type = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            starts, lengths, ids, first = _sliced(data, offsets)
            crcs = rows.column(len(names)).to_pylist()
            source = np.arange(len(ids))
            for k in [k for k, c in enumerate(crcs) if c % 10 == 0]:
                source[first[k] : first[k + 1]] = periodic(source[first[k] : first[k + 1]], crcs[k])
            found = runs_of(ids[source], first)
            kept = np.ones(len(source), dtype=bool)
            for k, listed in found.items():
                for start, length, period in listed:
                    kept[first[k] + start + period : first[k] + start + length] = False
            spelled, ends = _spelled(data, starts, lengths, source[kept])
            after = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])[first]]
            texts = [spelled[a : max(a, b - 1)].decode() for a, b in zip(after[:-1].tolist(), after[1:].tolist(), strict=True)]
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, ())] for k in range(len(rows))]
            best = [strongest(found.get(k, [])) for k in range(len(rows))]
            best = [None if r is None else dict(zip(("start", "length", "period"), r, strict=True)) for r in best]
            more = [pa.array(listed, pa.list_(run_type)), pa.array(np.diff(first)), pa.array(best, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *more], [*names, "runs", "n_words", "strongest", "collapsed"])

    one = "struct<start: long, length: long, period: long>"
    more = StructType.fromDDL(f"runs array<{one}>, n_words long, strongest {one}, collapsed string")
    schema = StructType(docs.schema.fields + more.fields)
    return docs.withColumn(free_name(docs, "_crc"), crc).mapInArrow(run, schema)


"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary
(byte strings, single bytes among them, so that any text has a segmentation).
The probability of a text is the sum over all ways to cut it into pieces. Texts
are lower-cased and words separated by white space; as no piece holds white
space but in front, that sum is the product of the words' sums, and the forward
algorithm runs once per distinct word, for all languages and many words at a
time.

Learning is one step of expectation maximisation from a prior that falls with a
piece's rank: every task adds up the expected counts of its training rows, by
language, and an aggregation adds up the tasks' (vocabulary times languages rows
at most, however many documents there are).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays

UNKNOWN = "und"
LEAST = 1e-8
"""No piece is less probable; keeps the sums of words up to SHORT bytes above the smallest double."""
SHORT = 36
SMOOTHING = 0.1
CACHE_BYTES = 24_000_000
CACHED_LENGTH = 64
"""A task remembers the sums of words of up to so many bytes in a table of at most this size; others are worked out again."""
SLOT_BITS = 20
HELD_BYTES = 8_000_000
"""A learning task holds word counts of about so many bytes before it works their pieces out."""
BATCH_BYTES = 100_000
"""About so many bytes of words are worked on at once; each takes some 200 bytes for its pieces and sums."""
LONG = 4096
"""Longer words (in bytes) are gone through one by one, in blocks of so many places."""
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = arrays.mix(np.arange(7001, 7257, dtype=np.uint64))


class Pieces:
    """The vocabulary as a table of all beginnings of pieces, looked up by hash."""

    def __init__(self, pieces: list[bytes]):
        # Texts are lower-cased, so pieces that are not never occur.
        low = [p.decode(errors="surrogateescape").lower().encode(errors="surrogateescape") == p for p in pieces]
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(lengths) - lengths
        own = np.flatnonzero(np.array(low, dtype=bool) & (lengths > 0))
        h = np.zeros(len(own), dtype=np.uint64)
        hashes, numbers = [], []
        n = 0
        while len(own):
            h = h * _STEP + _BYTE[data[starts[own] + n]]
            n += 1
            whole = lengths[own] == n
            hashes.append(h)
            numbers.append(np.where(whole, own, len(pieces)))
            own, h = own[~whole], h[~whole]
        every, number = np.concatenate([*hashes, h]), np.concatenate([*numbers, own])
        # Of equal beginnings the first whole piece counts, if there is one.
        order = np.lexsort((number, every))
        every, number = every[order], number[order]
        first = np.append(True, every[1:] != every[:-1])[: len(every)]
        self.count = len(pieces)
        self.longest = n
        self.hashes = every[first]
        self.piece = np.where(number[first] < len(pieces), number[first], -1)
        self.levels = []
        left = np.arange(len(self.hashes))
        while len(left):
            table = np.full(2**SLOT_BITS, -1, dtype=np.int32)
            slots = self._slot(self.hashes[left])
            _, found = np.unique(slots, return_index=True)
            table[slots[found]] = left[found]
            self.levels.append(table)
            left = np.delete(left, found)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (arrays.mix(h) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of beginnings; -1 where there is none."""
        slots = self._slot(h)
        out = np.full(len(h), -1, dtype=np.int64)
        for table in self.levels:
            node = table[slots]
            np.copyto(out, node, where=(node >= 0) & (self.hashes[node] == h))
        return out

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: bool = True) -> Iterator[tuple]:
        """By length of the piece: (length, word numbers, places in the word, piece numbers).

        Unless ``inside``, only pieces at the beginnings of the words.
        """
        lengths = ends - starts if inside else np.ones(len(starts), dtype=np.int64)
        word = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[word]
        h = np.zeros(len(at), dtype=np.uint64)
        n = 0
        while len(at):
            h = h * _STEP + _BYTE[data[at + n]]
            n += 1
            node = self.find(h)
            piece = np.where(node >= 0, self.piece[node], -1)
            hit = piece >= 0
            yield n, word[hit], (at - starts[word])[hit], piece[hit]
            going = (node >= 0) & (at + n < ends[word])
            at, word, h = at[going], word[going], h[going]


class Steps(NamedTuple):
    """Matches of words of one size class, by the place they end at."""

    last: int
    by_end: list[list[tuple]]
    """Per end: (length, words, pieces)."""


def _steps(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Steps:
    last = int((ends - starts).max(initial=0))
    by_end: list[list[tuple]] = [[] for _ in range(last + 1)]
    for n, word, place, piece in pieces.matches(data, starts, ends):
        order = np.argsort((place + n).astype(np.int32), kind="stable")
        word, piece, stop = word[order], piece[order], (place + n)[order]
        bounds = np.searchsorted(stop, np.arange(last + 2))
        for t in np.unique(stop):
            a, b = bounds[t], bounds[t + 1]
            by_end[t].append((n, word[a:b], piece[a:b]))
    return Steps(last, by_end)


def _forward(steps: Steps, many: int, p: np.ndarray, logs: bool) -> np.ndarray:
    """Sums of the beginnings of each word: [words, places, languages]; ``p`` and the result in logs if ``logs``."""
    alpha = np.full((many, steps.last + 1, p.shape[1]), -np.inf if logs else 0.0)
    alpha[:, 0] = 0.0 if logs else 1.0
    for t, found in enumerate(steps.by_end):
        for n, word, piece in found:
            if logs:
                alpha[word, t] = np.logaddexp(alpha[word, t], alpha[word, t - n] + p[piece])
            else:
                alpha[word, t] += alpha[word, t - n] * p[piece]
    return alpha


def _blocks(pieces: Pieces, word: np.ndarray, backward: bool = False) -> Iterator[tuple]:
    """The pieces that begin at each place of a long word, LONG places at a time.

    (first place, number of places, bounds, lengths, piece numbers): the pieces
    of a block's i-th place are those from bounds[i] to bounds[i + 1].
    """
    begins = range(0, len(word), LONG)
    for begin in reversed(begins) if backward else begins:
        starts = np.arange(begin, min(begin + LONG, len(word)))
        size, own, piece = [], [], []
        for n, at, _, found in pieces.matches(word, starts, np.minimum(starts + pieces.longest, len(word)), inside=False):
            size.append(np.full(len(at), n))
            own.append(at)
            piece.append(found)
        own = np.concatenate(own)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(starts) + 1)).tolist()
        yield begin, len(starts), bounds, np.concatenate(size)[order].tolist(), np.concatenate(piece)[order]


_SMALL = 1e-150


def _long_sums(pieces: Pieces, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per language the log of the sum over all segmentations of a long word.

    Only sums of a block's places and of as many behind it as the longest piece
    has are kept, scaled up whenever they get small. Plain numbers in lists: a
    place has a few pieces only.
    """
    ahead = [[1.0] + [0.0] * pieces.longest for _ in range(p.shape[1])]
    scaled = [0] * p.shape[1]
    for _, many, bounds, sizes, found in _blocks(pieces, word):
        for k, chances in enumerate(p[found].T.tolist()):
            sums = ahead[k] + [0.0] * many
            for i in range(many):
                now = sums[i]
                if now < _SMALL:
                    for t in range(i, i + pieces.longest + 1):
                        sums[t] /= _SMALL
                    now = sums[i]
                    scaled[k] += 1
                for j in range(bounds[i], bounds[i + 1]):
                    sums[i + sizes[j]] += now * chances[j]
            ahead[k] = sums[many:]
    return np.log([a[0] for a in ahead]) + np.log(_SMALL) * np.array(scaled)


def _long_counts(pieces: Pieces, word: np.ndarray, p: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
    """Add the expected counts of a long word's pieces, with one prior for all languages."""
    wide = pieces.longest
    # Sums of all beginnings, and how often each was scaled up.
    alpha, times = np.zeros(len(word) + 1), np.zeros(len(word) + 1, dtype=np.int32)
    ahead, scaled = [1.0] + [0.0] * wide, 0
    for begin, many, bounds, sizes, found in _blocks(pieces, word):
        sums, chances, scales = ahead + [0.0] * many, p[found].tolist(), []
        for i in range(many):
            now = sums[i]
            if now < _SMALL:
                for t in range(i, i + wide + 1):
                    sums[t] /= _SMALL
                now = sums[i]
                scaled += 1
            scales.append(scaled)
            for j in range(bounds[i], bounds[i + 1]):
                sums[i + sizes[j]] += now * chances[j]
        alpha[begin : begin + many], times[begin : begin + many] = sums[:many], scales
        ahead = sums[many:]
    total, rounds = ahead[0], scaled
    # Sums of all ends, from the last place on; behind[t] belongs to the place t after the block.
    behind, down = [1.0] + [0.0] * wide, 0
    for begin, many, bounds, sizes, found in _blocks(pieces, word, backward=True):
        chances = p[found].tolist()
        sums = [0.0] * many + behind
        share = [0.0] * len(sizes)
        for i in range(many - 1, -1, -1):
            # The scales cancel in the quotient, which is a probability.
            here = alpha[begin + i] / total * _SMALL ** float(times[begin + i] + down - rounds)
            now = 0.0
            for j in range(bounds[i], bounds[i + 1]):
                through = chances[j] * sums[i + sizes[j]]
                now += through
                share[j] = here * through
            if now < _SMALL:
                now /= _SMALL
                for t in range(i + 1, min(i + wide + 1, len(sums))):
                    sums[t] /= _SMALL
                down += 1
            sums[i] = now
        behind = sums[: wide + 1]
        behind += [0.0] * (wide + 1 - len(behind))
        expected = np.bincount(found, share, minlength=len(counts))
        for k in np.flatnonzero(weights):
            counts[:, k] += expected * weights[k]


def _classes(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Numbers of words of about the same length, few enough for bounded memory; and whether to use logs."""
    low = 0
    high = 12
    while low < lengths.max(initial=0) and low < LONG:
        own = np.flatnonzero((lengths > low) & (lengths <= high))
        batch = max(1, BATCH_BYTES // high)
        for begin in range(0, len(own), batch):
            yield own[begin : begin + batch], high > SHORT
        low, high = high, SHORT if high < SHORT else min(high * 2, LONG)


def _long(lengths: np.ndarray) -> np.ndarray:
    """Numbers of the words that are longer than all classes."""
    return np.flatnonzero(lengths > LONG)


def _words(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Ends of each text's words, the distinct words, and every word's number among them."""
    texts = rows.column(rows.schema.get_field_index("text")).fill_null("")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    return np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(), coded.dictionary, np.asarray(coded.indices)


def _bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each with a space in front; their starts and ends. (Splitting may leave empty words.)"""
    joined = pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))
    lengths = np.asarray(pc.binary_length(joined)).astype(np.int64)
    ends = np.cumsum(lengths)
    raw = joined.buffers()[2] if len(joined) else None
    data = np.frombuffer(raw, dtype=np.uint8)[: int(lengths.sum())] if raw else np.zeros(0, dtype=np.uint8)
    return data, ends - lengths, ends


class _Cache:
    """Sums of words by the words' 64-bit hashes; a slot holds the word that came last."""

    def __init__(self, languages: int):
        bits = max(1, int(np.log2(CACHE_BYTES / (8 + 8 * max(1, languages)))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(2**bits, dtype=np.uint64)
        self.sums = np.zeros((2**bits, languages))
        self.factors = arrays.mix(np.arange(1, CACHED_LENGTH + 1, dtype=np.uint64)) | np.uint64(1)

    def hashes(self, words: pa.StringArray) -> np.ndarray:
        """0 for words that are too long."""
        data, starts, ends = _bytes(words)
        lengths = ends - starts  # the space in front counts
        out = np.zeros(len(words), dtype=np.uint64)
        short = np.flatnonzero(lengths <= CACHED_LENGTH)
        if len(short):
            sizes = lengths[short]
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            parts = _BYTE[data[np.repeat(starts[short], sizes) + place]] * self.factors[place]
            out[short] = arrays.mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64))
        return out

    def look_up(self, pieces: Pieces, p: np.ndarray, words: pa.StringArray) -> np.ndarray:
        """:func:`log_sums` of the words."""
        h = self.hashes(words)
        slots = (h >> self.shift).astype(np.int64)
        out = self.sums[slots]
        fresh = np.flatnonzero((self.keys[slots] != h) | (h == 0))
        for begin in range(0, len(fresh), 20_000):
            part = fresh[begin : begin + 20_000]
            out[part] = log_sums(pieces, p, words.take(pa.array(part)))
        fresh = fresh[h[fresh] != 0]
        self.keys[slots[fresh]] = h[fresh]
        # Of several words with one slot the last one wins in both arrays.
        self.sums[slots[fresh]] = out[fresh]
        return out


def rank_prior(n: int) -> np.ndarray:
    p = 1.0 / (np.arange(n) + 100.0)
    return p / p.sum()


def expected_counts(pieces: Pieces, prior: np.ndarray, words: pa.StringArray, weights: np.ndarray) -> np.ndarray:
    """[pieces, languages]: how often each piece is expected in the words, which count ``weights`` [words, languages]."""
    data, starts, ends = _bytes(words)
    counts = np.zeros((pieces.count, weights.shape[1]))
    p = np.maximum(prior, LEAST)[:, None]
    for k in _long(ends - starts):
        _long_counts(pieces, data[starts[k] : ends[k]], p[:, 0], weights[k], counts)
    for own, logs in _classes(ends - starts):
        steps = _steps(pieces, data, starts[own], ends[own])
        used = np.log(p) if logs else p
        alpha = _forward(steps, len(own), used, logs)[:, :, 0]
        length = (ends - starts)[own]
        total = alpha[np.arange(len(own)), length]
        beta = np.full(alpha.shape, -np.inf if logs else 0.0)
        beta[np.arange(len(own)), length] = 0.0 if logs else 1.0
        shares = []
        for t in range(steps.last, 0, -1):
            for n, word, piece in steps.by_end[t]:
                if logs:
                    through = beta[word, t] + used[piece, 0]
                    share = np.exp(alpha[word, t - n] + through - total[word])
                    beta[word, t - n] = np.logaddexp(beta[word, t - n], through)
                else:
                    through = beta[word, t] * used[piece, 0]
                    share = alpha[word, t - n] * through / total[word]
                    beta[word, t - n] += through
                shares.append((word, piece, share))
        if not shares:
            continue
        word, piece, share = (np.concatenate(part) for part in zip(*shares, strict=True))
        for k in range(weights.shape[1]):
            counts[:, k] += np.bincount(piece, share * weights[own[word], k], minlength=pieces.count)
    return counts


def log_sums(pieces: Pieces, p: np.ndarray, words: pa.StringArray) -> np.ndarray:
    """[words, languages]: log of the sum over all segmentations."""
    data, starts, ends = _bytes(words)
    out = np.zeros((len(words), p.shape[1]))
    for k in _long(ends - starts):
        out[k] = _long_sums(pieces, data[starts[k] : ends[k]], p)
    for own, logs in _classes(ends - starts):
        steps = _steps(pieces, data, starts[own], ends[own])
        alpha = _forward(steps, len(own), np.log(p) if logs else p, logs)
        sums = alpha[np.arange(len(own)), (ends - starts)[own]]
        out[own] = sums if logs else np.log(sums)
    return out


class LanguageModel(NamedTuple):
    languages: list[str]
    pieces: list[bytes]
    probabilities: np.ndarray
    """[pieces, languages]"""


def read_pieces(path: str) -> list[bytes]:
    """Byte strings of a ranks file, by rank; those with white space inside can't match and stay out of the way."""
    with open(path, "rb") as file:
        ranked = sorted((int(b), base64.b64decode(a)) for a, b in (x.split() for x in file.read().splitlines() if x))
    return [piece for _, piece in ranked]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables (word, lang, n) that add up to how often each word occurs.

    Texts share most of their words, so counts of many slices are merged before
    they are handed on: what is held stays below about twice HELD_BYTES.
    """
    held: list[pa.Table] = []
    merged = 0
    for rows, _, _ in arrays.slices(batches):
        ends, words, index = _words(rows)
        coded = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        langs = coded.dictionary
        of = np.repeat(np.asarray(coded.indices), np.diff(ends))
        cells, n = np.unique(index.astype(np.int64) * len(langs) + of, return_counts=True)
        word, lang = np.divmod(cells, max(1, len(langs)))
        columns = [words.take(pa.array(word)), langs.take(pa.array(lang)), pa.array(n, pa.int64())]
        held.append(pa.table(columns, ["word", "lang", "n"]))
        if sum(t.nbytes for t in held) > merged + HELD_BYTES:
            one = pa.concat_tables(held).group_by(["word", "lang"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            held, merged = [one], one.nbytes
            if merged > HELD_BYTES:
                yield one
                held, merged = [], 0
    if held:
        yield pa.concat_tables(held)


def fit(docs: DataFrame, pieces: list[bytes]) -> LanguageModel:
    """Learn from all rows of ``docs`` (text, lang) whose lang is not null.

    The languages are the values of lang that occur. Null texts count as empty.
    """
    named = docs.where("lang IS NOT NULL").select("text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(shared.value)
        prior = rank_prior(table.count)
        total: dict[str, np.ndarray] = {}

        def add(held: pa.Table) -> None:
            words = held.column("word").combine_chunks().dictionary_encode()
            coded = held.column("lang").combine_chunks().dictionary_encode()
            langs = coded.dictionary.to_pylist()
            cells = np.asarray(words.indices).astype(np.int64) * len(langs) + np.asarray(coded.indices)
            weights = np.bincount(cells, held.column("n").to_numpy(), minlength=len(words.dictionary) * len(langs))
            del held, cells
            arrays.give_back()
            counts = expected_counts(table, prior, words.dictionary, weights.reshape(len(words.dictionary), len(langs)))
            for k, name in enumerate(langs):
                total[name] = total.get(name, 0) + counts[:, k]

        for held in _word_counts(batches):
            add(held)
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            columns = [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "piece", "n"])
        arrays.give_back()

    found = named.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece")
    # Rounded, so that the order in which tasks are added up leaves no trace.
    found = found.agg(F.round(F.sum("n"), 3).alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    counts = np.full((len(pieces), len(languages)), SMOOTHING)
    column = np.array([languages.index(x) for x in found.column("lang").to_pylist()], dtype=int)
    counts[found.column("piece").to_numpy(), column] += found.column("n").to_numpy()
    return LanguageModel(languages, pieces, np.maximum(counts / counts.sum(axis=0), LEAST))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its probability among the model's languages (all alike beforehand).

    Null texts and texts without a letter get ``und`` and 0; so does every text
    if the model has no language. Columns of those two names are replaced; all
    others stay. Of equally probable languages the first by name is taken.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, p = shared.value
        table = Pieces(pieces)
        cache = _Cache(len(languages))
        for rows, _, _ in arrays.slices(batches):
            ends, words, index = _words(rows)
            own = cache.look_up(table, p, words)
            added = np.concatenate([np.zeros((1, len(languages))), np.cumsum(own[index], axis=0)])
            logs = added[ends[1:]] - added[ends[:-1]]
            letters = np.asarray(rows.column(len(names)).to_numpy(zero_copy_only=False), dtype=bool)
            good = letters & (len(languages) > 0)
            if languages:
                best = logs.argmax(axis=1)
                score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
            found = [languages[b] if g else UNKNOWN for b, g in zip(best, good, strict=True)]
            columns = [*rows.columns[: len(names)], pa.array(found, pa.string()), pa.array(np.where(good, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return docs.select("*", letter).mapInArrow(run, schema)

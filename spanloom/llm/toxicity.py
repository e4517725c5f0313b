"""Toxicity of texts whose insults may be disguised.

A noisy channel turns words into what is written: letters into look-alike signs
or letters of other kinds, one letter into several, a word into pieces with
spaces, signs or invisible characters between them. A written token is read as a
lattice of what it may stand for; Viterbi's algorithm finds its most probable
path under a character trigram model of the whole corpus. Tokens with one reading
only stand for themselves. Neighbouring tokens may also be pieces of one word:
the breaks between them are optional as long as their readings, one after the
other, go on spelling a word that tells of toxicity, however many pieces it has.

Workers remember what tokens stand for, over the tasks that they run, so that a
token is decoded about once per worker and not once per text.

The words so restored are scored: each word has a weight, how surely documents
with it are labelled toxic (a lower confidence bound of log-odds over the
average), a document has that of its weightiest word, and a curve learned from
the labels turns the weight into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays
from spanloom.llm.common import written

# Signs commonly written for letters.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l",
}
BETWEEN = " .-_*~/,'"
"""What may stand between the letters of one word."""
OTHER_LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
ALPHABET = " abcdefghijklmnopqrstuvwxyz" + OTHER_LATIN + "￿"
"""Symbols of the model: a word's edge, letters, and one for all other letters."""
SYMBOLS = {c: i for i, c in enumerate(ALPHABET)}
TRAIN_ROWS = 20_000
"""The scorer is fitted on about so many labelled rows, a hash of the id choosing; all of them if there are fewer."""
CONFIDENCE = 3.0
"""Standard deviations of a word's lower bound."""
LEVELS = 24
"""Steps of the curve from weights to probabilities; the last holds all weights beyond."""
TOP = 6.0
# Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("аеорсухіјѕԁһԛԝкмтвнгαορνικτυ", "aeopcyxijsdhqwkmtbhraopviktu")
CACHED_CHARS = 4_000_000
"""A worker remembers tokens of so many characters together."""
USUAL_LETTERS = 40
"""The parts of telling words up to so long are listed, longer words are searched."""
LONG_TOKEN = 1000
"""Longer tokens are decoded where they stand and not remembered."""
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN_INSIDE = re.compile("[" + re.escape("".join(SIGNS)) + "]")
_SPREAD_SIGNS = re.compile(r"^(?:[^\W_]|[@$!|+(€£])(?:[.\-_*~/,']{1,3}(?:[^\W_]|[@$!|+(€£])){2,}$")
_SIGNS_BETWEEN = re.compile("[" + re.escape(BETWEEN) + "]+")
_RUN = re.compile(r"(.)\1*")
_PLAIN = re.compile(r"[-.,;:?\"'*#~/%&=<>\[\]{}\\^`]*([a-z]+)[-.,;:?\"'*#~/%&=<>\[\]{})\\^`]*")
_REPEATED = re.compile(r"(.)\1")
_ONE_WORD = re.compile(r"\W*+([^\W\d_]{2,}+)\W*+")
_SURE = re.compile(r"(?:([a-z])(?!\1))*+")
"""Letters that stand for themselves only, from the beginning."""


class CharacterModel:
    """Interpolated trigrams: log p(c | a, b)."""

    def __init__(self, counts: np.ndarray):
        n = len(ALPHABET)
        three = counts.reshape(n, n, n).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        base = (one + 1) / (one.sum() + n)
        mid = (two + 5 * base) / (two.sum(axis=1, keepdims=True) + 5)
        full = (three + 5 * mid[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.logs = np.log(full).tolist()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of symbols over whole texts of all documents; only sums per task leave the tasks."""
    size = len(ALPHABET)
    table = np.zeros(0x10000, dtype=np.int32)
    for code in range(0x10000):
        low = chr(code).lower()
        if chr(code).isalpha():
            table[code] = SYMBOLS.get(low, size - 1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**3, dtype=np.int64)
        for _, data, offsets in arrays.slices(batches):
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            symbols = shared.value[np.minimum(codes, 0xFFFF)]
            # Texts of a run follow one another; where they meet counts as within a text, at most one word in a text.
            ends = np.concatenate([[0, 0], symbols, [0]]).astype(np.int64)
            edge = (ends[1:-1] == 0) & (ends[2:] == 0)
            context = np.where(ends[1:-1] == 0, 0, ends[:-2])  # nothing before a word's edge counts
            index = (context * size + ends[1:-1]) * size + ends[2:]
            total += np.bincount(index[~edge], minlength=size**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size**3, dtype=np.int64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def viterbi(units: Iterable[list[str]], model: CharacterModel) -> str:
    """Most probable reading of a lattice: one of the options of each unit after the other; words end at spaces.

    Time and memory grow with the number of units.
    """
    logs = model.logs
    # State (last two symbols): score and the chain of options that leads there.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*units, [" "]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in paths.items():
            for option in options:
                x, y, total = a, b, score
                for c in option:
                    s = SYMBOLS.get(c, len(ALPHABET) - 1)
                    total += logs[x][y][s] if s or y else -1e-9
                    x, y = (0, 0) if s == 0 else (y, s)
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, (chain, option))
        paths = after
    chain = max(paths.values(), key=lambda p: p[0])[1]
    found = []
    while chain is not None:
        chain, option = chain
        found.append(option)
    return "".join(reversed(found)).strip()


@lru_cache(maxsize=10_000)
def _options(sign: str, repeated: bool, spread: bool) -> list[str]:
    letters = SIGNS.get(sign, sign + folded(sign) if folded(sign) != sign else sign if sign.isalpha() else "")
    options = [c * k for c in dict.fromkeys(letters) for k in ((1, 2) if repeated else (1,))]
    return options + [o + " " for o in options] if spread else options


def lattice(written_form: str, spread: bool) -> Iterator[list[str]]:
    """Options of each run of one sign."""
    for run in _RUN.finditer(written_form):
        if options := _options(run[1], run.end() - run.start() > 1, spread):
            yield options


class _Characters(dict):
    """A table for str.translate that is filled as characters are met; it holds at most all of Unicode."""

    def __init__(self, rule: Callable[[str], str]):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        return self.setdefault(code, self.rule(chr(code)))


def _without_accent(c: str) -> str:
    plain = (d for d in unicodedata.normalize("NFKD", c) if unicodedata.category(d) != "Mn")
    return "".join(plain).translate(ALIKE)


_VISIBLE = _Characters(lambda c: "" if unicodedata.category(c) in ("Cf", "Mn") else c)
_FOLDED = _Characters(_without_accent)


def visible(token: str) -> str:
    """The token without invisible characters and marks that combine with nothing."""
    return token if token.isascii() else unicodedata.normalize("NFC", token).translate(_VISIBLE)


def folded(token: str) -> str:
    """Letters without accents, and those of other scripts as the Latin ones that they look like."""
    return token if token.isascii() else token.translate(_FOLDED)


def outline(form: str) -> str:
    """Folded letters, each run of one as one; all readings of a word of letters share it."""
    plain = folded(form)
    return _RUN.sub(r"\1", plain) if _REPEATED.search(plain) else plain


_SMALL = 0x600
"""Code points below are told apart by a table: Latin, Greek, Cyrillic, Armenian, Hebrew."""
_OTHER, _AROUND = -1, 0
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: the folded letter, 0 for what may stand around words, -1 for what needs a closer look."""
    kinds = np.full(_SMALL + 1, _OTHER, dtype=np.int64)
    for code in range(_SMALL):
        c = chr(code)
        if c.isalpha() and len(folded(c)) == 1 and unicodedata.normalize("NFC", c) == c:
            kinds[code] = ord(folded(c))
        elif not (c.isalnum() or c == "_" or unicodedata.category(c) in ("Cf", "Mn")):
            kinds[code] = _AROUND
    return kinds


def outline_hashes(tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: a hash of its word's outline, and whether it is one word of two or more such letters, with signs around it."""
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    _, at, data = tokens.buffers()
    at = np.frombuffer(at, dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at - at[0]]
    kinds = _kinds()[np.minimum(codes, _SMALL)]

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[ends[1:]] - total[ends[:-1]]

    before = np.concatenate([[_AROUND], kinds[:-1]])[: len(kinds)]
    before[ends[:-1][ends[:-1] < len(kinds)]] = _AROUND
    letter = kinds > 0
    whole = (sums((kinds == _OTHER).astype(np.int64)) == 0) & (sums((letter & (before <= 0)).astype(np.int64)) == 1)
    whole &= sums(letter.astype(np.int64)) > 1
    kept = letter & (kinds != before)
    number = np.cumsum(kept)
    first = np.repeat(np.concatenate([[0], number])[ends[:-1]], np.diff(ends))
    places = np.where(kept, number - first, 0)
    powers = np.cumprod(np.full(int(places.max(initial=0)) + 1, _FACTOR, dtype=np.uint64))
    values = np.where(kept, arrays.mix(kinds.astype(np.uint64)) * powers[places], np.uint64(0))
    return sums(values), whole


def _inner(token: str, before: str, after: str) -> str:
    """The token from its first to its last letter, digit, underscore, or sign of those given."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] == "_" or token[a] in before):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] == "_" or token[b - 1] in after):
        b -= 1
    return token[a:b]


def _without_tail(token: str) -> str:
    """The token without signs of punctuation at its end, or one sign there that is repeated."""
    kept = len(token.rstrip("!|+(.,;:?"))
    last = token[-1:]
    if last and not (last.isalnum() or last == "_"):
        alone = len(token.rstrip(last))
        if len(token) - alone > 1:
            kept = min(kept, alone)
    return token[:kept]


def bare(token: str) -> str:
    """The token without signs around it; one sign that may be a letter stays."""
    core = _inner(token, "@$!|+(€£", "@$!|+)€£")
    return token if len(token) == 1 else core if len(core) == 1 else _inner(token, "", "")


def restored(token: str, model: CharacterModel, lexicon: Lexicon | None = None) -> list[str]:
    """Other words than its own letters that a lower-cased token may stand for; none where there is one reading.

    With a lexicon, lattices without a path to a word of it are not decoded.
    """
    edged = _inner(token, "@$!|+(€£", "@$!|+)€£")
    found = []
    for form in dict.fromkeys([_without_tail(edged), edged]):
        spread, signs, joined = False, False, form
        if not form.isalpha():
            spread = bool(_SPREAD_SIGNS.match(form))
            has_letter = any(c.isalpha() for c in form)
            signs = bool(_SIGN_INSIDE.search(form)) and (has_letter or len(form) > 3)
            joined = _SIGNS_BETWEEN.sub("", form)
            if joined != form and any(c.isalpha() for c in joined):
                found += _LETTERS.findall(joined)
        if not form or not (spread or signs or _REPEATED.search(joined) or folded(joined) != joined):
            continue
        if spread:
            form = form.translate({ord(c): None for c in BETWEEN})
            found += viterbi(lattice(form, True), model).split()
        if lexicon is None or lexicon.reads(form):
            found += viterbi(lattice(form, False), model).split()
    return found


def restored_spread(tokens: list[str], model: CharacterModel) -> list[str]:
    """Words that a row of one-character tokens may stand for, with or without breaks between them."""
    form = "".join(t for t in tokens if t not in BETWEEN)
    return viterbi(lattice(form, True), model).split() + viterbi(lattice(form, False), model).split()


class Lexicon:
    """Telling words, to ask what begins or may continue one; memory grows with their letters only."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        usual = [w for w in weights if len(w) <= USUAL_LETTERS]
        self.starts_of_usual = {w[:b] for w in usual for b in range(len(w) + 1)}
        self.parts_of_usual = {w[a:b] for w in usual for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        self.outlines_of_usual = {outline(p) for p in self.parts_of_usual}
        self.outline_hashes = np.unique(outline_hashes(pa.array(sorted(self.parts_of_usual), pa.string()))[0])
        longer = sorted(w for w in weights if len(w) > USUAL_LETTERS)
        self.sorted, self.longer = longer, "\n".join(longer)
        self.next_letters: dict[str, int] = {}
        self.next_pairs: dict[str, int] = {}
        for w in weights:
            for i in range(len(w)):
                self.next_letters[w[:i]] = self.next_letters.get(w[:i], 0) | _bit(w[i])
                self.next_pairs[w[:i]] = self.next_pairs.get(w[:i], 0) | (_bit(w[i : i + 2]) if i + 1 < len(w) else 0)

    def holds(self, form: str) -> bool:
        """Whether some telling word contains it."""
        return form in self.parts_of_usual or form in self.longer

    def excludes(self, letters: str) -> bool:
        """Whether no telling word can contain any reading of the letters."""
        if self.longer or outline(letters) in self.outlines_of_usual:
            return False
        # A letter that folds into several has not the same outline doubled or not.
        return letters.isascii() or len(folded(letters)) == len(letters)

    def excluded(self, tokens: pa.StringArray) -> np.ndarray:
        """Which tokens are one word that :meth:`excludes` rules out, as far as hashes tell."""
        if self.longer or not len(self.outline_hashes):
            return np.zeros(len(tokens), dtype=bool)
        hashes, whole = outline_hashes(tokens)
        at = np.minimum(np.searchsorted(self.outline_hashes, hashes), len(self.outline_hashes) - 1)
        return whole & (self.outline_hashes[at] != hashes)

    def begins(self, form: str) -> bool:
        if form in self.starts_of_usual:
            return True
        at = bisect_left(self.sorted, form)
        return at < len(self.sorted) and self.sorted[at].startswith(form)

    def _paths(self, form: str, possible: Callable[[str], bool]) -> set[str]:
        """Readings of a written form all of whose beginnings are possible."""
        sure = _SURE.match(form)[0]
        if sure and not possible(sure):
            return set()
        forms = {sure}
        for options in lattice(form[len(sure) :], False):
            forms = {g for f in forms for o in options if possible(g := f + o)}
            if not forms:
                break
        return forms - {""}

    def reads(self, form: str) -> bool:
        """Whether some path of the form's lattice is a telling word."""
        return any(f in self.weights for f in self._paths(form, self.begins))

    def parts(self, form: str) -> set[str]:
        """Readings of the form's lattice that some telling word contains."""
        return self._paths(form, self.holds)


def _bit(letters: str) -> int:
    """One of 63 bits."""
    code = 0
    for c in letters:
        code = code * 31 + ord(c)
    return 1 << code % 63


class Token(NamedTuple):
    """What a written token stands for."""

    words: tuple[str, ...]
    """Its letters, and what Viterbi's algorithm restores."""
    bare: str
    weight: float
    """Of its weightiest word."""
    pieces: tuple[str, ...]
    """Readings that some telling word contains."""
    lettered: bool
    """It has a letter, so that rows of mere numbers spell nothing."""
    begins: bool
    """One of them begins a telling word."""
    next_letters: int = 0
    """Bits of the letters with which telling words go on after a piece."""
    next_pairs: int = 0
    """Bits of the two letters with which they go on."""
    letters: int = 0
    """Bits of pieces of one letter."""
    pairs: int = 0
    """Bits of the first two letters of longer pieces."""


NOTHING = Token((), "", 0.0, (), True, False)
"""A token that tells nothing and is no piece of what does."""


class Reader:
    """Words of whole texts, own and restored; remembers tokens it has met. Without weights, to learn, it keeps all words."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float] | None = None):
        self.model = CharacterModel(counts)
        self.lexicon = None if weights is None else Lexicon(weights)
        self.cached: dict[str, Token] = {}
        self.chars = 0

    def token(self, written_form: str) -> Token:
        found = self.cached.get(written_form)
        if found is None:
            found = self._described(written_form)
            if len(written_form) <= LONG_TOKEN:
                self.chars += len(written_form)
                if self.chars > CACHED_CHARS:
                    self.cached.clear()
                    self.chars = len(written_form)
                self.cached[written_form] = found
        return found

    def _described(self, written_form: str) -> Token:
        lexicon = self.lexicon
        plain = _PLAIN.fullmatch(written_form)
        if plain and len(plain[1]) > 1 and not _REPEATED.search(plain[1]):
            core, words = plain[1], (plain[1],)
            pieces = {core} if lexicon and lexicon.holds(core) else set()
        else:
            seen = visible(written_form)
            one = _ONE_WORD.fullmatch(seen) if lexicon else None
            if one and one[1].isalpha() and lexicon.excludes(one[1]):
                return NOTHING
            words = tuple(dict.fromkeys([*_LETTERS.findall(seen), *restored(seen, self.model, lexicon)]))
            core = bare(seen)
            pieces = {w for w in [core, folded(core), *words] if w and lexicon.holds(w)} if lexicon else set()
            if lexicon and (core.isalpha() or all(c.isalpha() or c in SIGNS or c in BETWEEN for c in core)):
                pieces |= lexicon.parts(core)
        if not lexicon:
            return Token(words, core, 0.0, (), False, False)
        weight = max((lexicon.weights.get(w, 0.0) for w in words), default=0.0)
        if not weight and not pieces and len(core) != 1:
            return NOTHING
        lettered = any(c.isalpha() for c in core)
        bits = [0, 0, 0, 0]
        for w in pieces:
            own = (lexicon.next_letters.get(w, 0), lexicon.next_pairs.get(w, 0), _bit(w) if len(w) == 1 else 0, _bit(w[:2]) if len(w) > 1 else 0)
            bits = [a | b for a, b in zip(bits, own, strict=True)]
        return Token(words, core, weight, tuple(sorted(pieces)), lettered, any(lexicon.begins(w) for w in pieces), *bits)

    def _tokens(self, distinct: pa.StringArray) -> list[Token]:
        if self.lexicon is None:
            return [self.token(t) for t in distinct.to_pylist()]
        tokens = [NOTHING] * len(distinct)
        left = np.flatnonzero(~self.lexicon.excluded(distinct))
        for i, t in zip(left.tolist(), distinct.take(pa.array(left)).to_pylist(), strict=True):
            tokens[i] = self.token(t)
        return tokens

    def joined(self, rows: int, ends: np.ndarray, tokens: list[Token], index: np.ndarray) -> list[list[str]]:
        """Telling words whose pieces are neighbouring tokens, per text."""
        found: list[list[str]] = [[] for _ in range(rows)]
        bits, begins = np.zeros((len(tokens) + 1, 4), dtype=np.int64), np.zeros(len(tokens) + 1, dtype=bool)
        for i, t in enumerate(tokens):
            if t.pieces:
                bits[i], begins[i] = t[-4:], t.begins
        begins = begins[index]
        # Where the first piece may go on with the next token's: by bits of letters, a shared one is no proof yet.
        after, pairs_after, letters, pairs = (bits[index, i] for i in range(4))
        goes_on = begins[:-1] & (((after[:-1] & letters[1:]) | (pairs_after[:-1] & pairs[1:])) != 0)
        lexicon = self.lexicon
        starts = np.flatnonzero(goes_on)
        for at, text in zip(starts.tolist(), (np.searchsorted(ends, starts, side="right") - 1).tolist(), strict=True):
            forms = {p for p in tokens[index[at]].pieces if lexicon.begins(p)}
            lettered = tokens[index[at]].lettered
            for i in range(at + 1, int(ends[text + 1])):
                forms = {g for f in forms for p in tokens[index[i]].pieces if lexicon.begins(g := f + p)}
                if not forms:
                    break
                lettered |= tokens[index[i]].lettered
                if lettered:
                    found[text] += [f for f in forms if f in lexicon.weights]
        return found

    def read(self, rows: pa.RecordBatch) -> tuple[np.ndarray, list[Token], np.ndarray, list[list[str]]]:
        """Ends of each text's tokens, the distinct tokens, every token's number, and words of spread-out rows per text."""
        texts = rows.column(rows.schema.get_field_index("text")).fill_null("")
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        index, tokens = np.asarray(coded.indices), self._tokens(coded.dictionary)
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        single = np.array([len(t.bare) == 1 for t in tokens], dtype=bool)[index] if len(tokens) else np.zeros(0, dtype=bool)
        spread: list[list[str]] = [[] for _ in range(len(rows))]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            for text in range(int(np.searchsorted(ends, a, side="right")) - 1, int(np.searchsorted(ends, b, side="left"))):
                own = index[max(a, ends[text]) : min(b, ends[text + 1])]
                if len(own) > 1:
                    spread[text] += restored_spread([tokens[i].bare for i in own], self.model)
        return ends, tokens, index, spread


_held: list = [None, None]


def _reader(shared, counts: np.ndarray, weights: dict[str, float] | None) -> Reader:
    """The reader of this worker for a broadcast value; tasks that follow one another share it."""
    if _held[0] is not shared:
        _held[:] = [shared, Reader(counts, weights)]
    return _held[1]


class ToxicityModel(NamedTuple):
    counts: np.ndarray
    """Trigrams of symbols."""
    weights: dict[str, float]
    """Words that tell of toxicity."""
    curve: np.ndarray
    """Probability by level of weight."""


def _levels(weights: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(weights / TOP * (LEVELS - 1)), LEVELS - 1).astype(int)


def _document_weights(reader: Reader, rows: pa.RecordBatch) -> tuple[np.ndarray, list[list[str]]]:
    ends, tokens, index, spread = reader.read(rows)
    weights = reader.lexicon.weights
    of = np.array([t.weight for t in tokens] + [0.0])
    found = np.maximum.reduceat(np.append(of[index], 0.0), ends[:-1]) if len(rows) else np.zeros(0)
    found = np.where(ends[1:] > ends[:-1], found, 0.0)
    telling = [set() for _ in range(len(rows))]
    for at in np.flatnonzero(of[index] > 0):
        text = int(np.searchsorted(ends, at, side="right")) - 1
        telling[text].update(w for w in tokens[index[at]].words if w in weights)
    joined = reader.joined(len(rows), ends, tokens, index)
    for i, words in enumerate(spread):
        for w in [*words, *joined[i]]:
            if w in weights:
                found[i] = max(found[i], weights[w])
                telling[i].add(w)
    return found, [sorted(x) for x in telling]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from the rows of ``labels`` (doc_id, toxic) that have a label and a text in ``docs``.

    The character model covers all of ``docs``. Words and curve are fitted on
    about ``train_rows`` labelled texts (a bound of the sample, by a hash of the
    text); equal texts count once and are toxic if most of their labels say so.
    """
    counts = trigram_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    many = labels.count()
    threshold = int((min(1.0, train_rows / many) if many else 1.0) * 2**31)
    chosen = docs.select("doc_id", "text").join(labels, "doc_id")
    chosen = chosen.withColumn("hash", F.xxhash64("text")).where(F.col("hash").bitwiseAND(2**31 - 1) < threshold)
    kinds = chosen.groupBy("hash").agg(F.first("text").alias("text"), F.avg("toxic").alias("toxic"))
    sample = written(kinds.select("text", (F.col("toxic") > 0.5).cast("int").alias("toxic")), "labelled-texts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value, shared.value, None)
        for rows, _, _ in arrays.slices(batches):
            ends, tokens, index, spread = reader.read(rows)
            toxic = rows.column(rows.schema.get_field_index("toxic")).to_pylist()
            seen: dict[str, list[int]] = {}
            for i, label in enumerate(toxic):
                words = {w for t in set(index[ends[i] : ends[i + 1]].tolist()) for w in tokens[t].words}
                for w in words.union(spread[i]):
                    seen.setdefault(w, [0, 0])[label] += 1
            values = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())],
                ["word", "toxic", "clean"],
            )

    average = sample.agg(F.avg("toxic")).first()[0] or 0.0
    average = min(max(average, 1e-4), 1 - 1e-4)
    z2 = CONFIDENCE**2
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    spread = CONFIDENCE * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    lower = (share + z2 / (2 * n) - spread) / (1 + z2 / n)
    words = sample.mapInArrow(read, "word string, toxic long, clean long").groupBy("word")
    words = words.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(n > 1)
    weight = F.log(lower / (1 - lower)) - math.log(average / (1 - average))
    # Bounded by the sample: no more words than its texts have.
    found = words.select("word", weight.alias("weight")).where("weight > 0").toArrow()
    weights = dict(zip(found.column("word").to_pylist(), found.column("weight").to_pylist(), strict=True))
    shared_both = docs.sparkSession.sparkContext.broadcast((counts, weights))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared_both.value, *shared_both.value)
        for rows, _, _ in arrays.slices(batches):
            found, _ = _document_weights(reader, rows)
            label = rows.column(rows.schema.get_field_index("toxic"))
            yield pa.RecordBatch.from_arrays([pa.array(_levels(found)), label], ["level", "toxic"])

    tallies = sample.mapInArrow(weigh, "level long, toxic int").groupBy("level").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    toxic, total = np.zeros(LEVELS), np.zeros(LEVELS)
    for row in tallies.collect():
        toxic[row["level"]], total[row["level"]] = row["t"], row["n"]
    return ToxicityModel(counts, weights, rising(toxic + 2 * average, total + 2))


def rising(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares that never fall, by pooling neighbours that do."""
    pools: list[list[float]] = []
    for g, t in zip(good, total, strict=True):
        pools.append([g, t, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), g / t) for g, t, n in pools])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, telling array<string>) for every row: the probability of being toxic, and the words that tell.

    Whole texts are read. Null and empty texts have the score of texts without
    any telling word; equal texts have equal scores. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, curve = shared.value
        reader = _reader(shared.value, counts, weights)
        for rows, _, _ in arrays.slices(batches):
            found, telling = _document_weights(reader, rows)
            # Within a level heavier weights rank higher, by less than levels differ.
            value = np.clip(curve[_levels(found)] + np.minimum(found, TOP) * 1e-6, 0.0, 1.0)
            columns = [rows.column(0), pa.array(value), pa.array(telling, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "telling"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, telling array<string>")

"""The reader's short cuts change nothing: tokens and pieces against plain search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import toxicity

WORDS = {"stupid": 3.0, "idiot": 3.0, "moron": 2.0, "straße": 1.0, "éleve": 1.0, "trash": 2.0, "worthless": 2.0, "œuf": 1.0}
SIGNS = ["", "", "", ".", ",", "!", "!!", "(", "$", "&&&", "'", "​", "-", "́", "7", "_"]


@pytest.fixture(scope="module")
def reader():
    counts = np.zeros(len(toxicity.ALPHABET) ** 3, dtype=np.int64)
    return toxicity.Reader(counts, WORDS)


def tokens(seed):
    rng = random.Random(seed)
    letters = "stupidomranehwlßéœǆаСüŉﬁ汉1@"
    for _ in range(400):
        word = rng.choice(list(WORDS))
        a, b = sorted((rng.randrange(len(word) + 1), rng.randrange(len(word) + 1)))
        part = list(word[a:b]) or [rng.choice(letters)]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(part))
            part[i] = rng.choice([part[i] * 2, rng.choice(letters), part[i] + rng.choice(SIGNS), part[i].upper().lower()])
        yield rng.choice(SIGNS) + "".join(part) + rng.choice(SIGNS)
    yield from ["", "a", "xy", "zzzz", "st" * 5000, "x" * 50_000, "x." * 9_000, "汉字", "é" * 3000]


@pytest.mark.parametrize("seed", range(5))
def test_excluded_tokens_tell_nothing(reader, seed, monkeypatch):
    some = list(tokens(seed))
    excluded = reader.lexicon.excluded(pa.array(some, pa.string()))
    assert 5 < excluded.sum() < len(some)
    monkeypatch.setattr(toxicity.Lexicon, "excludes", lambda self, letters: False)
    for token, out in zip(some, excluded, strict=True):
        found = reader._described(token)
        if out:
            assert not found.weight and not found.pieces and len(found.bare) != 1, token


@pytest.mark.parametrize("seed", range(5))
def test_own_exclusion_agrees(reader, seed, monkeypatch):
    some = list(tokens(seed))
    quick = [reader._described(t) for t in some]
    monkeypatch.setattr(toxicity.Lexicon, "excludes", lambda self, letters: False)
    assert quick == [reader._described(t) for t in some]


@pytest.mark.parametrize("seed", range(5))
def test_neighbours_are_joined_as_by_plain_search(reader, seed):
    rng = random.Random(seed)
    pieces = [p for w in WORDS for p in (w[:2], w[2:4], w[4:], w[:3], w[3:], w[0], w[1:])] + ["tare", "vo", "1"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", "st up id", "s t u p id"]
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    ends, found, index, _ = reader.read(rows)
    joined = reader.joined(len(texts), ends, found, index)
    for text, words in zip(texts, joined, strict=True):
        parts = [reader.token(t).pieces for t in text.split()]
        wanted = set()
        for a in range(len(parts)):
            forms = set(parts[a])
            for b in range(a + 1, len(parts)):
                forms = {f + p for f in forms for p in parts[b] if any(w.startswith(f + p) for w in WORDS)}
                wanted |= forms & set(WORDS)
        assert set(words) == wanted, text


def test_no_tokens(reader):
    assert not len(reader.lexicon.excluded(pa.array([], pa.string())))
    assert reader.read(pa.RecordBatch.from_arrays([pa.array([None, "", " "], pa.string())], ["text"]))[0].tolist()[-1] >= 0

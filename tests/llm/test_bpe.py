from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanloom.llm import bpe
from spanloom.llm.queries import bpe_digests, vocabulary
from tests.llm import brute

MODEL, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as model, open(RANKS, "rb") as ranks:
        return bpe.Encoder(model.read(), ranks.read())


def test_digests_match_the_library(odd_docs, odd_rows, reference, spark):
    extra = [(900, "<|endoftext|> in a text<|endoftext|>"), (901, "日本語の文。 emoji 🎉 ok"), (902, " " * 5_000 + "x")]
    shared = " ".join(f"word{i}" for i in range(2_000))
    extra += [(910 + i, f"{i} {shared} {i}") for i in range(5)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    expected = []
    for doc_id, text in [*odd_rows, *extra]:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), brute.sha256(",".join(map(str, ids))), brute.sha256(decoded)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, bpe_digests(docs).collect()), key=key) == sorted(expected, key=key)


def test_no_rows_no_result(no_docs):
    assert bpe_digests(no_docs).count() == 0


def test_fast_encoder_agrees_on_every_plain_code_point(encoder, reference):
    for code in range(0x250):
        for text in (f"a{chr(code)}b", f"{chr(code)}{chr(code)} x{chr(code)}", f" {chr(code)}1'{chr(code)}s"):
            assert encoder(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_any_cut_is_repaired(encoder, reference):
    rng = random.Random(2)
    pieces = ["the ", "they're ", "  \n", "isn't", "123 ", "x", "élan ", "<|endoftext|>", " - ", "\n\n\n", "'", "re"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        begins = sorted({0, *(len(text[: rng.randrange(len(text))].encode()) for _ in range(rng.randrange(5)))})
        ends = [*begins[1:], len(data)]
        known = {i: encoder(data[a:b]) for i, (a, b) in enumerate(zip(begins, ends, strict=True)) if rng.random() < 0.7}
        ids = bpe.assemble(encoder, data, np.array(begins), known)
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_shared_passages_are_cut_alike():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    one, two = rng.integers(97, 123, 3_000).astype(np.uint8), rng.integers(97, 123, 777).astype(np.uint8)
    data = np.concatenate([one, passage, two, passage])
    offsets = np.array([0, len(one) + len(passage), len(data)])
    begins = bpe.cuts(data, offsets)
    first = {int(b) - len(one) for b in begins if len(one) + bpe.WINDOW < b < offsets[1]}
    second = {int(b) - offsets[1] - len(two) for b in begins if b > offsets[1] + len(two) + bpe.WINDOW}
    assert first == second and first

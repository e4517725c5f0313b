"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over 32 bytes cuts every text where the bytes themselves say so,
hence passages that documents share are mostly cut alike. Chunks that occur more
than once are encoded once; their ids are joined back to the documents.

A chunk's ids need not be those the whole text has there, as the cut may fall
inside a word. Joins are repaired on the text between *safe* places: where a
space or line feed follows a visible ASCII character, every pre-token of the
byte-level pattern ends. The stretch around a join, from the second safe place
before it to the second after it, is encoded again; where it agrees with the
chunk's ids up to the first safe place on each side, the rest of the chunk
agrees too. A text whose stretches do not agree is encoded whole. Chunks of
their own document only are encoded along with such stretches.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays, bloom
from spanloom.llm.common import KEY, row_key, written

WINDOW = 32
CHUNK_BITS = 10
"""log2 of a chunk's mean length in bytes."""
SAFE_LAST_BYTE = 0xC9
LONG_RUN = 4000
"""Texts with a later code point than U+027F, or without a safe place for so long, go to the reference encoder."""

_GEAR = arrays.mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)
_SPACE = arrays.flags((0x20, 0x20), (0x0A, 0x0A))
_VISIBLE = arrays.flags((0x21, 0x7E))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a chunk begins, the beginnings of non-empty texts included."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    text = np.searchsorted(offsets, at - 1, side="right") - 1
    at = at[(at - offsets[text] >= WINDOW) & (at < offsets[text + 1])]
    at = at[(data[at] & 0xC0) != 0x80]
    return np.union1d(at, offsets[:-1][offsets[:-1] < offsets[1:]])


def safe_places(text: np.ndarray) -> np.ndarray:
    inner = np.flatnonzero(_SPACE[text[1:]] & _VISIBLE[text[:-1]]) + 1
    return np.concatenate([[0], inner, [len(text)]])


class Encoder:
    """Whole pieces of text to ids, as the tokenizer file says.

    Plain texts go to a faster library that has the same vocabulary; it is used
    for code points only whose classes no Unicode version changed.
    """

    def __init__(self, model: bytes, ranks: bytes):
        import tiktoken

        self.model, self.exact = model, None
        described = json.loads(model)
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # Fixed value: the byte-level pattern of the vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        self.lengths = np.zeros(max([*table.values(), *special.values()]) + 1, dtype=np.int64)
        for token, i in [*table.items(), *((k.encode(), v) for k, v in special.items())]:
            self.lengths[i] = len(token)

    def __call__(self, piece: np.ndarray, safe: np.ndarray | None = None) -> np.ndarray:
        if not len(piece):
            return np.zeros(0, dtype=np.int64)
        text = piece.tobytes().decode()
        safe = safe_places(piece) if safe is None else safe
        if piece.max() <= SAFE_LAST_BYTE and np.diff(safe).max() <= LONG_RUN:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    @property
    def slow(self):
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_buffer(self.model)
            self.exact.no_truncation()
            self.exact.no_padding()
        return self.exact

    def part(self, ids: np.ndarray, begin: int, end: int) -> np.ndarray | None:
        """The ids of the bytes from ``begin`` to ``end``; None where no token ends there."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        a, b = np.searchsorted(ends, [begin, end])
        return ids[a:b] if b < len(ends) and ends[a] == begin and ends[b] == end else None


def assemble(encoder: Encoder, text: np.ndarray, begins: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Ids of a text from those of its known chunks (by number)."""
    safe = safe_places(text)
    if not known:
        return encoder(text, safe)
    ends = np.append(begins[1:], len(text))
    stretches: list[list[int]] = []

    def again(left: int, right: int) -> None:
        a = max(np.searchsorted(safe, left, side="right") - 2, 0)
        b = min(np.searchsorted(safe, right, side="left") + 1, len(safe) - 1)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], b)
        else:
            stretches.append([a, b])

    for i in range(len(begins)):
        if i not in known:
            again(begins[i], ends[i])
        elif i and i - 1 in known:
            again(begins[i], begins[i])
    out, done = [], 0

    def kept(begin: int, end: int) -> np.ndarray | None:
        """Known ids from ``begin`` to ``end``; both lie in one chunk unless it ends at a text's end."""
        i = int(np.searchsorted(begins, begin, side="right")) - 1
        if begin >= end:
            return np.zeros(0, dtype=np.int64)
        return encoder.part(known[i], begin - begins[i], end - begins[i]) if i in known and end <= ends[i] else None

    for a, b in stretches:
        left, right = int(safe[a]), int(safe[b])
        fresh = encoder(text[left:right])
        before = kept(done, left)
        if before is None:
            return encoder(text, safe)
        # Agreement of what was encoded twice: the outermost stretches on either side.
        for x, y in ((a, a + 1), (b - 1, b)):
            if (x == 0 and y == a + 1) or (y == len(safe) - 1 and x == b - 1):
                continue
            old, new = kept(int(safe[x]), int(safe[y])), encoder.part(fresh, int(safe[x]) - left, int(safe[y]) - left)
            if old is None or new is None or not np.array_equal(old, new):
                return encoder(text, safe)
        out += [before, fresh]
        done = right
    last = kept(done, len(text))
    if last is None:
        return encoder(text, safe)
    return np.concatenate([*out, last])


def _hash(piece: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(piece.tobytes())


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in arrays.slices(batches):
        begins = cuts(data, offsets)
        ends = np.append(begins[1:], len(data))
        hashes = [_hash(data[a:b]) for a, b in zip(begins, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary())], ["chunk"])


def _half(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(h[:8] for h in hashes), dtype=np.uint64)


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(chunk): 128-bit hashes of the chunks that occur more than once."""
    found = docs.select("text").mapInArrow(_chunk_hashes, "chunk binary")
    return found.groupBy("chunk").count().where("count > 1").select("chunk")


def _texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, text, key) of the documents with a chunk that the field may hold."""
    names = ["doc_id", "text", *KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            yield rows.filter(pa.array(_any_shared(data, offsets, wanted)))

    docs = docs.select("doc_id", "text", *row_key()).select(names)
    return docs.mapInArrow(run, docs.schema)


def _any_shared(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Flags of the texts with a chunk that the field may hold."""
    begins = cuts(data, offsets)
    ends = np.append(begins[1:], len(data))
    hashes = [_hash(data[a:b]) for a, b in zip(begins, ends, strict=True)]
    hit = begins[bloom.holds(wanted, _half(hashes))] if hashes else begins
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[np.searchsorted(offsets, hit, side="right") - 1] = True
    return out


def _occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(key, place, chunk, piece): where chunks the field may hold occur; each task tells a chunk's text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for rows, data, offsets in arrays.slices(batches):
            begins = cuts(data, offsets)
            ends = np.append(begins[1:], len(data))
            hashes = [_hash(data[a:b]) for a, b in zip(begins, ends, strict=True)]
            hit = np.flatnonzero(bloom.holds(wanted, _half(hashes))) if hashes else np.zeros(0, dtype=int)
            text = np.searchsorted(offsets, begins, side="right") - 1
            first = np.searchsorted(begins, offsets[text])
            pieces = []
            for i in hit:
                pieces.append(None if hashes[i] in told else data[begins[i] : ends[i]].tobytes().decode())
                told.add(hashes[i])
            keys = [rows.column(rows.schema.get_field_index(k)).take(pa.array(text[hit])) for k in KEY]
            columns = [pa.array(hit - first[hit]), pa.array([hashes[i] for i in hit], pa.binary()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(keys + columns, [*KEY, "place", "chunk", "piece"])

    return docs.select("text", *row_key()).mapInArrow(
        run, "key_id long, key_hash long, key_size long, place long, chunk binary, piece string"
    )


def encode(docs: DataFrame, model: str, ranks: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row: its text's token ids.

    ``model`` is the path of a byte-level tokenizer file, ``ranks`` that of the
    same vocabulary as ranks; both are read by the driver and handed to the
    tasks. Special tokens in a text get their ids; none are added. A null text
    is encoded as an empty one, without ids. Rows that agree in doc_id and text
    are all returned, alike. Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    files = []
    for path in (model, ranks):
        with open(path, "rb") as file:
            files.append(file.read())
    files = context.broadcast(tuple(files))
    docs = docs.select(F.col("doc_id"), F.col("text"))

    shared = written(shared_chunks(docs), "shared-chunks")
    wanted = bloom.build(shared.mapInArrow(_halves, "half long"), "half")
    places = written(_occurrences(docs, wanted), "occurrences")
    pieces = places.where("piece IS NOT NULL").join(shared, "chunk", "left_semi")
    pieces = pieces.groupBy("chunk").agg(F.first("piece").alias("piece"))

    largest = max(json.loads(files.value[0])["model"]["vocab"].values(), default=0)
    width = np.uint16 if largest + 1000 < 2**16 else np.uint32  # as stored between the stages

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files.value)
        for rows, data, offsets in arrays.slices(batches, "piece"):
            ids = [encoder(data[a:b]).astype(width).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    tokens = written(pieces.mapInArrow(encode_pieces, "chunk binary, ids binary"), "chunk-tokens")
    known = (
        places.drop("piece")
        .join(tokens, "chunk")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("place", "ids")).alias("known"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files.value)
        for rows, data, offsets in arrays.slices(batches):
            begins = cuts(data, offsets)
            lists = rows.column(rows.schema.get_field_index("known"))
            ids = []
            for i in range(len(rows)):
                a, b = offsets[i], offsets[i + 1]
                own = begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a
                parts = lists[i].as_py() or ()
                chunks = {p["place"]: np.frombuffer(p["ids"], dtype=width).astype(np.int64) for p in parts}
                ids.append(assemble(encoder, data[a:b], own, chunks))
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(ids)], ["doc_id", "ids"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files.value)
        for rows, data, offsets in arrays.slices(batches):
            whole = np.flatnonzero(~_any_shared(data, offsets, wanted))
            ids = [encoder(data[offsets[i] : offsets[i + 1]]) for i in whole]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(whole)), _lists(ids)], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    # Only texts with shared chunks are shuffled; the others are encoded where they are read.
    joined = _texts(docs, wanted).join(known, KEY, "left").select("doc_id", "text", "known").mapInArrow(finish, schema)
    return docs.mapInArrow(alone, schema).union(joined)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(0, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves = _half(batch.column(0).to_pylist()) if len(batch) else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(halves.view(np.int64))], ["half"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text the ids stand for, special tokens included.

    Bytes that are no UTF-8 become replacement characters; null ids give null.
    """
    with open(model, "rb") as file:
        described = json.loads(file.read())
    # Fixed value: the byte-level alphabet writes visible Latin-1 bytes as themselves and the others from U+0100 on.
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = {i: bytes(byte_of[c] for c in token) for token, i in described["model"]["vocab"].items()}
    tokens |= {x["id"]: x["content"].encode() for x in described["added_tokens"]}
    tokens = encoded.sparkSession.sparkContext.broadcast([tokens.get(i, b"") for i in range(max(tokens) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            for begin in range(0, len(batch), 500):
                rows = batch.slice(begin, 500)
                texts = []
                for ids in rows.column(1):
                    own = None if not ids.is_valid else ids.values.to_numpy().tolist()
                    texts.append(None if own is None else b"".join([table[i] for i in own]).decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")

"""N-gram Jaccard join by parity sketches.

A document's set of distinct word n-grams is hashed into a bit sketch: each
n-gram flips one bit. Two sets whose symmetric difference has d members have
sketches at a Hamming distance of at most d. A sketch is cut into m blocks, and
an n-gram flips a bit of one block only, so at least m - d blocks are equal.

For sizes s <= t, similarity >= p/q means d <= s * (q - p) / p. Sets are grouped
into bands by the smaller size; m exceeds the largest d of the band, so a true
pair agrees in some block. The smaller set *probes* with just d + 1 of its
blocks, the fullest ones (d of them may differ, one must agree); the larger is
*indexed* under all blocks of every band its partner may be in. Nearly empty
blocks, which many unrelated sets share, are so indexed but hardly ever probed.

Equal sets are one node from the start. Nodes that share a block are candidates:
all holders of the blocks of which one node is the first holder are a group. Groups,
cut by size so that only sizes that may be similar meet,
are compared in chunks of bounded rows and bytes: by the Hamming distance of
whole sketches first, a few bits per n-gram, and only what these leave similar to
something in its chunk goes there once more with its whole set. A chunk keeps to itself, without
emitting pairs, what is connected already, and returns links only. Groups of
several chunks are compared in two steps: each chunk in itself and with the most
connected nodes of the group; then, only what is still apart from most of its
group, with all of it. So no link is missed that could join two components, and
a large group of near copies costs about a comparison per member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrays, bloom
from spanloom.llm.arrays import U64
from spanloom.llm.common import KEY, packed, row_key, written
from spanloom.llm.components import components

WORD_BYTES = ~arrays.flags((0x20, 0x20), (0x09, 0x0D))
BLOCK_BITS = 16
"""log2 of the bits in a block of the sketch."""
BAND_RATIO = 1.6
SPARE = 0.1
"""Blocks beyond d + 1, as a share of them: what a probe may leave out."""
NO_ID = -(2**63)
SKETCH_RATIO = 2
"""Bits per member, at least, of the whole sketch by which two sets are compared first."""
BUCKET_KEYS = 4_000_000
"""Keys that are looked through for repeats at once, in numpy."""
CHUNK_ROWS = 140
CHUNK_BYTES = 8_000_000
"""A chunk holds about so many nodes and bytes of sets, or one larger set."""
LATE = 4
"""Chunks taken together in the second step, where each is sent to all others."""
CENTRES = 8
"""Most connected nodes of a group that every chunk of it is compared with."""


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams, sorted; a text of fewer words is one n-gram."""
    starts, ends, text = arrays.spans(data, offsets, WORD_BYTES)
    lowered = arrays.LOWER[data]
    words = arrays.span_hashes(lowered, starts, ends)
    if not len(words):
        return text, words
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    left = count[text] - (np.arange(len(text)) - first[text])  # words from this one to the end
    keep = (left >= n) | ((left == count[text]) & (count[text] < n))
    at = np.flatnonzero(keep)
    hashes = np.minimum(left[at], n).astype(U64)
    for i in range(n):
        more = left[at] > i
        word = words[np.minimum(at + i, len(words) - 1)]
        hashes = arrays.mix(hashes * U64(0x9E3779B97F4A7C15) + np.where(more, word, U64(0)))
    text = text[at]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


class Bands:
    """Bands of set sizes for similarity >= above / below."""

    def __init__(self, above: int, below: int):
        self.above, self.below = above, below
        edges, d = [1], []
        while edges[-1] < 2**40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
            d.append(self.difference(edges[-1] - 1))
        self.edges = np.array(edges)
        self.blocks = np.array([x + 1 + max(1, int(SPARE * (x + 1))) if x else 0 for x in d])

    def difference(self, smaller):
        """Largest symmetric difference of a pair whose smaller set has so many members."""
        return smaller * (self.below - self.above) // self.above

    def of(self, size):
        return np.searchsorted(self.edges, size, side="right") - 1


def sketch_keys(text: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key): the lowest bit of a key is 1 where the text probes."""
    found_text, found_key = [], []
    own = bands.of(np.maximum(sizes, 1))
    smallest = -(-sizes * bands.above // bands.below)
    bit = arrays.mix(hashes) & U64(2**BLOCK_BITS - 1)
    flipped = arrays.mix(bit + U64(1))
    for lower in range(int((own - bands.of(np.maximum(smallest, 1))).max(initial=0)) + 1):
        band = own - lower
        blocks = np.where((sizes > 0) & (band >= bands.of(np.maximum(smallest, 1))), bands.blocks[np.maximum(band, 0)], 0)
        begin = np.concatenate([[0], np.cumsum(blocks)])
        if not begin[-1]:
            continue
        has = blocks[text] > 0
        t = text[has]
        block = begin[t] + (hashes[has] % blocks[t].astype(U64)).astype(np.int64)
        digest = np.zeros(begin[-1], dtype=U64)
        np.bitwise_xor.at(digest, block, flipped[has])
        owner = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(begin[-1]) - begin[owner]
        key = arrays.mix(digest + arrays.mix((band[owner].astype(U64) << U64(40)) + place.astype(U64) + U64(1)))
        key &= ~U64(1)
        if not lower:
            fill = np.bincount(block, minlength=begin[-1])
            order = np.lexsort((-fill, owner))
            rank = np.empty_like(order)
            rank[order] = place  # owners are in order, so ranks within each run like places
            key |= (rank <= bands.difference(sizes)[owner]).astype(U64)
        found_text.append(owner)
        found_key.append(key)
    if not found_key:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    return np.concatenate(found_text), np.concatenate(found_key)


def _runs(values: np.ndarray, text: np.ndarray, n: int) -> pa.ListArray:
    """One list of longs per text; ``text`` is sorted."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _digests(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
    np.add.at(one, text, hashes)
    np.bitwise_xor.at(two, text, arrays.mix(hashes + U64(0x5851F42D4C957F2D)))
    return arrays.mix(one), two


def whole_sketches(text: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches as 64-bit words, and the first word of each text; as many words as a power of two, none for no members.

    A longer sketch, cut into parts of a shorter one's length and XORed, is the set's sketch of that length.
    """
    words = 2 ** np.ceil(np.log2(np.maximum(sizes * SKETCH_RATIO / 64, 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(np.where(sizes > 0, words, 0))])
    bit = arrays.mix(hashes) & (words[text].astype(U64) * U64(64) - U64(1))
    sketch = np.zeros(begin[-1], dtype=U64)
    np.bitwise_xor.at(sketch, begin[text] + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return sketch, begin


def _folded(raw: list[bytes]) -> np.ndarray:
    """The sketches, one a row, at the length of the shortest."""
    words = min(map(len, raw)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(r, dtype=U64).reshape(-1, words), axis=0) for r in raw])


def nodes(docs: DataFrame, n: int, above: int, below: int) -> DataFrame:
    """(doc_id, row key, size, node, check, keys, sketch) per document.

    ``node`` and ``check`` are digests of the set; both and the size together
    tell sets apart. Documents without words have size 0, no keys and an empty sketch.
    """
    bands = Bands(above, below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            many = len(rows)
            text, hashes = shingles(data, offsets, n)
            sizes = np.bincount(text, minlength=many)
            one, two = _digests(text, hashes, many)
            owner, keys = sketch_keys(text, hashes, sizes, bands)
            order = np.argsort(owner, kind="stable")
            sketch, begin = whole_sketches(text, hashes, sizes)
            bounds = pa.py_buffer((begin * 8).astype(np.int32))
            columns = [
                *rows.columns[:4],
                pa.array(sizes.astype(np.int64)),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                _runs(keys[order], owner[order], many),
                pa.Array.from_buffers(pa.binary(), many, [None, bounds, pa.py_buffer(sketch)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *KEY, "size", "node", "check", "keys", "sketch"])

    schema = "doc_id long, key_id long, key_hash long, key_size long, size long, node long, check long, keys array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(node, set) of the documents that ``rows`` (node, rep, ...) name, and of some others."""
    context = docs.sparkSession.sparkContext
    named = context.broadcast(_field(rows.select(F.xxhash64("rep").alias("mark"))))
    field = context.broadcast(_field(rows.select(_mark())))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of other ids need no shingles."""
        for batch in arrays.parts(batches):
            kept = batch.filter(pa.array(bloom.holds(named.value, batch.column(1).to_numpy().view(U64))))
            if kept.num_rows:
                yield kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(some(batches)):
            many = len(rows)
            text, hashes = shingles(data, offsets, n)
            one, _ = _digests(text, hashes, many)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bloom.holds(field.value, one ^ ids.view(U64)) & (np.bincount(text, minlength=many) > 0))
            bounds = np.searchsorted(text, np.stack([keep, keep + 1]))
            raw = [hashes[a:b].tobytes() for a, b in bounds.T]
            yield pa.RecordBatch.from_arrays([pa.array(one[keep].view(np.int64)), pa.array(raw, pa.binary())], ["node", "set"])

    rep = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(rep.alias("rep"), F.xxhash64(rep).alias("mark"), "text").mapInArrow(run, "node long, set binary")


def _with_units(sets: DataFrame, units: DataFrame) -> DataFrame:
    """Of each node its columns of ``sets`` and the list of its units, once, whatever its repeats."""
    lists = units.groupBy("node").agg(F.collect_list(F.struct("unit", "group", "low", "role")).alias("units"))
    return sets.join(lists, "node").dropDuplicates(["node"])


def _held(rows: DataFrame, field: np.ndarray) -> DataFrame:
    """The rows (node, rep, ...) that the bit field may hold."""
    wanted = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches):
            node, rep = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
            yield batch.filter(pa.array(bloom.holds(wanted.value, node ^ rep)))

    return rows.mapInArrow(run, rows.schema)


def _mark() -> Column:
    """Names one document, or equal ones, of a node."""
    return F.col("node").bitwiseXOR(F.col("rep")).alias("mark")


def _field(hashes: DataFrame) -> np.ndarray:
    """Bit field of the one column, as large as its rows want it, or the largest."""
    return bloom.build(hashes, hashes.columns[0], bloom.bits_for(hashes.count()) or bloom.MOST_BITS)


def _short(keys: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 31 further bits of each key."""
    return keys >> U64(63 - bucket_bits), (keys & U64(2**31 - 1)).astype(np.uint32)


def _short_hash(bucket, rest: np.ndarray) -> np.ndarray:
    """Well mixed, for the bit field."""
    return arrays.mix((np.asarray(bucket).astype(U64) << U64(31)) + rest.astype(U64) + U64(1))


def _one_of_each_node(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, keys) of one document per node, and of some others: equal sets have equal keys."""
    rows = full.select("node", F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "keys")
    bits = bloom.bits_for(reps.count())
    if bits is None:
        return rows.select("node", "keys")
    # Written, not filtered by each reader anew: a task would need two Python workers at once.
    return written(_held(rows, bloom.build(reps.select(_mark()), "mark", bits)).select("node", "keys"), "single")


def _maybe_shared(single: DataFrame, bucket_bits: int) -> DataFrame:
    """(hash) of the short keys that occur more than once, and probe.

    Few keys are shared, so all of them are shuffled in 32 bits each, packed by
    bucket: 31 bits that, with the bucket, tell keys apart but for one in some
    hundreds, and whether the key probes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches):
            tagged = batch.column(0).flatten().to_numpy().view(U64)
            bucket, rest = _short(tagged >> U64(1), bucket_bits)
            order = np.argsort(bucket, kind="stable")
            rest = ((rest << np.uint32(1)) | (tagged & U64(1)).astype(np.uint32))[order]
            own, first = np.unique(bucket[order], return_index=True)
            raw = [part.tobytes() for part in np.split(rest, first[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(raw, pa.binary())], ["bucket", "rest"])

    def repeated(table: pa.Table) -> pa.Table:
        rest = np.sort(np.frombuffer(b"".join(table.column("rest").to_pylist()), dtype=np.uint32))
        begins = np.flatnonzero(np.append(True, rest[1:] >> 1 != rest[:-1] >> 1))
        ends = np.append(begins[1:], len(rest))
        # The last of equal ones probes, if any does.
        own = begins[(ends - begins > 1) & (rest[ends - 1] & 1 == 1)]
        found = _short_hash(table.column("bucket")[0].as_py(), rest[own] >> 1)
        return pa.table({"hash": pa.array(found.view(np.int64))})

    packs = single.select("keys").mapInArrow(pack, "bucket int, rest binary")
    return packs.groupBy("bucket").applyInArrow(repeated, "hash long")


def _shared_keys(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, tagged) of all keys of two nodes or more of which one probes, and of some others.

    A bit field of the keys that may be shared spares shuffling the rest. It has
    16 bits per such key; where these would fill half of its largest size, all
    keys go on to the exact aggregation.
    """
    single = _one_of_each_node(full, reps)
    # More buckets with more keys, so that one is never large.
    many = full.agg(F.sum(F.size("keys"))).first()[0] or 0
    bucket_bits = min(max(6, (many // BUCKET_KEYS).bit_length()), 24)
    maybe = written(_maybe_shared(single, bucket_bits), "maybe")
    bits = bloom.bits_for(maybe.count())
    if bits is None:
        return single.select("node", F.explode("keys").alias("tagged"))
    field = single.sparkSession.sparkContext.broadcast(bloom.build(maybe, "hash", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches):
            lists = batch.column(1)
            tagged = lists.flatten().to_numpy()
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(np.asarray(lists.offsets)))
            kept = bloom.holds(field.value, _short_hash(*_short(tagged.view(U64) >> U64(1), bucket_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(tagged[kept])], ["node", "tagged"])

    return single.select("node", "keys").mapInArrow(run, "node long, tagged long")


def _fits(x: int, sizes: np.ndarray, node: np.ndarray, low: np.ndarray, role: np.ndarray, above: int, below: int) -> np.ndarray:
    """What the x-th row of a unit, a left one, is compared with: right ones of a size that may be similar."""
    fits = (role & 2 > 0) & (np.minimum(sizes, sizes[x]) * below >= np.maximum(sizes, sizes[x]) * above)
    return fits & (low | low[x]) & (((role & 1) == 0) | (node > node[x])) & (node != node[x])


def _distances(x: int, ys: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, above: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Hamming distances, and whether they are such that the sets may be similar."""
    distance = np.bitwise_count(sketch[ys] ^ sketch[x]).sum(axis=1, dtype=np.int64)
    return distance, distance <= (sizes[ys] + sizes[x]) * (below - above) // (below + above)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(unit, its rows as tuples) of rows sorted by unit, the first column."""
    held: list[tuple] = []
    current = None
    for part in arrays.parts(batches, 200):
        for unit, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and unit != current:
                yield current, held
                held = []
            current = unit
            held.append(tuple(row))
    if held:
        yield current, held


def _near(rows: DataFrame, above: int, below: int) -> DataFrame:
    """Of rows (unit, node, group, low, role, rep, size, sketch) those that by their sketch may be linked with one of another group in the unit."""
    columns = ["unit", "node", "group", "low", "role", "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, held in _units(batches):
            if len(held) == 1:
                continue
            *kept, size, raw = zip(*held, strict=True)
            node, group, low, role, sizes = map(np.array, (*kept[:4], size))
            sketch = _folded(raw)
            near = np.zeros(len(held), dtype=bool)
            for x in np.flatnonzero(role & 1):
                ys = np.flatnonzero(_fits(x, sizes, node, low, role, above, below) & (group != group[x]))
                ys = ys[_distances(x, ys, sketch, sizes, above, below)[1]]
                near[ys] = True
                near[x] |= len(ys) > 0
            found = [[unit] * int(near.sum()), *([v for v, is_near in zip(c, near, strict=True) if is_near] for c in kept)]
            schema = pa.schema(list(zip(columns, [pa.int64()] * 3 + [pa.bool_(), pa.int32(), pa.int64()], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, schema, strict=True)], schema=schema)

    rows = rows.select(*columns, "size", "sketch").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(run, "unit long, node long, group long, low boolean, role int, rep long")


def _links(rows: DataFrame, above: int, below: int) -> DataFrame:
    """Verified links (a, b) inside units: rows (unit, node, group, low, role, set), compared left (1) with right (2) ones.

    Nodes of one group are connected already; of a pair one must be low.
    """

    def compare(node, group, low, role, raw) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        hashes = [np.frombuffer(r, dtype=U64) for r in raw]
        sizes = np.array([len(h) for h in hashes])
        words, begin = whole_sketches(np.repeat(np.arange(len(sizes)), sizes), np.concatenate(hashes), sizes)
        sketch = _folded([words[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)])
        root = {g: g for g in group}

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        for x in np.flatnonzero(role & 1):
            ys = np.flatnonzero(_fits(x, sizes, node, low, role, above, below))
            distance, near = _distances(x, ys, sketch, sizes, above, below)
            for y in ys[near][np.argsort(distance[near], kind="stable")]:
                one, two = find(group[x]), find(group[y])
                if one == two:
                    continue
                common = sizes[x] + sizes[y] - len(np.union1d(hashes[x], hashes[y]))
                if below * common >= above * (sizes[x] + sizes[y] - common):
                    found.append((node[x], node[y]))
                    root[one] = two
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _units(batches):
            node, group, low, role, raw = zip(*held, strict=True)
            pairs = compare(np.array(node), group, np.array(low), np.array(role), raw) if len(held) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = rows.select("unit", "node", "group", "low", "role", "set")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, n: int = 5, above: int = 4, below: int = 5
) -> DataFrame:
    """(doc_id, row key, n_shingles, component_id) for every row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased; a document's
    set holds its distinct ``n``-grams of words, or its whole sequence if it has
    fewer words. Two documents are linked where ``below`` * |intersection| >=
    ``above`` * |union|. ``component_id`` is the smallest doc_id that links lead
    to. Documents without words or text are linked with nothing. A null doc_id
    is never the smallest, so a component of such rows only has a null one.
    Rows with a doc_id in common are told apart by their sets. Columns other
    than doc_id and text are ignored.
    """
    info = written(nodes(docs, n, above, below), "nodes")
    full = info.where("size > 0")
    labelled = info.select("doc_id", *KEY, "size", "node")
    reps = full.groupBy("node").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"), F.min("doc_id").alias("least"), F.max("size").alias("size")
    )
    reps = written(reps, "reps")
    links = similar_links(docs, full, reps, n, above, below)
    joined = components(links, "a", "b").withColumnRenamed("component", "group")
    ids = reps.select("node", "least").join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = written(ids.groupBy("group").agg(F.min("least").alias("component_id")), "least")
    named = written(ids.select("node", "group").join(least, "group").select("node", "component_id"), "named")
    columns = ["doc_id", *KEY, F.col("size").alias("n_shingles")]
    found = labelled.where("size > 0").join(named, "node").select(*columns, "component_id")
    return found.union(labelled.where("size = 0").select(*columns, F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, above: int = 4, below: int = 5) -> DataFrame:
    """The rows of ``docs`` but those that are linked to a smaller doc_id; all columns stay.

    Documents without words stay, as do those without a doc_id, which no group
    can be named by. Rows that agree in doc_id and text become one.
    """
    found = jaccard_components(docs, n, above, below)
    kept = found.where("doc_id = component_id OR doc_id IS NULL").select(*KEY).distinct()
    return packed(docs).join(written(kept, "kept"), KEY, "left_semi").dropDuplicates(KEY).select("row.*")


def similar_links(docs: DataFrame, full: DataFrame, reps: DataFrame, n: int, above: int, below: int) -> DataFrame:
    """Verified links between nodes that connect all that any links connect."""
    tagged = written(_shared_keys(full, reps), "shared-keys")
    key = F.shiftrightunsigned("tagged", 1).alias("key")
    emitted = tagged.select("node", key, F.col("tagged").bitwiseAND(F.lit(1)).alias("probe"))
    shared = (
        emitted.groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max("probe").alias("probe"))
        .where("first <> last AND probe = 1")
    )
    shared = written(shared.select("key", "first"), "shared")
    members = emitted.join(shared, "key").select("node", "first").distinct()
    members = written(members, "members")
    # Nodes with a block of which one node is the first holder: whoever share a block meet in its group.
    wide = members.withColumnRenamed("first", "wide")
    rank = members.groupBy("node").agg(F.count("*").alias("shared"))
    found = wide.join(reps, "node").join(rank, "node")
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(below / above * 1.000001)).cast("int")
    found = found.select("node", "rep", "wide", "size", (F.col("shared") / F.col("size")).alias("rank"), band.alias("own"))
    found = written(found, "candidates")

    # A pair's bands are the same or neighbours: each group holds a band and the next.
    group = ["wide", "band"]
    rows = found.select("*", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"))
    rows = rows.withColumn("low", F.col("own") == F.col("band"))
    parts = F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("size") * 8 / CHUNK_BYTES))
    # Only groups with a pair to compare: one of its nodes must be of the group's own band.
    tallies = rows.groupBy(*group).agg(parts.cast("int").alias("chunks"), F.count("*").alias("n"), F.max("low").alias("low"))
    chunks = tallies.where("n > 1 AND low")
    chunks = written(chunks.select(*group, "chunks"), "groups")
    placed = rows.join(chunks, group).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = written(placed.select("node", "rep", *group, "size", "rank", "low", "chunks", "chunk"), "placed")

    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(CENTRES)).alias("salt")
    centres = placed.where("chunks > 1").groupBy(*group, salt).agg(F.max(F.struct("rank", "node", "low", "chunks")).alias("c"))
    centres = centres.select("c.node", *group, "c.low", F.explode(F.sequence(F.lit(0), F.col("c.chunks") - 1)).alias("chunk"))
    own = F.col("node").alias("group")
    columns = [_unit(*group, "chunk"), "node", own, "low"]
    units = placed.select(*columns, F.lit(3).alias("role")).union(centres.select(*columns, F.lit(2).alias("role")))
    # Sets are what is large: only those go to their units that sketches leave similar to something there. They meet
    # the list of their units by node, and are shuffled once more, by unit.
    near = written(_near(_sketched(full, placed, units), above, below), "near")
    sets = written(_with_units(_sets(docs, near, n), near), "sets")
    links = written(_links(sets.select("node", "set", F.inline("units")), above, below), "links")

    joined = components(links, "a", "b").withColumnRenamed("component", "group")
    large = placed.where("chunks > 1").join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    large = written(large, "large")
    tallies = large.groupBy(*group, "group").agg(F.count("*").alias("n"))
    most = tallies.groupBy(*group).agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    most = written(most.select(*group, F.col("most.group").alias("most")), "most")
    joint = {"chunk": F.floor(F.col("chunk") / LATE).cast("int"), "chunks": F.ceil(F.col("chunks") / LATE).cast("int")}
    open_rows = written(large.join(most, group).withColumns(joint), "open")
    apart = open_rows.where("group <> most")
    parts = F.ceil(F.greatest(F.count("*") / (LATE * CHUNK_ROWS), F.sum("size") * 8 / (LATE * CHUNK_BYTES))).cast("int")
    sides = written(apart.groupBy(*group).agg(parts.alias("sides")), "sides")
    side = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int").alias("side")
    left = apart.join(sides, group).select("node", "group", *group, "low", side, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = open_rows.join(sides, group)
    right = right.select("node", "group", *group, "low", "chunk", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))
    columns = [_unit(*group, "chunk", "side"), "node", "group", "low"]
    units = left.select(*columns, F.lit(1).alias("role")).union(right.select(*columns, F.lit(2).alias("role")))
    near = written(_near(_sketched(full, open_rows, units), above, below), "late-near")
    late = _with_units(_sets(docs, near, n), near).select("node", "set", F.inline("units"))
    return links.union(written(_links(late, above, below), "late-links"))


def _sketched(full: DataFrame, nodes: DataFrame, units: DataFrame) -> DataFrame:
    """The units' rows, each with the size and sketch of its node; ``nodes`` (node, rep) are all that occur."""
    rows = full.select("node", F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "size", "sketch")
    found = _with_units(_held(rows, _field(nodes.select(_mark()))), units)
    return found.select("node", "rep", "size", "sketch", F.inline("units"))


def _unit(*columns: str):
    """Number of a unit; should two units get the same, they are compared as one, which adds no wrong link."""
    return F.xxhash64(*columns).alias("unit")

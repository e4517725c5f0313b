"""Closed days, written once more: without repeats, sorted, and published in one step.

Blocks leave many small files and, after re-deliveries, repeats, which every read
would have to remove anew. :func:`compact` writes a day of such a table to a folder
of its own, each row once, and then adds that folder to the table of days
(``<table>_days``) as the day's newest version. Adding a partition is one step of
the catalogue, so a read sees the old state or the new one, and a failure before it
leaves a folder nobody knows.

Reads are a union: days with a version and no open file come from it as they are,
without a shuffle; days that have open files, because they were never compacted or
because rows came late, are deduplicated as before, versions included. Nothing
rests on files being removed in time.

A version is laid out by the hash of the trace, in contiguous ranges, so that a
share of the traces is a share of the row groups. Beside it lies, per file, a small
bit field of the attribute keys in it: a search for a key reads only files
that may hold it.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.session import shuffles_dropped
from spanloom.sources import blocks
from spanloom.sources.tables import PARTITION, Store, Table

VERSION = "upto"
"""Second partition column of the days: the greatest block number merged."""
HASH = "_trace_hash"
PART = "_part"
"""While a day is compacted: the task, and so the file, that a row goes to."""
ROWS_PER_FILE = 1_000_000
LEAST_FILES = 4
ROWS_PER_TASK = 50_000
"""So many are worth a task of their own, as long as there are cores without one."""
KEY_BITS = 12
"""log2 of the bits per file and key list: 512 bytes. Beyond some thousand keys in a file it is merely no help."""
KEY_LISTS = ("span_attributes_keys", "resource_attributes_keys")
INDEX_COLUMNS = "`file` STRING, `list` STRING, `word` INT, `bits` BIGINT"

Dedup = Callable[[DataFrame], DataFrame]


def trace_draw(trace_id: str = "trace_id") -> Column:
    """32 bits of the trace's MD5: the same for a trace wherever it is stored."""
    return F.conv(F.substring(F.md5(trace_id), 1, 8), 16, 10).cast("bigint")


def days_name(table: Table) -> str:
    return f"{table.name}_days"


def index_name(table: Table) -> str:
    return f"{table.name}_keys"


def ensure(store: Store, table: Table) -> None:
    """Create the tables of days and of their keys, if missing."""
    columns = ", ".join(f"`{n}` {t}" for n, t in table.columns.items())
    parts = f"`{PARTITION}` DATE, `{VERSION}` BIGINT"
    for name, listed in ((days_name(table), f"{columns}, `{HASH}` BIGINT"), (index_name(table), INDEX_COLUMNS)):
        store.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{store.database}`.`{name}` ({listed}, {parts})"
            f" USING parquet PARTITIONED BY (`{PARTITION}`, `{VERSION}`)"
        )


@dataclass(frozen=True)
class Days:
    """What a read sees of one table; fixed when the read is planned."""

    seen: blocks.View
    clean: dict[str, int]
    """Day and version, where the version is all there is."""
    touched: dict[str, int]
    """Day and version, where open files lie beside it."""


def all_versions(store: Store, table: Table) -> list[tuple[str, int]]:
    name = f"`{store.database}`.`{days_name(table)}`"
    if not store.spark.catalog.tableExists(f"{store.database}.{days_name(table)}"):
        return []
    found = (r.partition for r in store.spark.sql(f"SHOW PARTITIONS {name}").collect())
    return sorted((p.split("/")[0].split("=", 1)[1], int(p.split("/")[1].split("=", 1)[1])) for p in found)


def days(store: Store, table: Table) -> Days:
    seen = blocks.view(store)
    # Sorted, so that a day's newest version overwrites older ones. Newer than the view: not yet seen.
    newest = {day: upto for day, upto in all_versions(store, table) if upto <= seen.last}
    open_days = {_day_of(f) for f in open_files(store, table, list(newest))}
    return Days(
        seen,
        {d: v for d, v in newest.items() if d not in open_days},
        {d: v for d, v in newest.items() if d in open_days},
    )


def _day_of(path: str) -> str:
    return re.search(rf"/{PARTITION}=([0-9-]+)/", path)[1]


def _dates(values: list[str]) -> Column:
    return F.col(PARTITION).isin(*(dt.date.fromisoformat(v) for v in values))


def open_files(store: Store, table: Table, of: list[str]) -> list[str]:
    """Files appended to these days and not merged away; listed from the file system now."""
    if not of:
        return []
    store.spark.catalog.refreshTable(store.table_name(table))
    return list(store.read(table).where(_dates(of)).inputFiles())


def versions(store: Store, table: Table, chosen: dict[str, int]) -> DataFrame | None:
    """Rows of these versions, with the columns of the table and ``HASH``; other partitions are not read."""
    if not chosen:
        return None
    rows = store.spark.table(f"`{store.database}`.`{days_name(table)}`")
    return rows.where(_dates(list(chosen)) & F.col(VERSION).isin(*set(chosen.values())) & _pairs(chosen)).drop(VERSION)


def _pairs(chosen: dict[str, int]) -> Column:
    some = F.lit(False)
    for day, upto in chosen.items():
        some = some | ((F.col(PARTITION) == F.lit(dt.date.fromisoformat(day))) & (F.col(VERSION) == upto))
    return some


def open_rows(store: Store, table: Table, state: Days) -> DataFrame:
    """Seen rows of all days that are not clean, repeats included; versions of touched days among them."""
    rows = blocks.visible(store, table, state.seen)
    if state.clean:
        rows = rows.where(~_dates(list(state.clean)))
    rows = rows.withColumn(HASH, trace_draw())
    beside = versions(store, table, state.touched)
    return rows if beside is None else rows.unionByName(beside)


def read(store: Store, table: Table, dedup: Dedup, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every row once, the last delivery of each. ``narrow`` may filter by ``HASH``; the result has no such column.

    Nothing is shuffled for clean days.
    """
    state = days(store, table)
    rows = narrow(dedup(open_rows(store, table, state)))
    clean = versions(store, table, state.clean)
    if clean is not None:
        rows = rows.unionByName(narrow(clean))
    return rows.drop(HASH)


def compact(store: Store, table: Table, dedup: Dedup, before: dt.date, sweep: bool = True) -> dict[str, int]:
    """Write every day before ``before`` that has open files anew; returns the days and their versions.

    All due days are one job, and become seen day by day. With ``sweep`` the
    files merged are removed afterwards, as are those of abandoned blocks; a
    read that was planned before may then miss them. Without it days stay
    touched until the next run.
    """
    ensure(store, table)
    due = [d for d in store.partitions(table) if d < str(before)]
    files = open_files(store, table, due)
    due = sorted({_day_of(f) for f in files})
    if not due:
        return {}
    spark = store.spark
    state = days(store, table)
    older = {d: v for d, v in (state.touched | state.clean).items() if d in due}
    # These files and no others: more may come while this runs.
    schema = store.read(table).schema
    opened = spark.read.schema(schema).option("basePath", store.table_folder(table)).parquet(*files)
    rows = opened.where(state.seen.sees(F.col("_ingest_id"))).withColumn(HASH, trace_draw())
    merged = versions(store, table, older)
    if merged is not None:
        rows = rows.unionByName(merged)
    upto = state.seen.last
    if upto in older.values():
        # Rows without a block came late; no number tells the new version from the old one.
        name = f"compaction {uuid.uuid4().hex}"
        upto = blocks.begin(store, name, 0)
        blocks.end(store, upto, name, 0, 0, 0)
    folder = f"{store.folder()}/_days/{table.name}/{uuid.uuid4().hex}"
    found = rows.count()
    many = max(LEAST_FILES, -(-found // ROWS_PER_FILE), min(spark.sparkContext.defaultParallelism, found // ROWS_PER_TASK))
    # Dealt out once, whole rows as they are: repeats agree in their part, so they are told where they lie then.
    kept = dedup(_dealt_out(rows, table, many))
    kept = kept.select(*table.columns, HASH, PARTITION).sortWithinPartitions(PARTITION, HASH, table.identity[0])
    writer = kept.write.partitionBy(PARTITION)
    writer = writer.option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in table.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    with shuffles_dropped(spark):
        writer.parquet(f"{folder}/rows")
        key_fields(spark.read.parquet(f"{folder}/rows")).write.partitionBy(PARTITION).parquet(f"{folder}/keys")
    # The index first: a version that is seen has one.
    for name, part in ((index_name(table), "keys"), (days_name(table), "rows")):
        parts = " ".join(
            f"PARTITION (`{PARTITION}` = DATE'{day}', `{VERSION}` = {upto}) LOCATION '{folder}/{part}/{PARTITION}={day}'"
            for day in due
        )
        spark.sql(f"ALTER TABLE `{store.database}`.`{name}` ADD IF NOT EXISTS {parts}")
    if sweep:
        _sweep(store, table, opened, files, state.seen)
    return dict.fromkeys(due, upto)


def _dealt_out(rows: DataFrame, table: Table, many: int) -> DataFrame:
    """The rows in ``many`` partitions, ranges of day and hash, which are the column ``PART``.

    The ranges come from a sketch of two narrow columns; Spark's own would read the whole rows for them. A trace
    that holds more than a range is split by what else tells its rows apart.
    """
    day = F.coalesce(F.unix_date(PARTITION).cast("bigint"), F.lit(0))
    spot = day * 2**33 + F.coalesce(F.col(HASH) + 1, F.lit(0))
    cuts = [i / many for i in range(1, many)]
    sketch = F.percentile_approx("spot", cuts, max(10_000, 20 * many)) if cuts else F.array()
    ends = rows.select(spot.alias("spot")).agg(sketch.alias("ends")).first().ends or []

    def below(first: int, last: int) -> Column:
        """How many of the ends are less, if it is known to be one of first to last."""
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(spot > ends[middle], below(middle + 1, last)).otherwise(below(first, middle))

    part = below(0, len(ends))
    large = {end: ends.count(end) for end in ends if ends.count(end) > 1}
    if large:
        width = F.coalesce(*(F.when(spot == end, n) for end, n in large.items()), F.lit(1))
        mark = F.xxhash64(timestamps.to_minute(table.clock_ns()), *table.identity)
        part = part + F.pmod(mark, width).cast("int")
    return rows.withColumn(PART, part).repartitionById(many, PART)


def _sweep(store: Store, table: Table, opened: DataFrame, files: list[str], seen: blocks.View) -> None:
    """Remove the files of which all rows are merged or belong to abandoned blocks; those of blocks in progress stay."""
    gone = blocks.abandoned(store)
    pending = [n for n in seen.hidden if n not in set(gone)]
    number = F.coalesce(F.col("_ingest_id"), F.lit(blocks.NO_BLOCK))
    waits = (number > seen.last) | number.isin(*pending) if pending else number > seen.last
    waiting = {r.file for r in opened.where(waits).select(F.input_file_name().alias("file")).distinct().collect()}
    spark = store.spark
    path = spark._jvm.org.apache.hadoop.fs.Path
    for file in files:
        if file not in waiting:
            target = path(spark._jvm.java.net.URI(file))
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
    spark.catalog.refreshTable(store.table_name(table))


def drop_days(store: Store, table: Table, before: str) -> list[str]:
    """Forget all versions of days before ``before``; returns those days."""
    expired = [(d, v) for d, v in all_versions(store, table) if d < before]
    for day, upto in expired:
        for name in (days_name(table), index_name(table)):
            store.spark.sql(
                f"ALTER TABLE `{store.database}`.`{name}` DROP IF EXISTS PARTITION (`{PARTITION}` = DATE'{day}', `{VERSION}` = {upto})"
            )
    return sorted({d for d, _ in expired})


# --- which files may hold an attribute key ----------------------------------------


def _spots(key: Column) -> list[Column]:
    """Two bits for a key, from either half of its hash."""
    h = F.xxhash64(key)
    return [F.pmod(x, F.lit(2**KEY_BITS)).cast("int") for x in (h, F.shiftrightunsigned(h, 32))]


def key_fields(rows: DataFrame) -> DataFrame:
    """(date, file, list, word, bits): of each file and key list the words that are not 0."""
    lists = [F.struct(F.lit(name).alias("list"), F.col(name).alias("keys")) for name in KEY_LISTS if name in rows.columns]
    each = rows.select(PARTITION, F.input_file_name().alias("file"), F.explode(F.array(*lists)).alias("l"))
    # As many rows as a file has different keys reach the shuffle, from each of its splits.
    keys = each.select(PARTITION, "file", "l.list", F.explode("l.keys").alias("key")).distinct()
    spots = keys.select(PARTITION, "file", "list", F.explode(F.array(*_spots(F.col("key")))).alias("spot"))
    word, bit = F.shiftright("spot", 6), F.col("spot").bitwiseAND(F.lit(63))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return spots.groupBy(PARTITION, "file", "list", word.cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))


def files_with_key(store: Store, table: Table, chosen: dict[str, int], key: str, key_list: str = KEY_LISTS[0]) -> list[str]:
    """Files of these versions that may hold the key; no other does."""
    if not chosen:
        return []
    index = store.spark.table(f"`{store.database}`.`{index_name(table)}`")
    index = index.where(_dates(list(chosen)) & _pairs(chosen) & (F.col("list") == key_list))
    hits = []
    for spot in _spots(F.lit(key)):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)))
        hits.append((F.col("word") == F.shiftright(spot, 6)) & (F.col("bits").bitwiseAND(bit) != 0))
    found = index.where(hits[0] | hits[1]).groupBy("file").agg(F.bool_or(hits[0]).alias("a"), F.bool_or(hits[1]).alias("b"))
    return [r.file for r in found.where("a AND b").collect()]


def read_with_key(store: Store, table: Table, dedup: Dedup, key: str, key_list: str = KEY_LISTS[0]) -> DataFrame:
    """As :func:`read`, the rows whose ``key_list`` holds ``key``; of clean days only files that may hold it are read."""
    state = days(store, table)
    has_key = F.array_contains(key_list, key)
    rows = dedup(open_rows(store, table, state)).where(has_key).drop(HASH)
    files = files_with_key(store, table, state.clean, key, key_list)
    if files:
        schema = store.read(table).drop(PARTITION).schema
        clean = store.spark.read.schema(schema).parquet(*files).where(has_key)
        # The folders of versions do not name the day; the row's clock does.
        rows = rows.unionByName(clean.withColumn(PARTITION, table.partition_value()))
    return rows

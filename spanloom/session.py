"""Session settings the engine is tuned for, and its shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Call-site capture doubles the time it takes to build large expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
SHARED_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "spanloom") -> SparkSession:
    """A local session, as tests and the benchmark use it."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping = threading.Lock()
_droppers: dict[str, list] = {}


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver happens to collect its garbage.

    For writes only: what has run to its end inside and is run again shuffles once more. Nested and in
    several threads it holds until the last one is through.
    """
    session = spark._jsparkSession.sessionUUID()
    with _dropping:
        held = _droppers.setdefault(session, [0, spark.conf.get(DROP_SHUFFLES, "false")])
        held[0] += 1
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _dropping:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(DROP_SHUFFLES, held[1])
                del _droppers[session]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A local session that names none gets a temporary one; on a cluster such a
    folder would be out of the executors' reach, so there it is an error.
    """
    named = spark.conf.get(SHARED_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR} to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spanloom-")
    return _local_dirs[context.applicationId]

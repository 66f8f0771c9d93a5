"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in a session of one process that sets none.

    On a cluster the setting must name a folder that all share: without it this raises.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="voxelith-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/voxelith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions that the session shuffles into: as many for what is spread anew."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that a Python worker is sent at once, at most; a single longer row still goes whole.
BATCH = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers at most ``BATCH`` bytes at once.

    Whole texts can be long, and Spark's own bound of 64 MB is held several times over in each worker. The setting
    ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session is lowered, never raised, and stays so: results are
    evaluated after the call. It changes no result.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", (conf.get(name, None) or "").lower())
    if not now or int(now[1]) << 10 * " kmg".index(now[2] or " ") > BATCH:
        conf.set(name, str(BATCH))
    return df


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and several wait beside an executor."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_loaded: dict[tuple, object] = {}


def loaded(key: tuple, make):
    """What ``make`` makes for ``key``, once in a worker. A worker keeps one such thing: another key takes its place."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def tidy(run, keep: tuple | None = None):
    """``run``, a function from batches to batches, that releases memory when its task ends.

    Workers go from operator to operator: what another one has loaded, under another key than ``keep``, goes first.
    """
    @functools.wraps(run)
    def inner(batches):
        forget(keep)
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def forget(keep: tuple | None = None) -> None:
    if keep not in _loaded:
        _loaded.clear()


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        known = next((p for p in _made if path.endswith(p.removeprefix("file:").lstrip("/"))), None)
        if known:
            _delete(known, _made.pop(known))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clean() -> None:
    """Delete all tables of this process; results that read them must be written before."""
    for path, spark in list(_made.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session may have ended before
            pass
        _made.pop(path, None)

"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a pattern for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set: on a cluster one in the warehouse, else a local one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


#: Seconds after which the next table that is written has the driver let go, and when it last did.
LET_GO_S, _let_go_at = 5.0, 0.0
#: Tables written in each ``finished`` that is under way.
_open: list[list[DataFrame]] = []


def _files(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    return path, path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and a lost executor costs
    nothing that was written.  Tables that nobody discards are deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    where, files = _files(out)
    files.deleteOnExit(where)
    if _open:
        _open[-1].append(out)
    if time.monotonic() - _let_go_at > LET_GO_S:
        let_go(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more, and have the driver let go of the shuffle
    files that led to them: those of finished queries stay on executors' disks until it collects its garbage."""
    for df in tables:
        where, files = _files(df)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)
    if tables:
        let_go(tables[0])


def _trim(jvm, array) -> str:
    """As ``jcmd``'s System.trim_native_heap in the driver; called by the interface, as the server's own class is not open."""
    kind = jvm.java.lang.Class.forName
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    for i, name in enumerate(names):
        kinds[i] = kind(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)


def let_go(table: DataFrame) -> None:
    """Have the driver let go of the shuffle files of finished queries, and of memory that their plans took: a thread for each exchange
    and the compiled code leave free native memory behind, which stays with the process unless it is trimmed."""
    global _let_go_at
    gc.collect()
    jvm = table.sparkSession._jvm
    jvm.System.gc()
    pa.default_memory_pool().release_unused()
    try:
        _trim(jvm, table.sparkSession.sparkContext._gateway.new_array)
    except Exception:  # a runtime without that command
        pass
    _let_go_at = time.monotonic()


def finished(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way are deleted."""
    _open.append([])
    try:
        out = materialise(make(), label)
    finally:
        written = _open.pop()
    discard(*[t for t in written if t is not out])
    if _open:
        _open[-1].append(out)
    return out


def pieces(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``size`` bytes in ``column``, but of one row at least: so much is held as Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Memory that is free in a Python worker goes back to the system: workers outlive their stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size: at most ``BATCH_BYTES`` go to a worker at once, unless the session says otherwise."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the locale; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")

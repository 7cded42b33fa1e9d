"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times width up to which a side may be broadcast; checked against a materialised table.
BROADCAST_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table, through Spark's reader only, cut to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset and the master is local (tests, one machine) a temporary folder is made and
    kept in the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.dakspark.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="dakspark-")
        spark.conf.set("spark.dakspark.shared.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table written by `cut`, when no later plan reads it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `cut`, with the path, so that the caller can drop it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if next(_WRITTEN) % RELEASE_EVERY == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables written between two calls of `release`: what finished steps leave on the driver and in shuffle
#: files, which with many partitions are larger than the tables, is given back as a job goes.
RELEASE_EVERY = 4
_WRITTEN = itertools.count(1)


class Scratch:
    """The written tables of one job, to be dropped when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        out, path = cut_at(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()
        release(self.spark)


#: Rows of an Arrow batch: texts are long, and a worker and its executor hold a batch or two at a time.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches of texts hold BATCH_ROWS rows, unless the session asks for fewer than Spark's 10,000 itself."""
    if int(spark.conf.get(BATCH_CONF)) >= 10_000:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


#: Percent of the driver's heap that may stay free after a collection; Java's own 70 keeps 600 MB for 180 in use.
FREE_PERCENT = 40


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps, which it does once the driver forgets their plans; and the
    driver give back memory, which it else keeps up to its limit however little is in use: of the heap, and of what
    hundreds of threads have freed outside it. A JVM that can't do the latter two just collects."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    named, beans = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory
    with contextlib.suppress(Py4JError):
        options = beans.getPlatformMXBean(named("com.sun.management.HotSpotDiagnosticMXBean"))
        if int(options.getVMOption("MaxHeapFreeRatio").getValue()) > FREE_PERCENT:
            options.setVMOption("MaxHeapFreeRatio", str(FREE_PERCENT))
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        # The server's class isn't open to the gateway, its interface is.
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", _array(spark, jvm.Class, map(named, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = [commands, "systemTrimNativeHeap", _array(spark, jvm.Object, ()), _array(spark, jvm.String, ())]
        invoke.invoke(beans.getPlatformMBeanServer(), _array(spark, jvm.Object, args))


def _array(spark: SparkSession, kind, items: Iterable):
    """A Java array."""
    items = list(items)
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for i, item in enumerate(items):
        out[i] = item
    return out


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """`df`, a table that is already written, marked for broadcast only if its counted rows fit the limit."""
    small = df.count() * row_bytes <= limit
    return (F.broadcast(df) if small else df), small


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; `lower` does just that to text without other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )

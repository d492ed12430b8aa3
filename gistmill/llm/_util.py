"""Shared plumbing: durable intermediate tables and distributed ranks."""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def _remove(spark: SparkSession, root: str) -> None:
    """Delete this application's intermediate tables when the driver ends."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the gateway may already be gone at exit
        pass


def workspace(spark: SparkSession) -> str:
    """Folder for intermediate tables, below the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine (tests) a
    temporary folder is made; elsewhere its absence is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="gistmill-")
        _ROOTS[app] = f"{shared.rstrip('/')}/gistmill-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{workspace(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def dropping(spark: SparkSession):
    """Deletes the tables made inside but the last, which must be a written one that needs none of the others."""
    began = len(_MADE)
    yield
    for path in _MADE[began:-1]:
        _remove(spark, path)
    del _MADE[began:-1]


#: Tables that are written from one time that the driver gives memory back to the next.
RELIEF = 8
_CUTS = itertools.count(1)


def relieve(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs.

    Plans, broadcasts and shuffles of finished tables are garbage, but the heap
    grows to its limit before they are collected, and freed native memory stays
    with the process; many small jobs make much of both.
    """
    gc.collect()  # Python's references keep plans alive in the JVM
    jvm = spark._jvm
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is not open to Py4J
        given = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Exception:  # noqa: BLE001 - only JDKs on glibc have it
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared workspace and read it back.

    This ends the lineage at files that outlive executors, and gives the
    planner true sizes, so that only sides it has measured are broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if next(_CUTS) % RELIEF == 0:
        relieve(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """``df`` under column names that no helper column can clash with; the names by old name, and back."""
    inner = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*inner.values()), inner, {v: k for k, v in inner.items()}


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of so many rows, for what is computed inside: whole texts in the default 10,000 rows take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_hash(col: Column) -> Column:
    """Hex digest that fixes a pseudo-random, reproducible row order."""
    return F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def hash_block(digest: Column, blocks: int) -> Column:
    """Block 0..blocks-1 of a hex digest; never decreasing in the digest."""
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftright(head * F.lit(blocks), 32).cast("int")


def prefix_sum(
    df: DataFrame, group: list[str], block: list[Column], order: list[str], value: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per group, without one task per group.

    ``block`` are leading sort keys that cut a group into pieces; each piece is
    summed in its own partition and shifted by the total of the pieces before
    it. The table of piece totals must be small by construction (the callers
    state the bound), as it is broadcast.
    """
    names = [f"__b{i}" for i in range(len(block))]
    rows = df.withColumns(dict(zip(names, block, strict=True)))
    total = rows.groupBy(*group, *names).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    shift = total.select(*group, *names, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(shift), [*group, *names])
        .withColumn(out, (F.col("__in") + F.col("__shift")).cast("long"))
        .drop(*names, "__in", "__shift")
    )


def blocks_for(rows: int, least: int = 64, most: int = 4096, each: int = 1_000_000) -> int:
    """Pieces per group: enough for parallel work, at most ``most`` (the bound of what is broadcast)."""
    return max(least, min(most, -(-rows // each)))

"""Shared helpers of the text-corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; a word is a run of anything else.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
#: The same class for DuckDB's RE2.
SQL_WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Words of a text column as an array; null gives an empty array."""
    # a split leaves at most one empty string at either end
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+", -1), "")


def let(value, body):
    """body(x) for x = value, which is computed once a row, however often a lambda inside body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_words(text):
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_own: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone with all that it could reach
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; only without one (tests) a local folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="ckpt-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    if sc.applicationId not in _own:
        # the session's own folder below the shared one: what cut() wrote there goes with the session
        _own.add(sc.applicationId)
        atexit.register(_forget, spark, sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(True)
    trim(df.sparkSession)
    return out


def spill(df: DataFrame, **observed) -> tuple[DataFrame, str, dict]:
    """The frame, written as Parquet to the shared checkpoint folder, its path, and aggregates of its rows.

    For intermediate results that drop() removes when they have been read for the last time.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/spill-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in observed.items()))).write.parquet(at)
    trim(spark)
    return spark.read.schema(df.schema).parquet(at), at, seen.get


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle and checkpoint files of what the program no longer refers to.

    It does so when the driver's JVM collects garbage, which may be long after the last job.
    """
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Let the driver's JVM give memory back that it holds but does not use; what it says, None if it cannot.

    Compiled plans and blocks leave freed native memory behind, which the C library keeps, some 200 MB after
    hundreds of stages; a heap grown past half its limit shrinks only when it is collected whole.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    heap = jvm.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.System.gc()
    named = jvm.java.lang.Class.forName
    try:
        # the server's own class is not exported, so its method is taken from the interface
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM before 17.0.9, or another C library
        return None


def looked_up(left: DataFrame, right: DataFrame, on: str, often: str, total: int, how: str = "inner", hot: int = 1000) -> DataFrame:
    """left with right's columns; right has one row a key and says how often left has it, of total rows.

    Keys that more than one row in hot has are at most hot: they are broadcast and their rows stay where
    they are. The others meet by key. left is read twice, so it should be kept.
    """
    many = F.broadcast(right.where(F.col(often) * hot > total).drop(often))
    few = right.where(F.col(often) * hot <= total).drop(often)
    rest = left.join(many.select(on), on, "left_anti").join(few, on, how)
    return left.join(many, on).unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as columns u, v (long).

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step is a map-side
    combined minimum and an equi-join. No task holds a component; a node's edges, two numbers each,
    meet where they are joined with its least neighbour, unless the planner splits them. Returns node, component
    (the smallest node id reachable) for each node of at least one edge with two different ends.
    """
    spark = edges.sparkSession
    mark = dict(x=F.expr("bit_xor(xxhash64(u, v))"))
    now, at, seen = spill(edges.where("u is not null and v is not null and u <> v")
                          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **mark)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, old, last = seen, at, now
        now, at, seen = spill(small, **mark)
        del last
        drop(spark, old)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: each node but a component's least points to that one
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = cut(out.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop(spark, at)
    release(spark)
    return out

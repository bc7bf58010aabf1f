"""Session helpers shared by every operator: table access, lineage cuts, size-checked
broadcasts and distributed numbering."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side of a join is broadcast only when it was counted and has at most this many rows and, as text, bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Replicas of the small side when a counted side is too large to broadcast.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session that names none (a test) gets a fresh
    temporary folder; on a cluster, whose executors could not see it, that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='broadsheet-')}"
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files nobody refers to any more: its cleaner acts only when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that may have hot keys with a lookup table that has unique keys.

    The lookup side is counted and measured (up to ``limit`` + 1 rows): within the bounds it is broadcast, beyond them
    it is replicated ``SALTS`` times so that a hot key of ``big`` spreads over that many tasks.
    ``how`` is left, inner, left_semi or left_anti."""
    wide = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, t in small.dtypes if t == "string" or t.startswith("array")]
    size = small.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(wide, F.lit(8 * len(small.columns)))), F.lit(0)).alias("b")).first()
    if size.n <= limit and size.b <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on] or [F.col(on[0])]), F.lit(SALTS)).cast("int")
    return big.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come out once."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    out = left.join(named, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{c}" for c in on])


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of exactly one row, as constants: the row is fetched, so no join is planned."""
    row = one.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one.schema})


def sorted_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort ``df`` by ``order``; written once, with the partition number ``_pid``
    and the position ``_idx`` in it. A hot leading key is split because the later keys take part."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(
        ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
            "_idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Dense numbers 0..n-1 in ``order`` through partition offsets: one range shuffle, no global window.
    The offsets are one row per partition, hence broadcast."""
    parts = sorted_parts(df, order)
    offsets = (
        parts.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_pid", "_start")
    )
    return parts.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_start") + F.col("_idx")).drop("_pid", "_idx", "_start")


def group_running(df: DataFrame, group: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds ``rank`` (0, 1, ... in ``order``) and ``before`` (sum of ``value``, or of ones, over earlier rows) within each group.

    A hot group is no hot task: rows are range-partitioned by group and order, windows run within (partition, group),
    and one row per (partition, group) carries the offsets. Null groups are a group; ties follow the order columns,
    which should name a row."""
    v = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(1)
    parts = sorted_parts(df.withColumn("_v", v), [F.col(c) for c in (*group, *order)])
    runs = parts.groupBy(*group, "_pid").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_pid", "_first", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    d = null_safe_join(parts, runs, [*group, "_pid"])
    inside = Window.partitionBy("_pid", *group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("before", F.col("_s0") + F.sum("_v").over(inside) - F.col("_v")).withColumn("rank", F.col("_n0") + F.col("_idx") - F.col("_first"))
    return d.drop("_pid", "_idx", "_v", "_s0", "_n0", "_first")


def session(app: str = "broadsheet", cores: str | None = None, shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # written lineage cuts go when nobody refers to them
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

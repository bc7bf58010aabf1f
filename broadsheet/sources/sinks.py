"""Writers. Files are committed atomically by Spark's committer; nothing is written from the driver but small manifests."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.runtime import cut


def write_stage(df: DataFrame, path: str, key: str, by: str | None = "year", files: int = 16) -> None:
    """Parquet of a stage, one folder per partition value, sorted by key in each file. The rows of a value are spread over up to
    ``files`` tasks by a hash of the key, so a value with a third of all rows is no single task."""
    spread = F.pmod(F.xxhash64(key), F.lit(files))
    d = df.repartition(F.col(by), spread).sortWithinPartitions(by, key) if by else df.sortWithinPartitions(key)
    w = d.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, by: str = "year") -> None:
    df.withColumn("_p", F.col(by)).write.mode("overwrite").option("compression", "gzip").partitionBy("_p").json(path)


def content_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, digest): content hash that depends on neither order nor partitioning. The eight words of each line's sha256 are
    summed up, map-side first, so nothing is sorted or collected; the digest is the sha256 of the sums."""
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    words = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.select(*by, line.alias("_h")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).cast("string").alias(f"_{i}") for i, w in enumerate(words)])
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", *[f"_{i}" for i in range(8)]), 256).alias("digest"))


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not yet in the parquet table; returns their number. A missing table is created. The new rows
    are written once to the shared folder before they are counted, for the table is read and appended to in one call."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = cut(df)
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n


def clean_numbers(df: DataFrame, digits: int = 5) -> DataFrame:
    """Double and float columns rounded, NaN and infinities as null, as results are exported."""
    from broadsheet.functions.values import finite

    return df.select(*[finite(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def export_json(df: DataFrame, path: str, limit: int = 100_000) -> int:
    """A small result table as one JSON list; refuses tables over ``limit`` rows."""
    rows = clean_numbers(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    with open(path, "w") as f:
        json.dump([{k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in r.asDict(True).items()} for r in rows], f, ensure_ascii=False, default=str)
    return len(rows)


def write_text(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder. Only the listing goes through Spark's reader; the content is hashed in pieces
    of a megabyte, so a file may be larger than memory."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for b in batches:
            digests = []
            for p in b["path"]:
                system, name = fs.FileSystem.from_uri(f"file:///{p.removeprefix('file:').lstrip('/')}" if p.startswith("file:") else p)
                h = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                digests.append(h.hexdigest())
            yield b.assign(sha256=digests)

    return d.select("path", F.col("length").alias("bytes")).mapInPandas(run, "path string, bytes long, sha256 string")


def folder_hash(spark: SparkSession, path: str) -> DataFrame:
    h = file_hashes(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    return h.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", name, "sha256"))), ""), 256).alias("digest"), F.count(F.lit(1)).alias("files"))

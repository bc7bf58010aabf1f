"""Fetching a year of scans: archives are streamed, parsed and sampled up to a quota, and the result is kept with a manifest.
A year whose manifest carries the key of the same request is not read again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.ranking import quota_sample
from broadsheet.runtime import cut
from broadsheet.sources import readers, sinks

MANIFEST = "year int, key string, quota long, version string, scans_read long, scans_kept long, n_articles long, n_chars long, digest string"


def request_key(year: int, quota: int, filters: dict | None = None, version: str = readers.PROCESSING_VERSION) -> str:
    """A key that changes with the year, the quota, the filters and the version of the processing."""
    ask = {"year": year, "quota": quota, "version": version, "filters": readers.FILTERS | (filters or {})}
    return hashlib.sha256(json.dumps(ask, sort_keys=True).encode()).hexdigest()[:16]


def sampled_articles(articles: DataFrame, quota: int) -> DataFrame:
    """The articles of the scans, in the order of their ids, up to and with the scan that reaches the quota of its year."""
    sizes = articles.groupBy("year", "scan_id").agg(F.count(F.lit(1)).alias("_n"))
    return articles.join(quota_sample(sizes, "year", ["scan_id"], "_n", quota).select("year", "scan_id"), ["year", "scan_id"], "left_semi")


def manifest_of(articles: DataFrame, kept: DataFrame, quota: int, filters: dict | None = None, version: str = readers.PROCESSING_VERSION) -> DataFrame:
    """One row of ``MANIFEST`` per year of the articles read; the digest is that of the kept articles' content, in any order."""
    read = articles.groupBy("year").agg(F.countDistinct("scan_id").alias("scans_read"))
    size = kept.groupBy("year").agg(F.countDistinct("scan_id").alias("scans_kept"), F.count(F.lit(1)).alias("n_articles"), F.sum("n_chars").cast("long").alias("n_chars"))
    digest = sinks.content_hash(kept.select("year", "article_id", "text"), ["year"]).select("year", "digest")
    m = read.join(size, "year").join(digest, "year")
    keys = {int(r.year): request_key(int(r.year), quota, filters, version) for r in m.select("year").collect()}  # one row per year
    key = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])[F.col("year")] if keys else F.lit(None).cast("string")
    return m.select("year", key.alias("key"), F.lit(quota).cast("long").alias("quota"), F.lit(version).alias("version"), "scans_read", "scans_kept", "n_articles", "n_chars", "digest")


def fetch_year(spark: SparkSession, archives: str, year: int, quota: int, out: str, filters: dict | None = None, license_text: str = "", max_bytes: int | None = None, force: bool = False) -> DataFrame:
    """Read the archives of a year into ``out`` and return its manifest (one row). Articles of other years in the archives are left
    out; a year without articles gives no row and is read again next time."""
    place = f"{out}/manifests/{year}"
    key = request_key(year, quota, filters)
    if not force:
        try:
            old = spark.read.schema(MANIFEST).json(place)
            if old.where(F.col("key") == key).limit(1).count():
                return old
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    members = readers.read_tar_members(spark, archives, max_bytes)
    articles = cut(readers.parse_scans(members, "member", "payload", filters, license_text).where(F.col("year") == year))
    kept = cut(sampled_articles(articles, quota))
    kept.write.mode("overwrite").option("compression", "gzip").json(f"{out}/articles/{year}")
    manifest_of(articles, kept, quota, filters).coalesce(1).write.mode("overwrite").json(place)
    return spark.read.schema(MANIFEST).json(place)

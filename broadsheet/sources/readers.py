"""Readers: tar archives of page scans, JSON lines, compact labels, lexicons, and the parsing of scans to articles."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from broadsheet.functions import text as T
from broadsheet.functions.values import year_of
from broadsheet.sources.schemas import SCAN

#: The standard ingest filter, and the year grids of the corpus tiers.
FILTERS = {"min_chars": 200, "max_chars": 20000, "keep_legibility": ["Legible", "Questionable", "NA"]}
PROCESSING_VERSION = "ingest-v2"
#: Letters of the compact labels.
GENDER_CODES = {"F": "F", "M": "M", "U": "UNKNOWN"}
YES_NO = {"y": "yes", "n": "no", "u": "unsure"}


class _Budget(io.RawIOBase):
    """A byte stream that ends after a number of bytes; ``spent`` tells that it was cut off."""

    def __init__(self, raw, limit: int | None):
        self.raw, self.left = raw, limit

    @property
    def spent(self) -> bool:
        return self.left is not None and self.left <= 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = len(buffer) if self.left is None else min(len(buffer), self.left)
        data = self.raw.read(n) if n > 0 else b""
        buffer[: len(data)] = data
        if self.left is not None:
            self.left -= len(data)
        return len(data)


def _local(path: str) -> str | None:
    """The local name of a path without a scheme or with the scheme of files, else None."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _open(path: str):
    """A byte stream of a local file, a web address or a path of a file system that Arrow knows."""
    if (name := _local(path)) is not None:
        return open(name, "rb")
    if path.startswith(("http://", "https://")):
        import urllib.request

        return urllib.request.urlopen(path, timeout=60)  # noqa: S310
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name, compression=None)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.limit = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.suffix = options.get("suffix", ".json")

    def partitions(self):
        import glob

        found = [f for p in self.paths for f in ([p] if _local(p) is None else sorted(glob.glob(_local(p))))]
        if not found:
            raise FileNotFoundError(f"no archive matches {', '.join(self.paths)}")
        return [_File(f) for f in found]

    def read(self, partition):
        with _open(partition.path) as raw:
            budget = _Budget(raw, self.limit)
            stream = io.BufferedReader(budget, 1 << 20)
            if stream.peek(2)[:2] == b"\x1f\x8b":
                stream = gzip.GzipFile(fileobj=stream)
            try:
                with tarfile.open(fileobj=stream, mode="r|") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(self.suffix):
                            yield (partition.path, m.name, tar.extractfile(m).read())
            except (EOFError, tarfile.ReadError, OSError):
                if not budget.spent:  # a damaged archive or a broken connection is no end of data
                    raise


class TarMembers(DataSource):
    """``spark.read.format("tar_members")``: one partition per archive, streamed member by member, never held whole. Options:
    path (comma-separated, globs), max_bytes (compressed bytes to read per archive), suffix. An archive cut off by max_bytes ends
    quietly; one that is damaged raises."""

    @classmethod
    def name(cls):
        return "tar_members"

    def schema(self):
        return "archive string, member string, payload binary"

    def reader(self, schema):
        return _TarReader(self.options)


def read_tar_members(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(TarMembers)
    r = spark.read.format("tar_members").option("path", path)
    return (r.option("max_bytes", str(max_bytes)) if max_bytes else r).load()


def member_metadata(c: Column) -> list[Column]:
    """lccn, month and page band of a member name like dir/1963-12-15_p23_lccn_000001.json."""
    from broadsheet.functions.values import page_band

    base = F.element_at(F.split(c, "/"), -1)
    return [F.nullif(F.get(F.split(base, "_"), F.lit(2)), F.lit("")).alias("lccn"), F.substring(base, 6, 2).alias("month"), page_band(T.page_from_member(c)).alias("page_band")]


def parse_scans(scans: DataFrame, member: str, payload: str, filters: dict | None = None, license_text: str = "") -> DataFrame:
    """Articles of scans given as JSON text: unreadable scans, dates without a year, empty and filtered articles are dropped.
    The page comes from the member name, else from the JSON if it is a number."""
    f = FILTERS | (filters or {})
    s = scans.select(F.col(member).alias("_m"), F.from_json(F.col(payload).cast("string"), SCAN + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    s = s.where("j is not null and j._bad is null").select("_m", "j.*").withColumn("date", F.coalesce("edition.date", F.lit(""))).withColumn("year", year_of(F.col("date"))).where("year is not null")
    page = F.coalesce(T.page_from_member(F.col("_m")), F.expr("try_cast(page_number as int)"))
    raw, url = F.trim(F.coalesce("lccn.title", F.lit(""))), F.trim(F.coalesce("scan_url", F.lit("")))
    s = s.withColumn("page_number", page).withColumn("publication_raw", raw).withColumn("scan_url", url)
    fallback = F.concat(F.coalesce("lccn.lccn", F.lit("?")), F.lit(":"), F.col("date"), F.lit(":p"), F.coalesce(F.col("page_number").cast("string"), F.lit("None")))
    s = s.withColumn("scan_id", F.when(F.length("scan_url") > 0, F.col("scan_url")).otherwise(fallback))
    marks = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.coalesce("bboxes", F.array().cast("array<struct<id:int,legibility:string>>")), lambda b: b["id"])), lambda i: F.struct(i, F.element_at(F.transform(F.filter("bboxes", lambda b: b["id"] == i), lambda b: F.coalesce(b["legibility"], F.lit("NA"))), -1))))
    a = s.withColumn("_marks", marks).withColumn("a", F.explode("full articles"))
    body = F.trim(F.regexp_replace(F.coalesce("a.article", F.lit("")), rf"^{T.S}+|{T.S}+$", ""))
    legibility = T.legibility_of(F.transform(F.coalesce("a.object_ids", F.array().cast("array<int>")), lambda i: F.coalesce(F.element_at("_marks", i), F.lit("NA"))))
    a = a.withColumn("text", body).withColumn("n_chars", F.length("text")).withColumn("legibility", legibility)
    a = a.where((F.length("text") > 0) & F.col("n_chars").between(f["min_chars"], f["max_chars"]) & F.col("legibility").isin(f["keep_legibility"]))
    nz = lambda c: F.coalesce(c, F.lit(""))
    return a.select(
        T.article_key(F.col("scan_id"), F.col("a.full_article_id")).alias("article_id"), T.title_normalize(F.col("publication_raw")).alias("publication"), "publication_raw", nz("lccn.lccn").alias("lccn"),
        nz("lccn.state").alias("state"), "date", "year", "page_number", nz("edition.edition").alias("edition"), T.squeeze(F.col("a.headline")).alias("headline"), T.squeeze(F.col("a.byline")).alias("byline"),
        "text", "n_chars", T.word_count(F.col("text")).alias("n_words"), "legibility", "scan_url", "scan_id", F.lit(license_text).alias("license"), F.lit(PROCESSING_VERSION).alias("processing_version"),
    )


def read_articles(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """Articles written by ``write_jsonl`` by year; only the folders of the asked years are read, missing files are skipped."""
    from broadsheet.sources.schemas import ARTICLE

    d = spark.read.schema(ARTICLE).option("ignoreMissingFiles", "true").json(root)
    if years and "_p" in d.columns:
        d = d.where(F.col("_p").isin(years))
    return (d.where(F.col("year").isin(years)) if years else d).drop("_p")


def target_years(config: dict, tier: str) -> list[int]:
    """Year grid of a tier given as a list or as start, stop and step."""
    y = config["tiers"][tier]["years"]
    return list(y) if isinstance(y, list) else list(range(y["start"], y["stop"] + 1, y.get("step", 1)))


def read_replies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of labels or replies; blank lines are skipped, and unparsed replies where the schema has parse_ok."""
    d = spark.read.schema(schema).json(path)
    return d.where("parse_ok") if "parse_ok" in d.columns else d


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def parse_labels(lines: DataFrame, value: str, roles: dict[str, str]) -> DataFrame:
    """Compact labels n|person|gender|ROLES|quoted|confidence|note: one letter per role in ROLES ('-' for none), further pipes belong
    to the note. Columns n, is_person, gender_text, roles, quoted, confidence, notes; blank lines and lines starting with # are skipped."""
    p = F.split(F.trim(value), r"\|", 7)
    get = lambda i: F.trim(F.get(p, F.lit(i)))
    code = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    letters = F.filter(F.split(get(3), ""), lambda x: x.isin(list(roles)))
    return lines.where((F.length(F.trim(value)) > 0) & ~F.trim(value).startswith("#")).select(
        get(0).try_cast("int").alias("n"), code(YES_NO, get(1)).alias("is_person"), F.coalesce(code(GENDER_CODES, get(2)), F.lit("UNKNOWN")).alias("gender_text"),
        F.array_sort(F.array_distinct(F.transform(letters, lambda x: code(roles, x)))).alias("roles"), code(YES_NO, get(4)).alias("quoted"), get(5).try_cast("int").alias("confidence"), F.coalesce(get(6), F.lit("")).alias("notes"),
    )


def repeated_labels(labels: DataFrame) -> DataFrame:
    """Numbers that occur more than once (an error of the label file)."""
    return labels.groupBy("n").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word): lower-case distinct words of a plain or gzip text file."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()

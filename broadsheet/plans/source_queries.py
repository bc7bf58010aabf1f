"""Queries of readers and writers: tables are written to the shared folder and read back, and the SQL states what must come back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.functions import values as V
from broadsheet.operators import models
from broadsheet.plans.bindings import CONTENT, articles
from broadsheet.runtime import cut, shared_dir, table
from broadsheet.sources import fetch, readers, sinks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"


def _write_archives(scans: DataFrame, folder: str, archives: int = 3) -> DataFrame:
    """One gz tar of JSON scans per hash bucket of (member, payload), written by the tasks; (archive, members)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        from pyarrow import fs

        uri = f"{folder}/{int(rows['bucket'].iloc[0])}.tar.gz"
        system, name = fs.FileSystem.from_uri(f"file:///{uri.removeprefix('file:').lstrip('/')}" if uri.startswith("file:") or uri.startswith("/") else uri)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
            for member, payload in zip(rows["member"], rows["payload"], strict=True):
                data = payload.encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"archive": [name], "members": [len(rows)]})

    bucketed = scans.withColumn("bucket", F.pmod(F.xxhash64("member"), F.lit(archives)))
    return cut(bucketed.groupBy("bucket").applyInPandas(run, "archive string, members long"))


def _archives(spark: SparkSession, d: str) -> str:
    s = table(spark, d, "scans").select(F.regexp_replace("member_name", r"\.json$", "").alias("m"), "scan_id", "date", "lccn").distinct()
    rows = s.select(F.concat_ws("", F.col("m"), F.lit("-"), F.substring(F.sha1(F.to_json(F.struct("m", "scan_id", "date", "lccn"))), 1, 12), F.lit(".json")).alias("member"), F.to_json(F.struct("scan_id", "date")).alias("payload"))
    folder = _folder(spark)
    _write_archives(rows, folder)
    return folder


@query("SELECT count(*) AS members, count(DISTINCT scan_id) AS scans FROM (SELECT DISTINCT regexp_replace(member_name, '\\.json$', ''), scan_id, date, lccn FROM scans)")
def tar_members(spark: SparkSession, d: str) -> DataFrame:
    """Scans written to gz archives and streamed back member by member."""
    got = readers.read_tar_members(spark, _archives(spark, d) + "/*.tar.gz")
    return got.agg(F.count(F.lit(1)).alias("members"), F.countDistinct(F.get_json_object(F.col("payload").cast("string"), "$.scan_id")).alias("scans"))


@query("SELECT true AS fewer, true AS whole")
def tar_budget(spark: SparkSession, d: str) -> DataFrame:
    """With a byte budget each archive ends early and quietly, and what is read is a part of the whole."""
    path = _archives(spark, d) + "/*.tar.gz"
    every = readers.read_tar_members(spark, path).select("archive", "member")
    some = cut(readers.read_tar_members(spark, path, 400).select("archive", "member"))
    n = every.agg(F.count(F.lit(1)).alias("n")).first().n
    lost = some.join(every, ["archive", "member"], "left_anti").limit(1).count()
    return some.agg((F.count(F.lit(1)) < n).alias("fewer")).withColumn("whole", F.lit(lost == 0))


@query("SELECT year, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM (SELECT DISTINCT article_id, year, text FROM articles) WHERE year IN (1900, 1921, 1942) GROUP BY 1")
def article_lines(spark: SparkSession, d: str) -> DataFrame:
    """Articles written as JSON lines by year; of three years only the folders are read."""
    folder = _folder(spark)
    sinks.write_jsonl(articles(spark, d, *CONTENT).where("year is not null").dropDuplicates(["article_id"]), folder)
    got = readers.read_articles(spark, folder, [1900, 1921, 1942])
    return got.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


_WORDS = " || ':' || ".join(f"sum(('0x' || substring(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(
    "WITH a AS (SELECT DISTINCT article_id, scan_id, year FROM articles WHERE year IS NOT NULL), s AS (SELECT year, scan_id, count(*) AS n FROM a GROUP BY 1, 2), "
    "k AS (SELECT year, scan_id FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY year ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) WHERE b < 30), "
    "r AS (SELECT year, count(*) AS scans_read FROM s GROUP BY 1), x AS (SELECT a.year, a.scan_id, a.article_id, sha256('{\"article_id\":\"' || a.article_id || '\",\"text\":\"\",\"year\":' || a.year || '}') AS h FROM a JOIN k USING (year, scan_id)) "
    f"SELECT year, CASE year " + " ".join(f"WHEN {y} THEN '{fetch.request_key(y, 30)}'" for y in range(1900, 1964, 3)) + f" END AS key, 30::BIGINT AS quota, '{readers.PROCESSING_VERSION}' AS version, any_value(scans_read) AS scans_read, count(DISTINCT scan_id) AS scans_kept, count(*) AS n_articles, 0::BIGINT AS n_chars, sha256({_WORDS}) AS digest FROM x JOIN r USING (year) GROUP BY 1"
)
def year_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of all years under a quota, with the key of the request and the digest of what was kept (ids only here)."""
    a = table(spark, d, "articles").where("year is not null").select("article_id", "scan_id", "year").distinct().withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0))
    return fetch.manifest_of(a, fetch.sampled_articles(a, 30), 30)


@query("SELECT y::INTEGER AS year FROM range(1900, 1964, 3) t(y)")
def year_grid(spark: SparkSession, d: str) -> DataFrame:
    years = readers.target_years({"tiers": {"standard": {"years": {"start": 1900, "stop": 1963, "step": 3}}}}, "standard")
    return spark.createDataFrame([(y,) for y in years], "year int")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def reply_lines(spark: SparkSession, d: str) -> DataFrame:
    """Replies as JSON lines with blank lines between; the unparsed ones are left out."""
    folder = _folder(spark)
    line = F.concat(F.to_json(F.struct("event_id", "event_type", (F.col("event_type") != "error").alias("parse_ok"))), F.when(F.col("event_id") % 3 == 0, "\n").otherwise(""))
    sinks.write_text(table(spark, d, "events"), folder, line)
    return readers.read_replies(spark, folder, "event_id long, event_type string, parse_ok boolean").select("event_id", "event_type")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_table(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), folder)
    return readers.read_table_csv(spark, folder)


@query("SELECT DISTINCT lower(trim(u)) AS word FROM (SELECT unnest(top_terms) AS u FROM topic_labels) WHERE trim(u) <> ''")
def lexicon_words(spark: SparkSession, d: str) -> DataFrame:
    """A word list written as gz text, with capitals, blanks and blank lines, and read as a lexicon."""
    folder = _folder(spark)
    w = table(spark, d, "topic_labels").select(F.explode("top_terms").alias("w")).select(F.explode(F.array(F.concat(F.lit(" "), F.initcap("w")), F.col("w"), F.lit(""))).alias("value"))
    w.write.option("compression", "gzip").text(folder)
    return readers.read_lexicon(spark, folder)


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, true AS in_order FROM orders GROUP BY 1")
def stage_table(spark: SparkSession, d: str) -> DataFrame:
    """A stage written by year over several tasks a year, replaced by a second write, and sorted within its files."""
    folder = _folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    sinks.write_stage(o.limit(5), folder, "o_orderkey")
    sinks.write_stage(o, folder, "o_orderkey")
    rows = spark.read.parquet(folder).select("year", "o_orderkey", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    per = rows.groupBy("year", "file").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.min_by("o_orderkey", "at").alias("a"), F.max_by("o_orderkey", "at").alias("z"))
    ok = (F.col("a") == F.col("lo")) & (F.col("z") == F.col("hi"))
    return per.groupBy("year").agg(F.sum("n").alias("n"), F.min("lo").alias("first_key"), F.max("hi").alias("last_key"), F.bool_and(ok).alias("in_order"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS first_run, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS second_run, 0::BIGINT AS third_run, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def resumed_append(spark: SparkSession, d: str) -> DataFrame:
    """A run that is broken off and resumed appends only what is missing."""
    folder = _folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    runs = [sinks.append_missing(x, folder, "o_orderkey") for x in (o.where("o_orderkey % 3 = 0"), o, o)]
    got = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    return got.select(*[F.lit(n).cast("long").alias(k) for n, k in zip(runs, ("first_run", "second_run", "third_run"), strict=True)], "n", "keys")


@query("SELECT sum(length(r_name) + 1)::BIGINT AS bytes, sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    """The hash of a written file, read in pieces (one file, for the table has five rows)."""
    folder = _folder(spark)
    sinks.write_text(table(spark, d, "region").coalesce(1).sortWithinPartitions("r_regionkey"), folder, F.col("r_name"))
    return sinks.file_hashes(spark, folder, "part-*").select("bytes", "sha256")


@query(
    r"SELECT article_id, regexp_extract(substring(t, 1, 40), '[^\s]*$') || substring(t, 41, 60) || regexp_extract(substring(t, 101), '^[^\s]*') AS ctx, 40 - length(regexp_extract(substring(t, 1, 40), '[^\s]*$')) AS from_char FROM (SELECT DISTINCT article_id, text AS t FROM articles WHERE length(text) > 120)"
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """The words round a span, widened to whole words."""
    a = articles(spark, d, "article_id", "text").where(F.length("text") > 120)
    return a.select("article_id", T.context_window(F.col("text"), F.lit(60), F.lit(80), 20).alias("w")).select("article_id", "w.ctx", F.col("w.from_char").cast("long").alias("from_char"))


@query("SELECT DISTINCT date, CASE WHEN length(date) >= 10 AND regexp_matches(date, '^[0-9]{4}') THEN TRY_CAST(substring(date, 1, 4) AS INTEGER) END AS year FROM articles")
def date_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("date").distinct().withColumn("year", V.year_of(F.col("date")))


# ------------------------------------------------------------------ plug-ins


@query("SELECT doc_id, least(length(coalesce(text, '')), 16777216)::DOUBLE AS n_chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS n_e FROM documents")
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """An encoder plug-in, loaded once a task and called on batches; here it counts characters."""
    import numpy as np

    def load():
        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], dtype="float64")

    e = models.pooled_embeddings(table(spark, d, "documents"), "text", load)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_e"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN '{\"n\": ' || o_orderkey || '}' END AS raw, CASE WHEN o_orderkey % 5 = 0 THEN 'ValueError: no reply' END AS error, CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS tries FROM orders")
def client_replies(spark: SparkSession, d: str) -> DataFrame:
    """A language-model client as a plug-in: failures are retried, then recorded; here some calls fail once and some always."""

    def load():
        seen: set[str] = set()

        def ask(prompt: str) -> str:
            n = int(prompt)
            first = prompt not in seen
            seen.add(prompt)
            if n % 5 == 0 or n % 7 == 0 and first:
                raise ValueError("no reply")
            return f'{{"n": {n}}}'

        return ask

    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("prompt"))
    return models.label_replies(o, "o_orderkey", "prompt", load, tries=2, wait=0.0)


@query(
    """WITH f AS (SELECT vec_id, (vec_id < 3)::INT AS y, floor((('0x' || substring(md5(vec_id || '|0'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE * 4)::INT AS fold FROM embeddings)
SELECT a.vec_id, round(sum(b.y) / count(*), 6) AS p FROM f a JOIN f b ON a.fold <> b.fold GROUP BY 1"""
)
def rare_role_crossfit(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of a role with too few examples are its prevalence in the other folds."""
    e = models.with_vector(table(spark, d, "embeddings"), "embedding").withColumn("rare", (F.col("vec_id") < 3).cast("double"))
    return models.crossfit(e, "vec_id", ["rare"], models.embedding_stages, k=4).select("vec_id", F.round("p_rare", 6).alias("p"))


@query("SELECT t::INTEGER AS topic, ((t * 3 + 1) % 10)::INTEGER AS matched, 1.0::DOUBLE AS cosine FROM (SELECT DISTINCT label AS t FROM embeddings)")
def topic_stability(spark: SparkSession, d: str) -> DataFrame:
    """Topics of two runs matched with each other; the second run has those of the first in another order."""
    import numpy as np

    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).toPandas()  # 10 topics x 64
    a = rows.pivot(index="label", columns="i", values="v").sort_index()
    b = np.empty_like(a.to_numpy())
    b[(a.index.to_numpy() * 3 + 1) % 10] = a.to_numpy()
    mean, match = models.topic_stability(a.to_numpy(), b)
    return spark.createDataFrame([(int(t), int(m), round(mean, 6)) for t, m in zip(a.index, match, strict=True)], "topic int, matched int, cosine double")


@query()
def bow_crossfit(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of a bag-of-words role model on labelled articles."""
    lab = table(spark, d, "article_topics").where("topic >= 0").groupBy("article_id").agg(F.min("topic").alias("topic"))
    a = articles(spark, d, "article_id", "text").where("text is not null").join(lab, "article_id").withColumn("text", F.lower("text")).withColumn("y", (F.col("topic") == 0).cast("double"))
    return models.crossfit(a, "article_id", ["y"], models.bow_stages, k=2).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_y"), 6).alias("mean_p"))

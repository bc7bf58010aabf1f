"""Queries on text, scans, duplicates and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions import text as T
from broadsheet.functions import values as V
from broadsheet.operators import duplicates, ranking, rules, words
from broadsheet.operators.trend import bh_fdr, with_normal_p
from broadsheet.plans import model_sql as M
from broadsheet.plans.bindings import articles, topics
from broadsheet.runtime import table
from broadsheet.sources.readers import member_metadata, parse_scans

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
A = "(SELECT DISTINCT article_id, {0} FROM articles)"


@query(
    "SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '([\\p{L}\\p{N}_])-" + WS + "*\\n" + WS + "*([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '"
    + WS + "*\\n" + WS + "*', ' ', 'g'), '“”„‘’', '\"\"\"' || chr(39) || chr(39)), '(^|[^\\p{L}\\p{N}_])(Mr|Mrs|Dr|Rev|Messrs|Mme|Jr|Sr)\\.{2,}', '\\1\\2.', 'g'), chr(39) || chr(39) || '|,,', '\"', 'g'), '[ \\t]{2,}', ' ', 'g'), "
    "' ' || chr(9) || chr(10) || chr(13)) AS norm FROM " + A.format("text")
)
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text").select("article_id", T.text_normalize(F.col("text")).alias("norm"))


@query(
    r"SELECT DISTINCT publication_raw, lower(trim(regexp_replace(regexp_replace(coalesce(publication_raw, ''), '(?i)\s*(\[[^\]]*\]|\([^)]*\)|[0-9]{2}[0-9?]{2}\s*-\s*([0-9]{2}[0-9?]{2}|current|\?{2,4}))\s*', ' ', 'g'), '\s+', ' ', 'g'), ' .,;:-')) AS title FROM articles"
)
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("publication_raw").distinct().withColumn("title", T.title_normalize(F.col("publication_raw")))


@query(
    r"""SELECT DISTINCT member_name, CAST(nullif(regexp_extract(member_name, '_p([0-9]+)_', 1), '') AS INTEGER) AS page,
 CASE WHEN nullif(regexp_extract(member_name, '_p([0-9]+)_', 1), '') IS NULL THEN 'na' WHEN page = 1 THEN 'p1' WHEN page <= 4 THEN 'p2-4' WHEN page <= 12 THEN 'p5-12' ELSE 'p13+' END AS page_band,
 substring(split_part(member_name, '/', -1), 6, 2) AS month FROM scans"""
)
def scan_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "scans").select("member_name").distinct()
    _, month, band = member_metadata(F.col("member_name"))
    return m.select("member_name", T.page_from_member(F.col("member_name")).alias("page"), band, month)


@query(
    "SELECT scan_id, max(CASE WHEN list_contains(m, 'Illegible') THEN 'Illegible' WHEN list_contains(m, 'Questionable') THEN 'Questionable' WHEN list_contains(m, 'Legible') THEN 'Legible' ELSE 'NA' END) AS legibility, "
    "max(len(m)) AS n_boxes FROM (SELECT scan_id, list_transform(bboxes, lambda x: x.legibility) AS m FROM scans) GROUP BY 1"
)
def scan_legibility(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scans").select("scan_id", F.col("bboxes.legibility").alias("m"))
    return s.groupBy("scan_id").agg(F.max(T.legibility_of(F.col("m"))).alias("legibility"), F.max(F.size("m")).cast("long").alias("n_boxes"))


@query("SELECT DISTINCT scan_id, page_number, 'as1-' || substring(sha1(scan_id || '::' || coalesce(CAST(page_number AS VARCHAR), '0')), 1, 16) AS article_key FROM scans")
def article_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scans").select("scan_id", "page_number").distinct().withColumn("article_key", T.article_key(F.col("scan_id"), F.coalesce("page_number", F.lit(0))))


@query(
    r"SELECT DISTINCT article_id, trim(regexp_replace(coalesce(headline, ''), '\s+', ' ', 'g')) AS headline, CASE WHEN trim(regexp_replace(coalesce(text, ''), '" + WS + "+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '" + WS + "+', ' ', 'g')), ' ')) END AS words FROM articles"
)
def squeezed_headlines(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "headline", "text").select("article_id", T.squeeze(F.col("headline")).alias("headline"), T.word_count(F.col("text")).cast("long").alias("words")).distinct()


@query("SELECT DISTINCT article_id, sha1(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) AS k FROM articles")
def exact_key(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text").select("article_id", T.exact_key(F.col("text")).alias("k"))


@query(
    "SELECT doc_id, len(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS n_shingles "
    "FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)"
)
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"), 5)).cast("long").alias("n_shingles"))


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[\p{L}\p{N}.,;:''"\-()?!$%&]|""" + WS + r"""', '', 'g')) / nullif(length(text), 0), 6) AS junk FROM documents""")
def junk_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.junk_rate(F.col("text")), 6).alias("junk"))


@query(
    r"""WITH c AS (SELECT DISTINCT article_id, coalesce(text, '') AS t, least(20, length(coalesce(text, ''))) AS s, least(32, length(coalesce(text, ''))) AS e FROM articles),
w AS (SELECT article_id, regexp_extract_all(lower(substring(t, 1, s)), '[a-z]+') AS l, regexp_extract_all(lower(substring(t, e + 1)), '[a-z]+') AS r FROM c)
SELECT article_id, array_to_string(list_concat(list_concat(l[greatest(1, len(l) - 19):], ['tgtperson']), list_concat(r[1:20], list_concat(list_transform(l[greatest(1, len(l) - 2):], lambda x: 'l_' || x), list_transform(r[1:3], lambda x: 'r_' || x)))), ' ') AS bow FROM w"""
)
def bow_text(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "text").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("s", F.least(F.lit(20), F.length("t"))).withColumn("e", F.least(F.lit(32), F.length("t")))
    return a.select("article_id", T.bow_text(F.col("t"), F.col("s"), F.col("e")).alias("bow"))


@query(
    """WITH p AS (SELECT DISTINCT article_id, string_split(text, '"') AS x FROM articles WHERE text IS NOT NULL)
SELECT article_id, CASE WHEN len(x) = 2 THEN length(x[2]) ELSE coalesce(list_sum(list_transform(list_filter(range(1, len(x) + 1), lambda i: i % 2 = 0 AND i < len(x)), lambda i: length(x[i]))), 0) END::BIGINT AS n FROM p"""
)
def quote_length(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "article_id", "text").where("text is not null").select("article_id", T.quote_length(F.col("text")).cast("long").alias("n"))


@query(
    "SELECT DISTINCT article_id, substring(text, 1, 5) || '⟦' || substring(text, 6, 10) || '⟧' || substring(text, 16) AS marked, "
    "'…' || trim('⟦' || substring(text, 31, 20) || '⟧' || substring(text, 51, 15)) || '…' AS excerpt FROM articles WHERE length(text) > 100".replace("'…' || trim('⟦'", "'…' || trim(substring(text, 16, 15) || '⟦'")
)
def marked_excerpts(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "text").where(F.length("text") > 100)
    return a.select("article_id", T.mark_span(F.col("text"), F.lit(5), F.lit(15)).alias("marked"), T.trim_excerpt(F.col("text"), F.lit(30), F.lit(50), 15).alias("excerpt"))


@query(
    """WITH lex AS (SELECT DISTINCT lower(unnest(top_terms)) AS w FROM topic_labels),
t AS (SELECT article_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 3))) AS w FROM (SELECT DISTINCT article_id, text FROM articles)),
s AS (SELECT unnest([chr(39) || 's', 's', 'es', 'ed', 'd', 'ing', 'ly', 'er', 'est', 'ers']) AS x),
v AS (SELECT DISTINCT w FROM t),
f AS (SELECT w, w AS form FROM v UNION SELECT w, left(w, length(w) - length(x)) FROM v, s WHERE ends_with(w, x) AND length(w) - length(x) >= 2
 UNION SELECT w, left(w, length(w) - length(x)) || 'e' FROM v, s WHERE ends_with(w, x) AND length(w) - length(x) >= 2
 UNION SELECT w, left(w, length(w) - length(x) - 1) FROM v, s WHERE ends_with(w, x) AND length(w) - length(x) > 2 AND w[length(w) - length(x)] = w[length(w) - length(x) - 1]),
k AS (SELECT DISTINCT f.w FROM f JOIN lex ON form = lex.w)
SELECT a.article_id, round(count(k.w) / nullif(count(t.w), 0), 6) AS dict_rate, count(t.w) AS dict_ntok FROM (SELECT DISTINCT article_id FROM articles) a LEFT JOIN t USING (article_id) LEFT JOIN k ON k.w = t.w GROUP BY 1"""
)
def dictionary_rate(spark: SparkSession, d: str) -> DataFrame:
    lexicon = table(spark, d, "topic_labels").select(F.explode("top_terms").alias("word"))
    r = T.dictionary_rate(articles(spark, d, "article_id", "text"), "article_id", "text", lexicon)
    return r.select("article_id", F.round("dict_rate", 6).alias("dict_rate"), "dict_ntok")


@query(
    f"""WITH s AS (SELECT scan_id, date, list_transform(bboxes, lambda b: b.id) AS ids, list_transform(bboxes, lambda b: coalesce(b.legibility, 'NA')) AS marks FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY arrived_at, member_name) AS r FROM scans) WHERE r = 1),
m AS (SELECT scan_id, CASE WHEN length(date) >= 10 AND regexp_matches(date, '^[0-9]{{4}}') THEN TRY_CAST(substring(date, 1, 4) AS INTEGER) END AS year, list_transform([1, 2], lambda i: coalesce(list_last(list_filter(list_zip(ids, marks), lambda z: z[1] = i))[2], 'NA')) AS l FROM s),
a AS (SELECT scan_id, article_id, regexp_replace(min(coalesce(text, '')), '^{WS}+|{WS}+$', '', 'g') AS t FROM articles GROUP BY 1, 2),
j AS (SELECT year, CASE WHEN list_contains(l, 'Illegible') THEN 'Illegible' WHEN list_contains(l, 'Questionable') THEN 'Questionable' WHEN list_contains(l, 'Legible') THEN 'Legible' ELSE 'NA' END AS legibility, length(t) AS n, trim(regexp_replace(t, '{WS}+', ' ', 'g')) AS u FROM a JOIN m USING (scan_id) WHERE year IS NOT NULL)
SELECT year, legibility, count(*) AS n_articles, sum(n)::BIGINT AS chars, sum(len(string_split(u, ' ')))::BIGINT AS words FROM j WHERE n BETWEEN 200 AND 20000 AND legibility <> 'Illegible' GROUP BY 1, 2"""
)
def parsed_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans rebuilt as JSON from their rows (the first to arrive) and parsed again with the articles of the scan."""
    row = F.struct("member_name", "title", "lccn", "state", "date", "edition", "page_number", "scan_url", "bboxes")
    s = table(spark, d, "scans").groupBy("scan_id").agg(F.min_by(row, F.struct("arrived_at", "member_name")).alias("r")).select("scan_id", "r.*")
    a = table(spark, d, "articles").groupBy("scan_id", "article_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("headline").alias("headline"), F.min("byline").alias("byline"))
    arts = a.groupBy("scan_id").agg(F.collect_list(F.struct(F.array(F.lit(1), F.lit(2)).alias("object_ids"), F.col("text").alias("article"), "headline", "byline", F.col("article_id").alias("full_article_id"))).alias("x"))
    j = s.join(arts, "scan_id").select(
        "member_name",
        F.to_json(F.struct(F.struct("title", "lccn", "state").alias("lccn"), F.struct("date", "edition").alias("edition"), "page_number", "scan_url", "bboxes", F.col("x").alias("full articles"))).alias("payload"),
    )
    p = parse_scans(j, "member_name", "payload", license_text="CC0")
    return p.groupBy("year", "legibility").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"))


@query(
    """WITH a AS (SELECT article_id, min(year) AS year, min(text) AS text FROM articles GROUP BY 1), k AS (SELECT article_id, year, sha1(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) AS k FROM a)
SELECT article_id, min(article_id) OVER w AS exact_group, count(*) OVER w AS exact_size FROM k WINDOW w AS (PARTITION BY year, k)"""
)
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("text").alias("text"))
    return duplicates.exact_groups(a, "article_id", "text", "year").select("article_id", F.col("group").alias("exact_group"), F.col("size").alias("exact_size"))


_SETS = """a AS (SELECT article_id, min(year) AS year, min(text) AS text FROM articles GROUP BY 1), w AS (SELECT article_id, year, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM a),
s AS (SELECT DISTINCT article_id, year, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g FROM (SELECT article_id, year, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT article_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.article_id AS a, y.article_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.year = y.year AND x.article_id < y.article_id GROUP BY 1, 2)"""


@query("WITH " + _SETS + " SELECT a, b, round(k / (u.n + v.n - k), 6) AS similarity FROM p JOIN n u ON u.article_id = a JOIN n v ON v.article_id = b WHERE k >= 0.8 * (u.n + v.n - k)")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("text").alias("text"))
    return duplicates.similar_pairs(a, "article_id", "text", "year").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "WITH RECURSIVE " + _SETS + ", e AS (SELECT a, b FROM p JOIN n u ON u.article_id = a JOIN n v ON v.article_id = b WHERE k >= 0.8 * (u.n + v.n - k)), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "r AS (SELECT a AS node, a AS seen FROM z UNION SELECT r.node, z.b FROM r JOIN z ON z.a = r.seen), l AS (SELECT node, min(seen) AS near FROM r GROUP BY 1), "
    "g AS (SELECT a.article_id, a.year, coalesce(l.near, a.article_id) AS near_group FROM a LEFT JOIN l ON l.node = a.article_id) "
    "SELECT article_id, near_group, count(*) OVER (PARTITION BY near_group) AS near_size, row_number() OVER (PARTITION BY near_group ORDER BY year, article_id) > 1 AS near_dup FROM g"
)
def dup_flags(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("text").alias("text"))
    g = duplicates.near_groups(a, "article_id", "text", "year").join(a.select("article_id", "year"), "article_id")
    return duplicates.dup_flags(g, "near_group", [F.col("year"), F.col("article_id")], "near").select("article_id", "near_group", "near_size", "near_dup")


_TOPICAL = "SELECT DISTINCT a.article_id, a.text, t.topic, l.section FROM articles a JOIN (SELECT article_id, min(topic) AS topic FROM article_topics GROUP BY 1) t USING (article_id) JOIN topic_labels l ON l.topic = t.topic"


def _topical(spark: SparkSession, d: str) -> DataFrame:
    t = topics(spark, d).groupBy("article_id").agg(F.min("topic").alias("topic"))
    return articles(spark, d, "article_id", "text").join(t, "article_id").join(F.broadcast(table(spark, d, "topic_labels").select("topic", "section")), "topic")  # 19 labels


def _words(c):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


@query(f"SELECT section, word, count(*) AS n FROM (SELECT section, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM ({_TOPICAL})) GROUP BY 1, 2")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return words.word_counts(_topical(spark, d), _words(F.col("text")), ["section"])


@query(f"SELECT topic, word, n, rank FROM (SELECT topic, word, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank FROM (SELECT topic, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word, count(*) AS n FROM ({_TOPICAL}) GROUP BY 1, 2)) WHERE rank <= 18")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """The leading terms of every labelled topic."""
    n = words.word_counts(_topical(spark, d), _words(F.col("text")), ["topic"])
    down = F.lpad(F.conv((F.lit(2**39) - F.col("n")).cast("string"), 10, 16), 10, "0")  # a hexadecimal key that falls with the count
    top = ranking.first_n(n.withColumn("_h", down), ["topic"], [F.col("_h"), F.col("word")], 18)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("_h", "word")).cast("long")).select("topic", "word", "n", "rank")


_COUNTS = f"""w AS (SELECT topic % 3 AS st, topic % 2 = 0 AS side, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM ({_TOPICAL})),
c AS (SELECT st, word, count(*) FILTER (WHERE side)::DOUBLE AS n_a, count(*) FILTER (WHERE NOT side)::DOUBLE AS n_b FROM w GROUP BY 1, 2)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    rows = words.word_rows(_topical(spark, d).withColumn("st", F.col("topic") % 3).withColumn("side", F.col("topic") % 2 == 0), _words(F.col("text")), ["st", "side"])
    return rows.groupBy("st", "word").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b"))


_LO = """t AS (SELECT st, sum(n_a) AS ta, sum(n_b) AS tb, sum(n_a + n_b + 0.01::DOUBLE) AS tp FROM c GROUP BY 1),
x AS (SELECT c.*, t.ta, t.tb, 1000::DOUBLE * (n_a + n_b + 0.01::DOUBLE) / tp AS al FROM c JOIN t USING (st)),
lo AS (SELECT st, word, n_a, n_b, ln((n_a + al) / (ta + 1000 - n_a - al)) - ln((n_b + al) / (tb + 1000 - n_b - al)) AS delta, 1 / (n_a + al) + 1 / (n_b + al) AS var FROM x)"""


@query(f"WITH {_COUNTS}, {_LO} SELECT st, word, n_a, n_b, round(delta, 6) AS delta, round(var, 6) AS var, round(delta / sqrt(var), 6) AS z FROM lo")
def log_odds(spark: SparkSession, d: str) -> DataFrame:
    r = words.log_odds(_counts(spark, d), "a", "b", ["st"])
    return r.select("st", "word", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("delta", "var", "z")])


@query(f"WITH {_COUNTS}, {_LO} SELECT word, sum(n_a + n_b) AS n, round(sum(delta / var) / sum(1 / var), 6) AS delta, round(sum(delta / var) / sum(1 / var) * sqrt(sum(1 / var)), 6) AS z FROM lo WHERE st IN (SELECT st FROM t WHERE ta >= 200 AND tb >= 200) GROUP BY 1 HAVING sum(n_a + n_b) >= 25")
def log_odds_pooled(spark: SparkSession, d: str) -> DataFrame:
    r = words.pooled_log_odds(_counts(spark, d), "a", "b", "st")
    return r.select("word", "n", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


@query(
    f"WITH {_COUNTS}, {_LO}, pl AS (SELECT word, sum(n_a + n_b) AS n, sum(delta / var) / sum(1 / var) AS delta, sum(delta / var) / sum(1 / var) * sqrt(sum(1 / var)) AS z FROM lo WHERE st IN (SELECT st FROM t WHERE ta >= 200 AND tb >= 200) GROUP BY 1 HAVING sum(n_a + n_b) >= 25), "
    f"pp AS (SELECT *, {M.normal_p('z')} AS p FROM pl), r AS (SELECT *, row_number() OVER (ORDER BY p, abs(z) DESC) AS r, count(*) OVER () AS m FROM pp) "
    "SELECT word, n, round(delta, 6) AS delta, round(z, 6) AS z, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r"
)
def log_odds_significance(spark: SparkSession, d: str) -> DataFrame:
    """Pooled log-odds with normal p-values and false-discovery control."""
    r = bh_fdr(with_normal_p(words.pooled_log_odds(_counts(spark, d), "a", "b", "st")), "p")
    return r.select("word", "n", *[F.round(c, 6).alias(c) for c in ("delta", "z", "p", "q")])


@query(
    f"WITH {_COUNTS}, {_LO}, z AS (SELECT st, word, round(delta / sqrt(var), 6) AS z FROM lo), r AS (SELECT st, word, z, 'low' AS side, row_number() OVER (PARTITION BY st ORDER BY z, word) AS rank FROM z UNION ALL SELECT st, word, z, 'high', row_number() OVER (PARTITION BY st ORDER BY z DESC, word) FROM z) SELECT * FROM r WHERE rank <= 20"
)
def top_words(spark: SparkSession, d: str) -> DataFrame:
    z = words.log_odds(_counts(spark, d), "a", "b", ["st"]).select("st", "word", F.round("z", 6).alias("z"))
    return words.top_words(z, ["st"]).select("st", "word", "z", "side", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH t AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df, sum(n) AS total FROM t GROUP BY 1), k AS (SELECT count(DISTINCT doc_id) AS nd FROM documents),
v AS (SELECT word, ln((1 + nd) / (1 + df)) + 1 AS idf FROM d, k WHERE df >= 15 AND df <= nd * 0.35::DOUBLE ORDER BY total DESC, word LIMIT 25000),
x AS (SELECT doc_id, word, (1 + ln(n)) * idf AS w FROM t JOIN v USING (word))
SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM x"""
)
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    r = words.tfidf(table(spark, d, "documents"), "doc_id", _words(F.col("text")))
    return r.select("doc_id", "word", F.round("tfidf", 6).alias("tfidf"))


_TITLES = "|".join(sorted((w.capitalize() for w in rules.L.COURTESY), key=lambda w: (-len(w), w)))


@query(
    rf"""SELECT mention, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b(?:{_TITLES})\b\.? (?:[A-Z]\. ){{0,2}}[A-Z][A-Za-z''-]+(?: (?:[A-Z]\.|[A-Z][A-Za-z''-]+))?')) AS mention
FROM (SELECT DISTINCT article_id, text FROM articles)) GROUP BY 1"""
)
def pattern_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = articles(spark, d, "article_id", "text").select(F.explode(rules.pattern_mentions(F.col("text"))).alias("mention"))
    return m.groupBy("mention").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT article_id, lower(text) AS t FROM articles WHERE text IS NOT NULL), s AS (SELECT article_id, unnest(string_split(t, '.')) AS st, generate_subscripts(string_split(t, '.'), 1) - 1 AS sent FROM a),
k AS (SELECT article_id, sent, unnest(regexp_extract_all(st, '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(st, '[a-z]+'), 1) - 1 AS i FROM s),
lex AS (SELECT DISTINCT lower(u) AS word, section AS role FROM (SELECT section, unnest(top_terms) AS u FROM topic_labels)), m AS (SELECT article_id, sent, i FROM k WHERE word IN ('mr', 'mrs', 'miss', 'the'))
SELECT role, count(*) AS n FROM (SELECT DISTINCT k.article_id, m.sent, m.i AS m, role FROM k JOIN lex USING (word) JOIN m ON m.article_id = k.article_id AND m.sent = k.sent WHERE k.i >= m.i - 10 AND k.i < m.i + 11 AND k.i <> m.i) GROUP BY 1"""
)
def lexical_window_roles(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "text").where("text is not null")
    s = a.select("article_id", F.posexplode(F.split(F.lower("text"), r"\.")).alias("sent", "st"))
    k = s.select("article_id", "sent", F.posexplode(F.regexp_extract_all("st", F.lit("[a-z]+"), F.lit(0))).alias("i", "word"))
    lexicon = table(spark, d, "topic_labels").select(F.explode("top_terms").alias("word"), F.col("section").alias("role")).withColumn("word", F.lower("word")).distinct()
    m = k.where(F.col("word").isin("mr", "mrs", "miss", "the")).select("article_id", F.struct("sent", "i").alias("m"), "sent", F.col("i").alias("s"), (F.col("i") + 1).alias("e"))
    return rules.lexical_window_roles(k, m, F.broadcast(lexicon)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))  # 19 x 12 terms


@query(
    """WITH t AS (SELECT article_id, topic, topic_weight FROM article_topics WHERE topic_weight IS NOT NULL UNION ALL SELECT article_id, topic + 1, topic_weight - topic_margin FROM article_topics WHERE topic_weight IS NOT NULL),
r AS (SELECT article_id, topic, topic_weight, row_number() OVER (PARTITION BY article_id ORDER BY topic_weight DESC, topic) AS k, lead(topic_weight) OVER (PARTITION BY article_id ORDER BY topic_weight DESC, topic) AS nx FROM t)
SELECT article_id, CASE WHEN topic_weight > 0 THEN topic ELSE -1 END AS topic, round(topic_weight, 6) AS topic_weight, round(topic_weight - coalesce(nx, 0), 6) AS margin FROM r WHERE k = 1"""
)
def top1_margin(spark: SparkSession, d: str) -> DataFrame:
    t = topics(spark, d).where("topic_weight is not null")
    u = t.select("article_id", "topic", "topic_weight").unionAll(t.select("article_id", (F.col("topic") + 1).alias("topic"), F.col("topic_weight") - F.col("topic_margin")))
    r = ranking.top1_margin(u, "article_id", "topic", "topic_weight")
    return r.select("article_id", "topic", F.round("topic_weight", 6).alias("topic_weight"), F.round("margin", 6).alias("margin"))


@query(
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'F' ELSE 'UNKNOWN' END AS gender_text, (CASE WHEN event_type = 'click' THEN 'CIVIC' ELSE '' END) AS roles FROM events"
)
def parse_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.concat(F.lit('Sure! {"is_person": true, "gender_text": "'), F.when(k % 2 == 0, "f").otherwise("x"), F.lit('", "roles": ["NONE", "'), F.when(F.col("event_type") == "click", "CIVIC").otherwise("BOGUS"), F.lit('"], "confidence": 0.5} done'))
    e = table(spark, d, "events").select("event_id", "event_type", k.alias("k"), V.parse_reply(raw).alias("r"))
    return e.select("event_id", "event_type", "k", "r.gender_text", F.array_join("r.roles", ",").alias("roles"))

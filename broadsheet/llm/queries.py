"""The pN_ queries with production parameters, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import capping, mixing, neardup, packing, pagescan, prose, residue, sampling, subjects, titles
from broadsheet.runtime import cut, lookup_join, table

#: Size of the fixed sample.
SAMPLE = 5000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that the cap of 3 % per newspaper drops."""
    return capping.capped_newspapers(table(spark, d, "articles"), table(spark, d, "title_list")).displaced.select(F.col("id").alias("article_id"))


def p1_newspapers(spark: SparkSession, d: str) -> DataFrame:
    """Kept and displaced articles per newspaper."""
    s = capping.capped_newspapers(table(spark, d, "articles"), table(spark, d, "title_list"))
    rows = s.kept.select("contributor", F.lit(1).alias("k"), F.lit(0).alias("x")).unionByName(s.displaced.select("contributor", F.lit(0).alias("k"), F.lit(1).alias("x")))
    return rows.groupBy("contributor").agg(F.sum("k").alias("kept"), F.sum("x").alias("displaced"))


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles, listed = table(spark, d, "articles"), table(spark, d, "title_list")
    typed = articles.where("publication_raw is not null").join(F.broadcast(listed.select("publication").distinct()), "publication", "left_anti")
    canon = cut(titles.known_newspapers(articles, listed))
    return typed, cut(titles.match_titles(typed.select(F.col("publication_raw").alias("raw")).distinct(), canon))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed newspaper each freely typed title means, or -1. The join with title_list broadcasts its 170 rows."""
    typed, found = _matches(spark, d)
    rows = lookup_join(typed.select("article_id", F.col("publication_raw").alias("raw")).where("article_id is not null").distinct(), found.select("raw", "title_id"), ["raw"])
    return rows.groupBy("article_id").agg(F.max("title_id").alias("title_id"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of typed titles without a newspaper on the list, with the number of rows."""
    typed, found = _matches(spark, d)
    counts = typed.groupBy(F.col("publication_raw").alias("raw")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(found.where("title_id = -1").select("raw", F.col("publication").alias("unlisted_newspaper")), "raw")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each article."""
    return subjects.document_subjects(table(spark, d, "articles"), table(spark, d, "article_topics"), table(spark, d, "topic_labels")).select("article_id", "topic")


def p3_composition(spark: SparkSession, d: str) -> DataFrame:
    """Articles per subject, section and year."""
    found = p3_found(spark, d).join(F.broadcast(table(spark, d, "topic_labels").select("topic", "label", "section")), "topic")
    years = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"))
    return found.join(years, "article_id").groupBy("section", "label", "year").agg(F.count(F.lit(1)).alias("n_articles"))


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("article_id is not null").select("article_id", "text")
    return prose.prose_rules(prose.text_statistics(rows))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose text is not natural prose. The condition stands behind the aggregation: as a filter below it, it would be
    pushed to the scan with every statistic inlined into it again and again."""
    return _statistics(spark, d).groupBy("article_id").agg(F.bool_or(~F.col("is_prose")).alias("_x")).where("_x").select("article_id")


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Text statistics of every article and the failed rules of all three sets."""
    s = _statistics(spark, d)
    per = s.groupBy("article_id").agg(F.min(F.struct(*prose.STATISTICS, *prose.SETS, "is_prose")).alias("x"))
    counts = {c: F.col(c).cast("long") for c in prose.STATISTICS if c.startswith("n_")}
    return per.select("article_id", "x.*").withColumns({c: F.concat_ws(",", c) for c in prose.SETS}).withColumns(counts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles with a similarity of at least 0.6 on three-word sequences."""
    pairs = neardup.near_duplicate_pairs(table(spark, d, "articles"), "article_id", "text", 3, 0.6)
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate class and number of links of every article (five words, 0.8)."""
    return neardup.near_duplicate_classes(table(spark, d, "articles"), "article_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces of the scanned page in texts and headlines."""
    return pagescan.page_traces(table(spark, d, "articles"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of every article, with counts of what was repaired or removed."""
    rows = pagescan.repair_pages(table(spark, d, "articles"))
    n = lambda k: F.size(F.filter("traces", lambda t: t["kind"] == k)).alias(f"n_{k}")
    one = rows.groupBy("article_id").agg(F.min(F.struct("text", "headline", "traces")).alias("x")).select("article_id", "x.*")
    return one.select("article_id", "text", "headline", n("break"), n("glyph"), n("header"), n("folio"))


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample of ``SAMPLE`` distinct articles with their records."""
    return sampling.sample_rows(table(spark, d, "articles"), "article_id", SAMPLE, "arrived_at")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each capacity."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused space per capacity."""
    return packing.packing_report(p8_containers(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every use of a document with its shard and place."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares per source."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler, error or script notices."""
    return residue.flag_residue(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents free of residue."""
    return residue.clean_documents(table(spark, d, "documents"))


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages that are residue, with documents and sources."""
    return residue.residue_messages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_newspapers, p2_found, p2_unmatched, p3_found, p3_composition, p4_found, p4_statistics, p5_found, p5_classes,
        p6_found, p6_repaired, p7_sample, p8_containers, p8_report, p9_mixture, p9_report, p10_found, p10_clean, p10_messages,
    )
}

_COMMON_SQL = ", ".join("'" + w + "'" for w in sorted({w for ws in prose.COMMON.values() for w in ws}))
_D, _L, _O = prose.RULES["document"], prose.RULES["line"], prose.RULES["archive"]


def _failed(*checks: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks) + "], lambda x: x IS NOT NULL), ',')"


_DOCUMENT = _failed(
    ("no_words", "n_words < 1"), ("stop_words", f"n_words > 0 AND n_stop < {_D['min_stop_words']}"), ("letter_words", f"n_words > 0 AND letter_token_share < {_D['min_letter_words']}::DOUBLE"),
    ("word_length", f"n_words > 0 AND (mean_word < {_D['min_mean_word']}::DOUBLE OR mean_word > {_D['max_mean_word']}::DOUBLE)"), ("symbols", f"n_words > 0 AND mark_share > {_D['max_symbol_words']}::DOUBLE"),
    ("bullets", f"n_words > 0 AND bullet_line_share > {_D['max_bullet_lines']}::DOUBLE"), ("ellipses", f"n_words > 0 AND ellipsis_line_share > {_D['max_ellipsis_lines']}::DOUBLE"), ("repetition", f"n_words > 0 AND top_pair_share > {_D['max_top_pair']}::DOUBLE"),
)
_LINE = _failed(("punctuation", f"n_words > 0 AND punct_line_share < {_L['min_punct_lines']}::DOUBLE"), ("short_lines", f"n_words > 0 AND short_line_share > {_L['max_short_lines']}::DOUBLE"), ("repeated_lines", f"n_words > 0 AND repeated_line_share > {_L['max_repeated_lines']}::DOUBLE"))
_ARCHIVE = _failed(
    ("few_common_words", f"n_words > 0 AND common_share < {_O['min_common_share']}::DOUBLE"), ("rows", f"n_words > 0 AND common_share < {_O['row_common_share']}::DOUBLE AND digit_share > {_O['row_digit_share']}::DOUBLE"),
    ("symbols", f"n_words > 0 AND symbol_share > {_O['max_symbol_share']}::DOUBLE"), ("few_letters", f"n_words > 0 AND letter_share < {_O['min_letter_share']}::DOUBLE"), ("digits", f"n_words > 0 AND digit_share > {_O['max_digit_share']}::DOUBLE"),
    ("few_words", f"n_words >= 20 AND n_distinct < sqrt(n_words) * {_O['min_distinct']}::DOUBLE"),
)
_STOP = "greatest(" + ", ".join(f"len(list_intersect(w, {ws!r}))" for ws in prose.STOP.values()) + ")"
_PROSE_SQL = rf"""
WITH a AS (SELECT DISTINCT article_id, coalesce(text, '') AS t FROM articles WHERE article_id IS NOT NULL),
b AS (SELECT article_id, t, regexp_extract_all(lower(t), '\p{{L}}+') AS w, list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 0) AS l, length(regexp_replace(t, '\s+', '', 'g')) AS dense,
 length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS digits, length(t) - length(regexp_replace(t, '[.,;:''"()?!\-]+', '', 'g')) AS marks, len(regexp_extract_all(t, '[^\s]+')) AS nt FROM a),
c AS (SELECT *, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS letters, len(w) AS n, len(l) AS nl, list_aggregate(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), 'histogram') AS pairs FROM b),
s AS (SELECT article_id, length(t) AS n_chars, n AS n_words, nt AS n_tokens, {_STOP} AS n_stop, letters::DOUBLE / nullif(n, 0) AS mean_word, len(regexp_extract_all(t, '\p{{L}}[^\s]*'))::DOUBLE / nullif(nt, 0) AS letter_token_share,
 len(regexp_extract_all(t, '#|\.\.\.|…'))::DOUBLE / nullif(nt, 0) AS mark_share, letters::DOUBLE / nullif(dense, 0) AS letter_share, digits::DOUBLE / nullif(dense, 0) AS digit_share,
 (dense - letters - digits - marks)::DOUBLE / nullif(dense, 0) AS symbol_share, nl AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;,"'')]\s*$')))::DOUBLE / nullif(nl, 0) AS punct_line_share,
 len(list_filter(l, lambda x: regexp_matches(x, '^\s*([-*•–—]|[0-9]{{1,3}}[.)]) ')))::DOUBLE / nullif(nl, 0) AS bullet_line_share, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$')))::DOUBLE / nullif(nl, 0) AS ellipsis_line_share,
 len(list_filter(l, lambda x: length(x) < {prose.SHORT_LINE}))::DOUBLE / nullif(nl, 0) AS short_line_share, (nl - len(list_distinct(l)))::DOUBLE / nullif(nl, 0) AS repeated_line_share,
 len(list_filter(w, lambda x: x IN ({_COMMON_SQL})))::DOUBLE / nullif(n, 0) AS common_share,
 coalesce(list_max(list_transform(list_filter(map_entries(pairs), lambda e: e.value >= {prose.PAIR_TIMES}), lambda e: e.value * (length(e.key) - 1))), 0)::DOUBLE / nullif(letters, 0) AS top_pair_share, len(list_distinct(w)) AS n_distinct FROM c),
r AS (SELECT *, {_DOCUMENT} AS reasons, {_LINE} AS line_reasons, {_ARCHIVE} AS archive_reasons FROM s)"""


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BLANK = r"[\s\x{85}\p{Z}]"
_N = len(residue.MASKS)
_RESIDUE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents), "
    + "c AS (SELECT *, string_split_regex(regexp_replace("
    + f"regexp_replace(regexp_replace(t, {_re(residue.LINE_END)}, '\\1 \\2', 'g'), {_re(residue.LINE_END)}, '\\1 \\2', 'g'), {_re(residue.SENTENCE_END)}, '\\1' || chr(10), 'g'), '\\n+') AS m FROM d), "
    + f"r AS (SELECT doc_id, source, t, regexp_replace(u, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS u FROM (SELECT doc_id, source, t, unnest(m) AS u FROM c)), "
    + f"p AS (SELECT *, regexp_replace(u, {_re(residue.QUOTED)}, ' Q ', 'g') AS x0 FROM r), "
    + ", ".join(f"k{i} AS (SELECT *, " + (f"lower(x{i})" if m is None else f"regexp_replace(x{i}, {_re(m[0])}, {_re(m[1])}, 'g')") + f" AS x{i + 1} FROM {'p' if i == 0 else f'k{i - 1}'})" for i, m in enumerate(residue.MASKS))
    + f", f AS (SELECT doc_id, source, t, x0 AS plain, regexp_replace(x{_N}, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS message FROM k{_N - 1}), "
    + f"v AS (SELECT DISTINCT plain, message, len(regexp_extract_all(message, {_re(residue.LONG_WORD)})) AS nw, len(regexp_extract_all(message, {_re(residue._LATIN)})) AS nl FROM f), "
    + f"q AS (SELECT plain, message, CASE WHEN regexp_matches(plain, {_re(residue._HOLDER)}) THEN 'placeholder' WHEN regexp_matches(message, {_re(residue._STRONG)}) THEN 'phrase' WHEN nw >= 4 AND nl >= 0.85::DOUBLE * nw THEN 'filler' WHEN regexp_matches(message, {_re(residue._WEAK)}) THEN 'weak' END AS sign FROM v), "
    + "s AS (SELECT f.doc_id, f.source, f.t, f.message, q.sign FROM f JOIN q ON f.plain = q.plain AND f.message = q.message WHERE f.message <> ''), "
    + "y AS (SELECT t, source, bool_or(coalesce(sign, 'weak') <> 'weak') AS sure FROM s GROUP BY 1, 2), n AS (SELECT DISTINCT t, source, message FROM s), "
    + "per AS (SELECT message, count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE sure) AS n_marked, count(DISTINCT t) AS nt, count(DISTINCT t) FILTER (WHERE sure) AS ns FROM n JOIN y USING (t, source) GROUP BY 1), "
    + "own AS (SELECT message, max(sign) FILTER (WHERE sign <> 'weak') AS rule FROM s WHERE sign IS NOT NULL GROUP BY 1), "
    + f"kinds AS (SELECT per.message, n_docs, n_sources, n_marked, CASE WHEN own.message IS NULL THEN CASE WHEN n_sources >= {residue.MIN_SOURCES} AND n_docs >= {residue.MIN_DOCS} AND n_marked >= {residue.COMPANY}::DOUBLE * n_docs AND nt >= {residue.MIN_DOCS} AND ns >= {residue.COMPANY}::DOUBLE * nt THEN 'company' END "
    + f"ELSE coalesce(rule, CASE WHEN n_sources >= {residue.MIN_SOURCES} THEN 'recurring' END) END AS kind FROM per LEFT JOIN own USING (message)), "
    + "found AS (SELECT doc_id FROM s WHERE sign <> 'weak' UNION SELECT doc_id FROM s JOIN kinds USING (message) WHERE kind IN ('recurring', 'company')) "
)

SQL: dict[str, str] = {
    "p10_found": _RESIDUE_SQL + "SELECT doc_id FROM found",
    "p10_clean": _RESIDUE_SQL + "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    "p10_messages": _RESIDUE_SQL + "SELECT message, n_docs, n_sources, n_marked, kind FROM kinds WHERE kind IS NOT NULL",
    "p5_classes": """
WITH RECURSIVE t AS (SELECT DISTINCT article_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM articles WHERE article_id IS NOT NULL),
k AS (SELECT article_id, w, min(article_id) OVER (PARTITION BY w) AS rep FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT article_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g FROM (SELECT article_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM k WHERE article_id = rep)),
n AS (SELECT article_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.article_id AS x, b.article_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.article_id < b.article_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.article_id = x JOIN n q ON q.article_id = y WHERE k >= 0.8 * (p.n + q.n - k)), z AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x AS node, x AS seen FROM z UNION SELECT r.node, z.y FROM r JOIN z ON z.x = r.seen), l AS (SELECT node, min(seen) AS near FROM r GROUP BY 1), d AS (SELECT x, count(*) AS links FROM z GROUP BY 1)
SELECT article_id, coalesce(near, rep) AS "group", rep AS copies_group, coalesce(links, 0) AS links FROM k LEFT JOIN l ON l.node = rep LEFT JOIN d ON d.x = rep""",
    "p4_statistics": _PROSE_SQL + " SELECT *, reasons = '' AS is_prose FROM r",
    "p4_found": _PROSE_SQL + " SELECT article_id FROM r WHERE reasons <> ''",
    "p5_found": """
WITH t AS (SELECT DISTINCT article_id, text FROM articles WHERE article_id IS NOT NULL),
w AS (SELECT article_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
s AS (SELECT DISTINCT article_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT article_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT article_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.article_id AS x, b.article_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.article_id < b.article_id GROUP BY 1, 2)
SELECT x AS article_id_a, y AS article_id_b FROM c JOIN n p ON p.article_id = x JOIN n q ON q.article_id = y
WHERE k >= 0.6 * (p.n + q.n - k)""",
}

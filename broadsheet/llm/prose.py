"""Per-document text statistics and fixed-threshold rules that tell natural prose from lists, tables and junk.

All statistics are built-in column expressions over the whole text (one scan, no shuffle); every rule that fails is recorded
with its reason. Three named sets of rules:

* ``document``: the published quality and repetition heuristics for documents of a web corpus (Rae et al. 2021, appendix A), at
  their published values. They decide. Left out are the bounds of 50 and 100,000 words, for short notices are prose here, and
  the list of English stop words has its counterpart for every language of the archive.
* ``line``: the published line heuristics of a later web corpus (Penedo et al. 2024). They are recorded only: they expect
  lines as their authors ended them, while here the column of the page ends them.
* ``archive``: own values for shares of characters and common words, chosen on the given tables; recorded for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the archive.
COMMON = {
    "en": "a about after all an and any are as at be been before but by can did do for from had has have he her him his how if in into is it its may more most not of on one or other our out over she so some such than that the their them then there they this those to under until up upon was we were what when where which while who will with would you".split(),
    "de": "aber alle als am an auch auf aus bei beim bis da das dem den der des die doch ein eine einem einen einer er es für hat hatte im in ist kein mit nach nicht noch oder sehr sich sie sind so über um und uns unser unter vom von vor war waren wird wurde zu zum zur".split(),
    "es": "a al ante cerca como con contra de del desde don donde doña el ella en entre era es esta este fue ha había hasta la las le lo los más muy no nos o para pero por que se según sin sobre su sus toda todos un una y".split(),
    "fr": "à au aux avec cet cette ce chez comme dans de des du elle en est et eu hier il ils ici la le les leur lui mais ne nos notre nous on ont ou par pas plus pour près que qui sa se ses son sont sous sur tout tous un une y été".split(),
}
#: The published stop words, and the eight most frequent function words of the other languages.
STOP = {
    "en": "the be to of and that have with".split(),
    "de": "der die und das von mit zu ist".split(),
    "es": "de la que el en y los con".split(),
    "fr": "de la le et les des en que".split(),
}
#: Thresholds of the rules by set. document: Rae et al. 2021; line: Penedo et al. 2024; archive: own.
RULES = {
    "document": {"min_stop_words": 2, "min_letter_words": 0.8, "min_mean_word": 3.0, "max_mean_word": 10.0, "max_symbol_words": 0.1, "max_bullet_lines": 0.9, "max_ellipsis_lines": 0.3, "max_top_pair": 0.2},
    "line": {"min_punct_lines": 0.12, "max_short_lines": 0.67, "max_repeated_lines": 0.1},
    "archive": {"min_common_share": 0.20, "row_common_share": 0.27, "row_digit_share": 0.12, "max_symbol_share": 0.25, "min_letter_share": 0.45, "max_digit_share": 0.30, "min_distinct": 1.6},
}
#: A pair of words that stands less often is no repetition; characters of a short line.
PAIR_TIMES, SHORT_LINE = 3, 30

STATISTICS = (
    "n_chars n_words n_tokens n_stop mean_word letter_token_share mark_share letter_share digit_share symbol_share n_lines punct_line_share bullet_line_share ellipsis_line_share short_line_share "
    "repeated_line_share common_share top_pair_share n_distinct"
).split()

#: Columns with the failed rules of each set.
SETS = ["reasons", "line_reasons", "archive_reasons"]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``STATISTICS``. They are plain columns: fields of a struct would be inlined, and computed
    again, wherever a rule reads them; columns nobody reads are pruned.

    A null text counts as empty; an empty text has zero counts and null shares. Input columns with the name of a
    statistic are replaced, others kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    lines = F.filter(F.split(t, r"\n"), lambda x: F.length(F.trim(x)) > 0)
    common = sorted({w for ws in COMMON.values() for w in ws})
    # a pair of words is a number: a hash of both, with their letters in the last 16 bits
    pair = lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(-1 << 16)).bitwiseOR(F.least(F.length(a) + F.length(b), F.lit((1 << 16) - 1)).cast("long"))
    pairs = F.when(F.size("_w") > 1, F.sort_array(F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), pair)))
    d = df.withColumn("_w", words).withColumn("_l", lines)
    n, nl, nc = F.size("_w"), F.size("_l"), F.length(t)
    letters = F.aggregate("_w", F.lit(0), lambda acc, w: acc + F.length(w))
    dense = F.length(F.regexp_replace(t, r"\s+", ""))
    digits = _count(t, "[0-9]+")
    tokens = F.regexp_count(t, F.lit(r"[^\s]+"))
    share = lambda c, whole: F.try_divide(c.cast("double"), whole.cast("double"))
    part = lambda col, f: share(F.size(F.filter(col, f)), F.size(col))
    stop = lambda k: F.size(F.array_intersect("_w", F.array(*[F.lit(w) for w in STOP[k]])))
    # the pair of words that takes up most characters: runs of the sorted pairs
    run = F.aggregate(
        F.coalesce(pairs, F.array().cast("array<bigint>")),
        F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("best")),
        lambda a, x: F.struct(x.alias("p"), F.when(x == a["p"], a["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when((x == a["p"]) & (a["n"] + 1 >= PAIR_TIMES), F.greatest(a["best"], (a["n"] + 1) * x.bitwiseAND(F.lit((1 << 16) - 1)))).otherwise(a["best"]).alias("best")),
        lambda a: a["best"],
    )
    return d.select(
        *[F.col(c) for c in df.columns if c not in STATISTICS],
        nc.alias("n_chars"),
        n.alias("n_words"),
        tokens.alias("n_tokens"),
        F.greatest(*[stop(k) for k in STOP]).alias("n_stop"),
        share(letters, n).alias("mean_word"),
        share(F.regexp_count(t, F.lit(r"\p{L}[^\s]*")), tokens).alias("letter_token_share"),
        share(F.regexp_count(t, F.lit(r"#|\.\.\.|…")), tokens).alias("mark_share"),
        share(letters, dense).alias("letter_share"),
        share(digits, dense).alias("digit_share"),
        share(dense - letters - digits - _count(t, r"[.,;:'\"()!?\-]+"), dense).alias("symbol_share"),
        nl.alias("n_lines"),
        part("_l", lambda x: x.rlike(r"[.!?:;,\"')]\s*$")).alias("punct_line_share"),
        part("_l", lambda x: x.rlike(r"^\s*([-*•–—]|\d{1,3}[.)]) ")).alias("bullet_line_share"),
        part("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("ellipsis_line_share"),
        part("_l", lambda x: F.length(x) < SHORT_LINE).alias("short_line_share"),
        share(nl - F.size(F.array_distinct("_l")), nl).alias("repeated_line_share"),
        part("_w", lambda w: w.isin(common)).alias("common_share"),
        share(run, letters).alias("top_pair_share"),
        F.size(F.array_distinct("_w")).alias("n_distinct"),
    )


def prose_rules(df: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """Adds ``reasons``, ``line_reasons`` and ``archive_reasons`` (arrays of failed rules of each set, in a fixed order) and
    ``is_prose`` (no rule of the set ``document`` failed) to a table with text statistics. ``rules`` changes thresholds per set.
    A text without words fails ``no_words`` only."""
    r = {k: v | (rules or {}).get(k, {}) for k, v in RULES.items()}
    s = lambda k: F.col(k)
    some = s("n_words") >= 1
    doc, line, own = r["document"], r["line"], r["archive"]
    sets = {
        "reasons": [
            ("no_words", ~some),
            ("stop_words", some & (s("n_stop") < doc["min_stop_words"])),
            ("letter_words", some & (s("letter_token_share") < doc["min_letter_words"])),
            ("word_length", some & ((s("mean_word") < doc["min_mean_word"]) | (s("mean_word") > doc["max_mean_word"]))),
            ("symbols", some & (s("mark_share") > doc["max_symbol_words"])),
            ("bullets", some & (s("bullet_line_share") > doc["max_bullet_lines"])),
            ("ellipses", some & (s("ellipsis_line_share") > doc["max_ellipsis_lines"])),
            ("repetition", some & (s("top_pair_share") > doc["max_top_pair"])),
        ],
        "line_reasons": [
            ("punctuation", some & (s("punct_line_share") < line["min_punct_lines"])),
            ("short_lines", some & (s("short_line_share") > line["max_short_lines"])),
            ("repeated_lines", some & (s("repeated_line_share") > line["max_repeated_lines"])),
        ],
        "archive_reasons": [
            ("few_common_words", some & (s("common_share") < own["min_common_share"])),
            ("rows", some & (s("common_share") < own["row_common_share"]) & (s("digit_share") > own["row_digit_share"])),
            ("symbols", some & (s("symbol_share") > own["max_symbol_share"])),
            ("few_letters", some & (s("letter_share") < own["min_letter_share"])),
            ("digits", some & (s("digit_share") > own["max_digit_share"])),
            ("few_words", (s("n_words") >= 20) & (s("n_distinct") < F.sqrt(s("n_words")) * own["min_distinct"])),
        ],
    }
    failed = {k: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull()) for k, checks in sets.items()}
    return df.withColumns(failed).withColumn("is_prose", F.size("reasons") == 0)

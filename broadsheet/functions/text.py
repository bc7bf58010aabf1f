"""Text functions: Column in, Column out, all inside whole-stage code. Word and blank classes are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
#: Blanks as the source texts know them (all Unicode white space and the ASCII separators).
S = r"[\s\x1c-\x1f\x85\p{Z}]"

# Abbreviated titles whose doubled dot is repaired, quotes that are flattened, characters that are no junk.
DOTTED_TITLES = ["Mr", "Mrs", "Dr", "Rev", "Messrs", "Mme", "Jr", "Sr"]
CURLY, STRAIGHT = "“”„‘’", "\"\"\"''"
CLEAN_MARKS = r".,;:'\"\-()?!$%&"
#: Suffixes a dictionary look-up may strip, in the order they are tried.
SUFFIXES = ["'s", "s", "es", "ed", "d", "ing", "ly", "er", "est", "ers"]


def text_normalize(c: Column) -> Column:
    """Join line-break hyphenation, flatten line ends, straighten quotes, repair doubled dots, squeeze, strip; null is ''."""
    x = F.coalesce(c, F.lit(""))
    x = F.regexp_replace(x, rf"({W})-{S}*\n{S}*({W})", "$1$2")
    x = F.regexp_replace(x, rf"{S}*\n{S}*", " ")
    x = F.translate(x, CURLY, STRAIGHT)
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])(" + "|".join(DOTTED_TITLES) + r")\.{2,}", "$1.")
    x = F.regexp_replace(x, "''|,,", '"')
    x = F.regexp_replace(x, r"[ \t]{2,}", " ")
    return F.regexp_replace(x, rf"^{S}+|{S}+$", "")


def title_normalize(c: Column) -> Column:
    """Newspaper title without bracketed parts and year ranges, squeezed, stripped of marks, lower case; null is ''."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i){S}*(\[[^\]]*\]|\([^)]*\)|[0-9]{{2}}[0-9?]{{2}}{S}*-{S}*([0-9]{{2}}[0-9?]{{2}}|current|\?{{2,4}})){S}*", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(x, rf"{S}+", " "), r"^[ .,;:\-]+|[ .,;:\-]+$", ""))


def page_from_member(c: Column) -> Column:
    """Page number in a member name like ``x_p12_y.json``; null if it has none."""
    return F.nullif(F.regexp_extract(c, r"_p([0-9]+)_", 1), F.lit("")).cast("int")


def article_key(scan_id: Column, number: Column) -> Column:
    return F.concat(F.lit("as1-"), F.substring(F.sha1(F.concat(scan_id, F.lit("::"), number.cast("string"))), 1, 16))


def squeeze(c: Column) -> Column:
    """Blanks collapsed to one, ends stripped; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{S}+", " "), "^ | $", "")


def word_count(c: Column) -> Column:
    x = squeeze(c)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def legibility_of(marks: Column) -> Column:
    """The worst mark of an array: Illegible, Questionable, Legible, else NA (nulls and other values count as NA)."""
    has = lambda v: F.coalesce(F.array_contains(marks, v), F.lit(False))
    return F.when(has("Illegible"), "Illegible").when(has("Questionable"), "Questionable").when(has("Legible"), "Legible").otherwise("NA")


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def once(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once per row: as a lambda variable it isn't computed again where f uses it, in
    particular not for each element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def exact_key(c: Column) -> Column:
    """Hash that is equal for texts with the same tokens."""
    return F.sha1(F.array_join(tokens(c), " "))


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct k-grams of tokens; a text of fewer than k tokens has one of all its tokens, one without tokens none."""

    def grams(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(every))

    return once(tokens(c), grams)


def junk_rate(c: Column) -> Column:
    """Share of characters that are no letter, digit, blank or usual mark; null for empty and null texts."""
    bad = F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{CLEAN_MARKS}]|{S}", ""))
    return F.try_divide(bad, F.nullif(F.length(c), F.lit(0)))


def bow_text(ctx: Column, start: Column, end: Column, n: int = 20) -> Column:
    """Words round the span [start, end): the last and first ``n``, a placeholder for the span, and the three nearest marked."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    last = lambda a, k: F.when(F.size(a) > k, F.slice(a, F.size(a) - k + 1, k)).otherwise(a)

    def joined(left: Column, right: Column) -> Column:
        near = F.concat(F.transform(last(left, 3), lambda w: F.concat(F.lit("l_"), w)), F.transform(F.slice(right, 1, 3), lambda w: F.concat(F.lit("r_"), w)))
        return F.array_join(F.concat(last(left, n), F.array(F.lit("tgtperson")), F.slice(right, 1, n), near), " ")

    return once(F.struct(words(F.substring(ctx, F.lit(1), start)).alias("l"), words(F.substr(ctx, end + 1)).alias("r")), lambda x: joined(x["l"], x["r"]))


def quote_length(c: Column) -> Column:
    """Characters between paired quotation marks; after a single mark, those up to the end."""

    def inner(parts: Column) -> Column:
        odd = F.filter(parts, lambda x, i: (i % 2 == 1) & (i < F.size(parts) - 1))
        return F.when(F.size(parts) == 2, F.length(F.element_at(parts, 2))).otherwise(F.aggregate(odd, F.lit(0), lambda a, x: a + F.length(x)))

    return once(F.split(c, '"'), inner)


def context_window(text: Column, start: Column, end: Column, pad: int = 160) -> Column:
    """struct(ctx, from_char): the text from ``pad`` characters before ``start`` to ``pad`` after ``end``, widened to blanks."""
    a, b = F.greatest(start - pad, F.lit(0)), F.least(end + pad, F.length(text))
    head = F.regexp_extract(F.substring(text, F.lit(1), a), r"[^\s]*\z", 0)
    tail = F.regexp_extract(F.substr(text, b + 1), r"^[^\s]*", 0)
    return F.struct(F.concat(head, F.substr(text, a + 1, b - a), tail).alias("ctx"), (a - F.length(head)).alias("from_char"))


def mark_span(ctx: Column, start: Column, end: Column) -> Column:
    """The context with the span [start, end) in white brackets."""
    return F.concat(F.substr(ctx, F.lit(1), start), F.lit("⟦"), F.substr(ctx, start + 1, end - start), F.lit("⟧"), F.substr(ctx, end + 1))


def trim_excerpt(ctx: Column, start: Column, end: Column, pad: int = 200) -> Column:
    """The marked span with ``pad`` characters round it and dots where text was left out."""
    a, b = F.greatest(start - pad, F.lit(0)), F.least(end + pad, F.length(ctx))
    cut = F.concat(F.substr(ctx, a + 1, start - a), F.lit("⟦"), F.substr(ctx, start + 1, end - start), F.lit("⟧"), F.substr(ctx, end + 1, b - end))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.trim(cut), F.when(b < F.length(ctx), "…").otherwise(""))


def content_word(c: Column, skip: list[str]) -> Column:
    return F.coalesce(c.rlike(r"^\p{L}+$") & ~c.isin(skip), F.lit(False))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def signed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", c)


def interval(lo: Column, hi: Column, digits: int = 2) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", lo, hi)


def trend_direction(lo: Column, hi: Column) -> Column:
    """'up' or 'down' if the interval excludes zero, else 'none'."""
    return F.when(lo > 0, "up").when(hi < 0, "down").otherwise("none")


def dictionary_rate(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(key, dict_rate, dict_ntok): share of alphabetic words of at least three letters that the lexicon knows, directly or
    after a suffix was stripped (stem, stem + e, or the stem without a doubled last letter). Words are counted once per
    document before the join; the distinct vocabulary is what is looked up, so the lexicon needs no broadcast."""
    words = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    rows = df.select(key, F.explode_outer(F.transform(words, lambda w: F.lower(w))).alias("w"))
    per = rows.groupBy(key, "w").agg(F.count("w").alias("n"))
    forms = F.array(F.col("w"))
    for s in SUFFIXES:
        stem = F.expr(f"substring(w, 1, length(w) - {len(s)})")
        double = F.when((F.length(stem) > 2) & (F.expr(f"substring(w, length(w) - {len(s)}, 1) = substring(w, length(w) - {len(s) + 1}, 1)")), F.expr(f"substring(w, 1, length(w) - {len(s) + 1})"))
        forms = F.concat(forms, F.when(F.endswith(F.col("w"), F.lit(s)) & (F.length("w") - len(s) >= 2), F.array(stem, F.concat(stem, F.lit("e")), double)).otherwise(F.array().cast("array<string>")))
    vocabulary = per.where("w is not null").select("w").distinct().withColumn("form", F.explode(F.array_distinct(F.array_compact(forms))))
    known = vocabulary.join(lexicon.select(F.lower(F.trim(word)).alias("form")).distinct(), "form", "left_semi").select("w").distinct().withColumn("hit", F.lit(1))
    scored = per.join(known, "w", "left").groupBy(key).agg(F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("h"), F.sum("n").alias("dict_ntok"))
    return scored.select(key, F.try_divide("h", F.nullif("dict_ntok", F.lit(0))).alias("dict_rate"), "dict_ntok")

"""Numeric, array, JSON and date functions of the analysis frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.lexicons import AUTHORITY, MIXED_F, ROLES, SUFFIXES

#: Right-closed periods of the long series, as (after, to, label).
PERIODS = [(1899, 1915, "1900-15"), (1915, 1930, "1918-30"), (1930, 1945, "1933-45"), (1945, 1963, "1948-63")]


def decades(year: Column, centre: int = 1930) -> Column:
    return (year - centre) / F.lit(10.0)


def page_band(p: Column) -> Column:
    return F.when(p.isNull(), "na").when(p == 1, "p1").when(p <= 4, "p2-4").when(p <= 12, "p5-12").otherwise("p13+")


def is_f(g: Column) -> Column:
    """1.0 for F, 0.0 for M, else null."""
    return F.when(g == "F", 1.0).when(g == "M", 0.0)


def role_flags(roles: Column, prefix: str, names: list[str] = ROLES, authority: list[str] = AUTHORITY) -> list[Column]:
    """One boolean column per role and one for any of the authority roles; a null list has none."""
    has = lambda v: F.coalesce(F.array_contains(roles, v), F.lit(False))
    any_of = F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, authority))), F.lit(False))
    return [has(r).alias(f"{prefix}_{r}") for r in names] + [any_of.alias(f"{prefix}_AUTHORITY")]


def multi_hot(roles: Column, names: list[str] = ROLES) -> Column:
    """Array of 0/1 per role; unknown roles are ignored."""
    return F.array(*[F.coalesce(F.array_contains(roles, r), F.lit(False)).cast("int") for r in names])


def mixed_title(titles: Column) -> Column:
    """True if the titles join a female honorific with any other title (name suffixes do not count)."""
    f = F.array(*map(F.lit, MIXED_F))
    rest = F.array_except(F.array_except(titles, f), F.array(*map(F.lit, SUFFIXES)))
    return F.coalesce(F.arrays_overlap(titles, f) & (F.size(rest) > 0), F.lit(False))


def mixed_title_gender(gender: Column, titles: Column) -> Column:
    return F.when(mixed_title(titles), "UNKNOWN").otherwise(gender)


def period(year: Column, periods=PERIODS, default: str | None = None) -> Column:
    out = F.lit(default)
    for after, to, label in reversed(periods):
        out = F.when((year > after) & (year <= to), label).otherwise(out)
    return out


def period_of(year: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Label of the first inclusive range that holds the year, else 'other'."""
    return period(year, [(a - 1, b, c) for a, b, c in ranges], "other")


def floor_bin(year: Column, width: int) -> Column:
    return (F.floor(year / width) * width).cast("int")


def ocr_clean(legibility: Column, rate: Column, least: float = 0.75) -> Column:
    return F.coalesce((legibility == "Legible") & (rate >= least), F.lit(False))


def id_prefix(key: Column) -> Column:
    """The first eight hexadecimal digits after the hyphen: a fixed pseudo-random order of keys."""
    return F.substring(F.element_at(F.split(key, "-"), 2), 1, 8)


def id_number(key: Column) -> Column:
    """The same as a number."""
    return F.conv(id_prefix(key), 16, 10).cast("long")


def over(p: Column, threshold: float) -> Column:
    return p >= F.lit(threshold)


def parse_reply(raw: Column) -> Column:
    """struct of a labelled reply: the outermost braces as JSON, coerced; null if there is no readable object."""
    body = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    d = F.from_json(body, "is_person boolean, gender_text string, roles array<string>, quoted boolean, confidence string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    g = F.upper(F.coalesce(d["gender_text"], F.lit("UNKNOWN")))
    roles = F.coalesce(d["roles"], F.array().cast("array<string>"))
    known = F.array_sort(F.array_distinct(F.filter(roles, lambda r: r.isin(ROLES))))
    reply = F.struct(
        F.coalesce(d["is_person"], F.lit(True)).alias("is_person"),
        F.when(g.isin("F", "M"), g).otherwise("UNKNOWN").alias("gender_text"),
        known.alias("roles"),
        F.coalesce(d["quoted"], F.lit(False)).alias("quoted"),
        F.try_to_number(d["confidence"], F.lit("9.999999")).cast("double").alias("confidence"),
    )
    return F.when(body.isNotNull() & d.isNotNull() & d["_bad"].isNull(), reply)


def prompt_hash(json_text: Column) -> Column:
    return F.substring(F.sha2(json_text, 256), 1, 16)


def unknown_bounds(f: Column, m: Column, u: Column) -> list[Column]:
    """Share F among classified, and its bounds if all unknown were M or F."""
    return [F.try_divide(f, f + m).alias("share_f_classified"), F.try_divide(f, f + m + u).alias("lower"), F.try_divide(f + u, f + m + u).alias("upper")]


def relative_position(first: Column, n: Column) -> Column:
    return F.round(first / F.greatest(n, F.lit(1)), 4)


def finite(c: Column, digits: int = 5) -> Column:
    """Rounded value, null for NaN and infinities."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, F.round(c, digits))


def year_of(date: Column) -> Column:
    """Year in the first four characters of a date text of at least ten characters, else null."""
    y = F.substring(date, 1, 4)
    return F.when((F.length(date) >= 10) & y.rlike("^[0-9]{4}$"), y.try_cast("int"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts: the first 13 hexadecimal digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson1(u: Column) -> Column:
    """Poisson(1) number of a uniform number through the inverse distribution; above 1 - 1e-13 it is 14."""
    import math

    out, total = F.lit(14), 0.0
    steps = []
    for k in range(14):
        total += math.exp(-1) / math.factorial(k)
        steps.append((total, k))
    for total, k in reversed(steps):
        out = F.when(u < total, k).otherwise(out)
    return out


def n_positive(share: Column, n: Column) -> Column:
    """Number of successes behind a share."""
    return F.round(share * n).cast("long")

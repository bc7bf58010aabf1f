"""Map freely typed newspaper titles to a canonical list: a partition-based pigeonhole join, SQL only.

Every reference form of length L is cut into k+1 segments; a string within edit distance k of it must
contain one segment unchanged near its place, so an equality join on (L, segment number, substring) finds
all candidates. Built-in ``levenshtein`` verifies them; what has no verified partner is unmatched (-1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.runtime import cut

#: Shortest reference form and largest edit distance by form length.
MIN_FORM, MAX_K = 1, 4
#: From this distance on, a title that reads as an abbreviation of exactly one newspaper is taken as such.
SURE = 3
#: Letters that an abbreviated word needs for a slip in it to be read over.
SLIP_LETTERS = 5

#: Usual abbreviations after a place name, lower case.
STATE_ABBR = (
    "ala ariz ark cal calif colo conn del fla ga ia ida ill ind kan kans ky la mass md me mich minn miss mo mont "
    "n c n d n h n j n m n y neb nebr nev o okla ore oreg pa penn r i s c s d tenn tex ut va vt w va wash wis wisc wyo"
).split()


def squeeze(c: Column) -> Column:
    """Lower-case letters and digits only, '&' read as 'and'."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), r"[^\p{L}\p{N}]", "")


def norm_lccn(c: Column) -> Column:
    """An lccn without prefix, case, blanks and hyphens; null if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*lccn\s*:?", ""), r"[^a-z0-9]", "")
    return F.when(F.length(x) > 0, x)


def spoken_title(raw: Column) -> Column:
    """The title without volume note, bracketed years and suffixes; a bracketed place goes to the end."""
    x = F.regexp_replace(F.lower(raw), r"\[vol[a-z]*\]", " ")
    x = F.regexp_replace(x, r"\(.*$", " ")
    x = F.regexp_replace(x, r"\[([^\]]*)\]", " $1 ")
    x = F.regexp_replace(x, r"\s--.*$|\s\|.*$|;.*$", " ")
    x = F.regexp_replace(x, r"[\s,.]+(pub\.? co\.?|publishing co\.?|printing co\.?|print|newspaper|no\.? ?[0-9]+)\s*$", " ")
    x = F.regexp_replace(x, r"\b1[0-9?]{3}\s*-\s*(current|[0-9?]{4})\s*$", " ")
    abbr = "|".join(a.replace(" ", r"\.?\s?") for a in ["n c", "n d", "n h", "n j", "n m", "n y", "r i", "s c", "s d", "w va"]) + "|" + "|".join(
        a for a in STATE_ABBR if len(a) > 1 or a == "o"
    )
    x = F.regexp_replace(x, rf",\s*({abbr})\.?\s*(,|$)", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title_variants(raw: Column) -> Column:
    """Squeezed readings of a typed title: as it stands, and without a leading article."""
    t = spoken_title(raw)
    s = squeeze(t)
    first = F.regexp_extract(t, r"^([a-z]{1,4})[\s.]", 1)
    no_first = F.when((F.length(first) > 0) & ((F.levenshtein(first, F.lit("the")) <= 1) | first.isin("ye", "teh", "hte", "eth")), squeeze(F.regexp_replace(t, r"^[a-z]{1,4}[\s.]", "")))
    no_the = F.when(s.rlike("^the"), F.substr(s, F.lit(4)))
    place = F.regexp_extract(F.lower(raw), r"\(([^,()]+)", 1)
    with_place = F.when(F.length(place) > 0, F.concat(s, squeeze(place)))
    half = F.regexp_extract(F.lower(raw), r"^([^()]*?)[.]? \p{L}+( falls| springs| junction)?, *[a-z. ]+\)(\s.*)?$", 1)
    unopened = F.when(F.length(half) > 0, squeeze(half))
    return F.array_distinct(F.filter(F.array(s, no_first, no_the, with_place, unopened), lambda x: x.isNotNull() & (F.length(x) >= MIN_FORM)))


def canon_forms(canon: DataFrame) -> DataFrame:
    """Reference forms of (publication, title_id, place, state): as listed, and with the place behind or before
    a state name. One row per (form, title_id, publication)."""
    pub, place = F.lower(F.col("publication")), F.lower(F.coalesce("place", F.lit("")))
    name = F.when((F.length(place) > 0) & pub.startswith(place), F.trim(F.substr(pub, F.length(place) + 1)))
    st = F.lower(F.coalesce("state", F.lit("")))
    forms = F.array(squeeze(pub), squeeze(F.concat(name, place)), squeeze(F.concat(name, F.lit("of"), place)), squeeze(F.concat(place, st, name)), squeeze(F.concat(name, place, st)))
    return (
        canon.withColumn("form", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (F.length(x) >= MIN_FORM)))))
        .groupBy("form")
        .agg(F.max_by("title_id", "title_id").alias("title_id"), F.max_by("publication", "title_id").alias("publication"))
    )


def _k(length: Column) -> Column:
    """Largest edit distance by form length; forms of fewer than six letters must match exactly."""
    return F.when(length >= 16, MAX_K).when(length >= 12, 3).when(length >= 9, 2).when(length >= 6, 1).otherwise(0)


def pigeonhole_pairs(left: DataFrame, forms: DataFrame) -> DataFrame:
    """(raw, form, title_id, publication, dist): all pairs of a variant of ``left(raw, s)`` and a form within the
    form's edit bound. Complete: no pair within the bound is missed."""
    seg = forms.withColumn("L", F.length("form")).withColumn("k", _k(F.col("L")))
    seg = seg.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start = F.floor(F.col("i") * F.col("L") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("L") / (F.col("k") + 1)).cast("int")
    seg = seg.withColumn("piece", F.substr("form", start + 1, end - start))
    probe = left.withColumn("m", F.length("s")).withColumn("L", F.explode(F.sequence(F.greatest(F.lit(MIN_FORM), F.col("m") - MAX_K), F.greatest(F.lit(MIN_FORM), F.col("m") + MAX_K))))
    probe = probe.withColumn("k", _k(F.col("L"))).where(F.abs(F.col("L") - F.col("m")) <= F.col("k"))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    delta = F.col("m") - F.col("L")
    # of the edits left of segment i at most i count, of those right of it at most k - i
    lo = F.greatest(start - F.col("i"), start + delta - (F.col("k") - F.col("i")), F.lit(0))
    hi = F.least(start + F.col("i"), start + delta + (F.col("k") - F.col("i")), F.col("m") - (end - start))
    probe = probe.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi")))
    probe = probe.select("raw", "s", "L", "i", F.substr("s", F.col("at") + 1, end - start).alias("piece")).distinct()
    hit = probe.join(seg.select("L", "k", "i", "piece", "form", "title_id", "publication"), ["L", "i", "piece"])
    hit = hit.select("raw", "s", "form", "k", "title_id", "publication").distinct()
    return hit.withColumn("dist", F.levenshtein("s", "form", MAX_K)).where("dist >= 0 and dist <= k").select("raw", "form", "title_id", "publication", "dist")


def short_pairs(left: DataFrame, canon: DataFrame) -> DataFrame:
    """(raw, title_id, publication): titles cut off at the end or with abbreviated words ('thil. herald'). Candidates are all pairs in
    which some word of the title and some word of the name begin alike, so one slip leaves another word to find it by. They are
    verified by a pattern or, with two edits in all (two letters that changed places), word by word against the beginnings of the name's words; only
    titles with a single partner are kept."""
    t = F.regexp_replace(spoken_title(F.col("raw")), r"^(the|ye) ", "")
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), r"(?<=\p{L})['’](?=\p{L})", "_")  # "rep'r" leaves out letters
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}._ ]", " "), r"\s+", " "))
    words = F.filter(F.split("t", r"[ _]+|(?<=\.)"), lambda w: F.length(w) > 0)
    q = left.select("raw", t.alias("t")).distinct().withColumn("tw", words).where((F.length("t") >= 8) | (F.size("tw") > 1) & (F.length("t") >= 6))
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), r"\.$", ""), "_", r"[\\p{L}]*"), r"\.\s*", r"[\\p{L}-]*( \\p{L}+)? ?")
    q = q.withColumn("pat", F.concat(F.lit("^"), F.regexp_replace(pattern, " ", "[ -]+"), F.lit(r"[\p{L}-]*( and .*)?$")))
    c = canon.select("title_id", "publication", F.split("publication", "[ -]+").alias("cw"))
    begin = lambda ws: F.array_distinct(F.filter(F.transform(ws, lambda w: F.substring(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""), 1, 3)), lambda w: F.length(w) == 3))
    pairs = q.select("raw", F.explode(begin(F.col("tw"))).alias("pre")).join(c.select("title_id", "publication", F.explode(begin(F.col("cw"))).alias("pre")), "pre").select("raw", "title_id", "publication").distinct()
    hit = pairs.join(q, "raw").withColumn("cw", F.split("publication", "[ -]+"))
    bare = F.transform("tw", lambda w: F.regexp_replace(w, r"\.$", ""))
    slips = F.aggregate(F.zip_with(bare, "cw", lambda a, b: F.levenshtein(a, F.substr(b, F.lit(1), F.length(a)))), F.lit(0), lambda n, x: n + x)
    spelled = (F.size("tw") == F.size("cw")) & (F.size("tw") > 1) & F.coalesce(slips <= 2, F.lit(False)) & F.col("t").contains(".")
    # letters that are all as they should be go before slips; a short abbreviation with a slip could be anything
    long = F.forall("tw", lambda w: ~w.endswith(".") | (F.length(w) > SLIP_LETTERS))
    rank = F.when(F.expr("publication rlike pat") & (F.length("publication") > F.length("t") - 2), 0).when(spelled & long, 1)
    best = hit.withColumn("rank", rank).where("rank is not null").groupBy("raw", "rank").agg(F.count(F.lit(1)).alias("n"), F.first("title_id").alias("title_id"), F.first("publication").alias("publication"))
    best = best.groupBy("raw").agg(F.min_by(F.struct("n", "title_id", "publication"), "rank").alias("x"))
    return best.select("raw", "x.*").where("n = 1").drop("n")


def match_titles(values: DataFrame, canon: DataFrame) -> DataFrame:
    """values(raw, distinct, not null) x canon(title_id, publication, place, state) ->
    (raw, title_id, publication, dist); unmatched values have title_id -1 and null publication.

    The nearest form wins, then the smaller title_id; entries with title_id -1 in ``canon`` are known newspapers
    that are not on the list, so values nearest to them come out as -1 with their publication. Empty and
    blank values are unmatched; extra columns of either side are ignored."""
    canon = canon.select("title_id", "publication", "place", "state")
    left = values.select("raw").distinct().withColumn("s", F.explode_outer(title_variants(F.col("raw"))))
    near = pigeonhole_pairs(left.where(F.col("s").isNotNull()), canon_forms(canon))
    w = Window.partitionBy("raw").orderBy("dist", F.col("title_id") < 0, "title_id", "publication")
    best = cut(near.withColumn("r", F.row_number().over(w)).where("r = 1").select("raw", "title_id", "publication", "dist"))
    # an abbreviated or cut-off title is far from its own form and may lie nearer to another
    unsure = values.select("raw").distinct().join(best.where(F.col("dist") < SURE), "raw", "left_anti")
    short = short_pairs(unsure, canon).withColumn("dist", F.lit(None).cast("int"))
    short = cut(short)
    found = best.join(short, "raw", "left_anti").unionByName(short)
    missing = values.select("raw").distinct().join(found, "raw", "left_anti")
    return found.unionByName(missing.select("raw", F.lit(-1).alias("title_id"), F.lit(None).cast("string").alias("publication"), F.lit(None).cast("int").alias("dist")))


def known_newspapers(articles: DataFrame, title_list: DataFrame) -> DataFrame:
    """The canonical list extended by newspapers that the corpus shows but the list lacks: for each lccn the most
    frequent normalised title, unless it is listed. Columns title_id (-1 if not listed), publication, place,
    state, lccn (null if no article has it)."""
    a = articles.select(norm_lccn(F.col("lccn")).alias("lccn"), F.col("publication").alias("pub"), "publication_raw").where("lccn is not null and length(pub) > 0")
    place = F.lower(F.trim(F.regexp_extract("publication_raw", r"\(([^,()]+),", 1)))
    counts = a.withColumn("place", F.when(F.length(place) > 0, place)).groupBy("lccn", "pub").agg(F.count(F.lit(1)).alias("n"), F.mode("place").alias("place"))
    listed = title_list.select("title_id", F.lower("publication").alias("publication"), F.lower("place").alias("place"), F.lower("state").alias("state"))
    top = counts.groupBy("lccn").agg(F.max_by(F.struct("pub", "place"), F.struct("n", "pub")).alias("x")).select("lccn", F.col("x.pub").alias("publication"), F.col("x.place").alias("own_place"))
    top = top.where(r"publication rlike '^[\\p{L} -]+$'")  # abbreviated or misread names are no new entry
    both = listed.join(top, "publication", "full_outer")
    return both.select(F.coalesce("title_id", F.lit(-1)).alias("title_id"), "publication", F.coalesce("place", "own_place").alias("place"), "state", "lccn")

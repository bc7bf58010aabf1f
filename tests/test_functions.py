import math

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import stats
from broadsheet.functions import text as T
from broadsheet.functions import values as V


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Miss Trai-\nvorne taught\nbook keeping", "Miss Traivorne taught book keeping"),
        ("Dr.. Quaint said ,,no'' twice", 'Dr. Quaint said "no" twice'),
        ("“No,” she said", '"No," she said'),
        ("é-\nà  b", "éà b"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.text_normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Elmow beacon. [volume] (Elmow, Ia.) 1871-1944", "elmow beacon"), ("Elmow beacon.", "elmow beacon"), ("The Trielville argus. 18??-current", "the trielville argus"), (None, "")],
)
def test_title(spark, raw, want):
    assert one(spark, T.title_normalize(F.col("t")), t=raw) == want


def test_page(spark):
    assert one(spark, T.page_from_member(F.col("t")), t="faro_1963/1963-12-15_p23_x.json") == 23
    assert one(spark, T.page_from_member(F.col("t")), t="weird.json") is None


def test_keys_and_shingles(spark):
    assert one(spark, T.exact_key(F.col("t")), t="A  b") == one(spark, T.exact_key(F.col("t")), t="a b")
    assert one(spark, T.shingles(F.col("t"), 5), t="one two") == ["one two"]
    assert one(spark, T.shingles(F.col("t"), 2), t="a b a b") == ["a b", "b a"]
    assert one(spark, T.shingles(F.col("t"), 5), t=None) == []
    assert one(spark, T.junk_rate(F.col("t")), t="ab~~") == 0.5
    assert one(spark, T.junk_rate(F.col("t")), t="") is None


def test_quotes(spark):
    assert one(spark, T.quote_length(F.col("t")), t='"ab" x "cde"') == 5
    assert one(spark, T.quote_length(F.col("t")), t='x "cde') == 3
    assert one(spark, T.quote_length(F.col("t")), t='"ab" x "cde" y "z') == 5
    assert one(spark, T.quote_length(F.col("t")), t="none") == 0


def test_bow(spark):
    got = one(spark, T.bow_text(F.col("t"), F.lit(5), F.lit(15)), t="Mrs. Mary Jones, wife of").split()
    assert "tgtperson" in got and "l_mrs" in got and "r_wife" in got and "mary" not in got[:3]


def test_excerpts(spark):
    assert one(spark, T.mark_span(F.col("t"), F.lit(2), F.lit(4)), t="abcdef") == "ab⟦cd⟧ef"
    assert one(spark, T.trim_excerpt(F.col("t"), F.lit(3), F.lit(4), 1), t="abcdefg") == "…c⟦d⟧e…"
    got = one(spark, T.context_window(F.col("t"), F.lit(8), F.lit(9), 2), t="aaa bbb ccc ddd")
    assert got.ctx == "bbb ccc" and got.from_char == 4


def test_dictionary_rate(spark):
    lex = spark.createDataFrame([(w,) for w in ("walk", "the", "dog", "bake")], "word string")
    d = spark.createDataFrame([(1, "The dog walked; baking xqzt"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: (r.dict_rate, r.dict_ntok) for r in T.dictionary_rate(d, "id", "t", lex).collect()}
    assert got == {1: (0.8, 5), 2: (None, 0), 3: (None, 0)}


def test_mixed_title(spark):
    cases = [(["mrs"], False), (["capt", "mrs"], True), (["mrs", "jr"], False), (["senator"], False), (["dr", "mrs"], True), (["misses", "mrs"], False)]
    assert [one(spark, V.mixed_title(F.col("t")), t=t) for t, _ in cases] == [w for _, w in cases]
    null = spark.createDataFrame([(None,)], "t array<string>").select(V.mixed_title(F.col("t")).alias("x")).first().x
    assert null is False


def test_bands(spark):
    d = spark.createDataFrame([(1,), (3,), (9,), (20,), (None,)], "p int").select(V.page_band(F.col("p")).alias("b"))
    assert [r.b for r in d.collect()] == ["p1", "p2-4", "p5-12", "p13+", "na"]


def test_flags(spark):
    d = spark.createDataFrame([(["PUBLIC_OFFICE"],), (["CIVIC", "FAMILY"],), ([],), (["BUSINESS", "PROFESSIONAL"],), (None,)], "r array<string>").select(*V.role_flags(F.col("r"), "A"), V.multi_hot(F.col("r")).alias("m"))
    rows = d.collect()
    assert [r.A_PUBLIC_OFFICE for r in rows] == [True, False, False, False, False]
    assert [r.A_AUTHORITY for r in rows] == [True, False, False, True, False]
    assert [sum(r.m) for r in rows] == [1, 2, 0, 2, 0]


def test_reply(spark):
    r = one(spark, V.parse_reply(F.col("t")), t='Sure! {"is_person": true, "gender_text": "f", "roles": ["CIVIC","BOGUS"], "quoted": false, "confidence": 0.8} ok')
    assert (r.gender_text, r.roles, r.quoted, r.confidence) == ("F", ["CIVIC"], False, 0.8)
    assert one(spark, V.parse_reply(F.col("t")), t="no json here") is None
    assert one(spark, V.parse_reply(F.col("t")), t='{"gender_text": "nonbinary"}').gender_text == "UNKNOWN"


def test_unknown_bounds(spark):
    r = spark.range(1).select(*V.unknown_bounds(F.lit(10), F.lit(30), F.lit(60))).first()
    assert (r.share_f_classified, r.lower, r.upper) == (0.25, 0.1, 0.7)


def test_distributions():
    assert abs(stats.t_quantile(0.975, 20) - 2.0859634) < 1e-6
    assert abs(stats.t_quantile(0.975, 1) - 12.7062047) < 1e-5
    assert abs(stats.t_two_sided(2.0859634, 20) - 0.05) < 1e-7
    assert abs(stats.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert math.isclose(stats.incomplete_beta(2, 3, 0.5), 0.6875)


def test_poisson(spark):
    d = spark.range(20000).select(V.poisson1(V.uniform(F.col("id"), F.lit(1))).alias("k")).agg(F.avg("k").alias("m"), F.variance("k").alias("v")).first()
    assert abs(d.m - 1) < 0.03 and abs(d.v - 1) < 0.06

"""Rules on hand-written token tables: (text, lemma, pos, dependency, head, entity number or None)."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import rules

LEXICON = {"wife": "FAMILY", "senator": "PUBLIC_OFFICE", "president": "PUBLIC_OFFICE", "pitcher": "ARTS_SPORTS", "doctor": "PROFESSIONAL", "general": "MILITARY"}


def doc(key, *sentences):
    rows, i, idx = [], 0, 0
    for s, sent in enumerate(sentences):
        base = i
        for text, lemma, pos, dep, head, ent in sent:
            rows.append((key, i, s, text, lemma, pos, dep, base + head, "PERSON" if ent is not None else None, ent, idx))
            i += 1
            idx += len(text) + 1
    return rows


def people(spark, *docs):
    t = spark.createDataFrame([r for d in docs for r in d], rules.TOKENS)
    return {(r.article_id, r.name): r for r in rules.extract_entities(t, LEXICON).collect()}


def test_pronoun_gives_gender(spark):
    d = doc(
        "a",
        [("Jane", "Jane", "PROPN", "compound", 1, 0), ("Doe", "Doe", "PROPN", "nsubj", 2, 0), ("arrived", "arrive", "VERB", "ROOT", 2, None), (".", ".", "PUNCT", "punct", 2, None)],
        [("She", "she", "PRON", "nsubjpass", 2, None), ("was", "be", "AUX", "auxpass", 2, None), ("greeted", "greet", "VERB", "ROOT", 2, None)],
    )
    r = people(spark, d)[("a", "Jane Doe")]
    assert (r.gender_h, r.gender_hp, r.src_hp, r.given, r.surname) == ("UNKNOWN", "F", "pronoun", "jane", "doe")


def test_couple_is_two_people(spark):
    d = doc(
        "b",
        [
            ("Mrs.", "Mrs.", "PROPN", "compound", 2, None), ("Robert", "Robert", "PROPN", "compound", 2, 0), ("Jones", "Jones", "PROPN", "nsubj", 7, 0), ("and", "and", "CCONJ", "cc", 2, None),
            ("Senator", "Senator", "PROPN", "compound", 6, None), ("Robert", "Robert", "PROPN", "compound", 6, 1), ("Jones", "Jones", "PROPN", "conj", 2, 1), ("came", "come", "VERB", "ROOT", 7, None),
        ],
    )
    t = spark.createDataFrame(d, rules.TOKENS)
    rows = {r.hclass: r for r in rules.extract_entities(t, LEXICON).collect()}
    assert set(rows) == {"F", "N"} and rows["N"].roles_b == ["PUBLIC_OFFICE"] and rows["F"].roles_b == [] and rows["F"].titles == ["mrs"]


def test_family_and_salience(spark):
    d = doc(
        "c",
        [
            ("Mrs.", "Mrs.", "PROPN", "compound", 2, None), ("Mary", "Mary", "PROPN", "compound", 2, 0), ("Jones", "Jones", "PROPN", "nsubj", 10, 0), (",", ",", "PUNCT", "punct", 2, None), ("wife", "wife", "NOUN", "appos", 2, None),
            ("of", "of", "ADP", "prep", 4, None), ("Senator", "Senator", "PROPN", "compound", 8, None), ("Robert", "Robert", "PROPN", "compound", 8, 1), ("Jones", "Jones", "PROPN", "pobj", 5, 1), (",", ",", "PUNCT", "punct", 2, None),
            ("spoke", "speak", "VERB", "ROOT", 10, None),
        ],
        [("She", "she", "PRON", "nsubj", 1, None), ("said", "say", "VERB", "ROOT", 1, None), ("no", "no", "DET", "dobj", 1, None)],
    )
    p = people(spark, d)
    mary, robert = p[("c", "Mary Jones")], p[("c", "Robert Jones")]
    assert mary.roles_b == ["FAMILY"] and "PUBLIC_OFFICE" in mary.roles_a and mary.n_quotes_pron == 1
    assert robert.gender_hp == "UNKNOWN" and robert.n_quotes_pron == 0


def test_organisation_head(spark):
    d = doc(
        "d",
        [
            ("Mrs.", "Mrs.", "PROPN", "compound", 2, None), ("Alice", "Alice", "PROPN", "compound", 2, 0), ("Hart", "Hart", "PROPN", "nsubjpass", 4, 0), ("was", "be", "AUX", "auxpass", 4, None), ("elected", "elect", "VERB", "ROOT", 4, None),
            ("president", "president", "NOUN", "oprd", 4, None), ("of", "of", "ADP", "prep", 5, None), ("the", "the", "DET", "det", 9, None), ("Woman's", "Woman's", "PROPN", "poss", 9, None), ("Club", "Club", "PROPN", "pobj", 6, None),
        ],
    )
    assert people(spark, d)[("d", "Alice Hart")].roles_b == ["CIVIC"]


def test_direct_quote_and_accident(spark):
    q = doc(
        "e",
        [
            ('"', '"', "PUNCT", "punct", 7, None), ("We", "we", "PRON", "nsubj", 3, None), ("will", "will", "AUX", "aux", 3, None), ("win", "win", "VERB", "ccomp", 7, None), ('"', '"', "PUNCT", "punct", 7, None),
            ("Mrs.", "Mrs.", "PROPN", "compound", 6, None), ("Hart", "Hart", "PROPN", "nsubj", 7, 0), ("said", "say", "VERB", "ROOT", 7, None),
        ],
    )
    r = people(spark, q)[("e", "Hart")]
    assert r.n_quotes_name == 1 and r.n_direct_name == 1 and r.quote_chars_name > 10 and r.agent_verbs == ["say"]
    a = doc(
        "f",
        [
            ("Walter", "Walter", "PROPN", "compound", 1, 0), ("Johnson", "Johnson", "PROPN", "nsubjpass", 7, 0), (",", ",", "PUNCT", "punct", 1, None), ("the", "the", "DET", "det", 4, None), ("pitcher", "pitcher", "NOUN", "appos", 1, None),
            (",", ",", "PUNCT", "punct", 1, None), ("was", "be", "AUX", "auxpass", 7, None), ("injured", "injure", "VERB", "ROOT", 7, None),
        ],
    )
    assert people(spark, a)[("f", "Walter Johnson")].roles_b == ["ARTS_SPORTS", "CRIME_ACCIDENT"]


def test_pattern_mention_and_military_title(spark):
    d = doc("g", [("Miss", "Miss", "PROPN", "compound", 1, None), ("Smith", "Smith", "PROPN", "nsubj", 2, None), ("left", "leave", "VERB", "ROOT", 2, None)])
    r = people(spark, d)[("g", "Smith")]
    assert r.n_ner_mentions == 0 and r.gender_h == "F"
    m = doc("h", [("Gen.", "Gen.", "PROPN", "compound", 2, None), ("John", "John", "PROPN", "compound", 2, 0), ("Pershing", "Pershing", "PROPN", "nsubj", 3, 0), ("said", "say", "VERB", "ROOT", 3, None)])
    assert people(spark, m)[("h", "John Pershing")].roles_b == ["MILITARY"]


def test_ambiguous_surname_is_dropped(spark):
    n = lambda a, b, e: [(a, a, "PROPN", "compound", 1, e), (b, b, "PROPN", "nsubj", 2, e), ("left", "leave", "VERB", "ROOT", 2, None)]
    d = doc("i", n("Ann", "Lee", 0), n("Bob", "Lee", 1), [("Lee", "Lee", "PROPN", "nsubj", 1, 2), ("left", "leave", "VERB", "ROOT", 1, None)])
    p = people(spark, d)
    assert len(p) == 2 and all(r.n_ambiguous_dropped == 1 for r in p.values())


@pytest.mark.parametrize(
    ("h", "pron", "noun", "want"),
    [
        ("F", ["M", "M"], [], ("F", "F", "honorific")), ("N", ["F", "F", "M"], [], ("UNKNOWN", "F", "pronoun")), ("N", ["F", "M"], [], ("UNKNOWN", "UNKNOWN", "conflict")), ("N", [None, None], [], ("UNKNOWN", "UNKNOWN", "none")),
        ("N", ["M"], ["F"], ("UNKNOWN", "M", "pronoun")),
    ],
)
def test_resolve(spark, h, pron, noun, want):
    d = spark.createDataFrame([(h, pron, noun)], "h string, p array<string>, n array<string>")
    r = rules.resolve_gender(d, "h", "p", "n").first()
    assert (r.gender_h, r.gender_hp, r.src_hp) == want
    if noun == ["F"]:
        assert r.gender_hpn == "F"


def test_pattern_text(spark):
    d = spark.createDataFrame([("Mr. Traivorne met Mrs. M. Fumbet and Miss Ada of Elm.",)], "t string")
    assert d.select(rules.pattern_mentions(F.col("t")).alias("m")).first().m == ["Mr. Traivorne", "Mrs. M. Fumbet", "Miss Ada"]


def test_no_tokens(spark):
    assert rules.extract_entities(spark.createDataFrame([], rules.TOKENS), LEXICON).count() == 0


def test_plug_in_parser(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", None)], "article_id string, text string")
    parse = lambda: lambda t: [(i, 0, w, w, "NOUN", "ROOT", i, None, None, 0) for i, w in enumerate(t.split())]
    assert rules.parse_texts(d, parse).count() == 2


def test_articles_go_on_over_batches(spark):
    """Articles cut by Arrow batches are whole, and no row is handed to Python by itself."""
    from broadsheet.plans import rule_queries as q

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        t = q.token_table(spark, "/root/testdata/sf0.001")
        df = rules.extract_entities(t, q.LEXICON)
        small = sorted(df.drop("rel_pos").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(df.drop("rel_pos").collect())
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    assert df.select("roles_a").count() == len(small)


def test_only_wanted_parts_are_worked_out(spark, data, monkeypatch):
    """Columns asked for are those of the whole rows; the other parts, such as speech, are not called."""
    from broadsheet.plans import rule_queries as q

    t = q.token_table(spark, data)
    for wanted in (["entity_id", *q.LANGUAGE], ["n_quotes_pron", "entity_id"], ["roles_a"]):
        df = rules.extract_entities(t, q.LEXICON, wanted)
        assert df.columns == wanted and sorted(df.collect()) == sorted(rules.extract_entities(t, q.LEXICON).select(wanted).collect())
    rows = sorted(t.where("article_id = 'c2'").collect(), key=lambda r: r.i)
    a = rules.Article({c: [r[c] for r in rows] for c in t.columns}, q.LEXICON)
    for f in ("genders", "speech", "roles_near", "roles_stated"):
        monkeypatch.delattr(rules.Article, f)
    assert rules.article_entities("c2", a, rules.parts_of(["entity_id", "agent_verbs"])) == [("c2#0", ["speak"]), ("c2#1", [])]


def test_tokens_are_joined_not_rebuilt_for_each_token(spark, data):
    """A key is evaluated once and not in a lambda over its tokens, and a small file of keys is spread; texts stand at idx."""
    from broadsheet.plans import rule_queries as q

    t = q.token_table(spark, data)
    assert "lambdafunction" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert t.rdd.getNumPartitions() >= 12
    plan = q.entity_language(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan  # keys are moved, tokens are not
    for article in ("c0", "c4", "c13"):
        rows = sorted(t.where(F.col("article_id") == article).collect(), key=lambda r: r.i)
        whole = " ".join(r.text for r in rows)
        assert rows and all(whole[r.idx : r.idx + len(r.text)] == r.text for r in rows)

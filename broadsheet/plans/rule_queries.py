"""Queries of the rules over parsed text. Every customer becomes an article of one of eleven hand-parsed forms with a name of
its own; the SQL states what the rules must find in each form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import rules
from broadsheet.runtime import table

QUERIES: dict = {}
SQL: dict = {}

LEXICON = {"wife": "FAMILY", "senator": "PUBLIC_OFFICE", "president": "PUBLIC_OFFICE", "pitcher": "ARTS_SPORTS", "doctor": "PROFESSIONAL", "general": "MILITARY"}
GIVEN = ["Ann", "Clara", "Dora", "Ella", "Fred"]
VERBS = {"said": "say", "declared": "declare", "insisted": "insist", "wrote": "write"}

#: Tokens of the forms by sentence: text, part of speech, dependency, head within the sentence, number of the named person.
#: {g}, {s} are the given name and surname, {v} a verb of speech; a lemma other than the lower-case text follows a slash.
FORMS = [
    [["{g} PROPN compound 1 0", "{s} PROPN nsubj 2 0", "arrived/arrive VERB ROOT 2", ". PUNCT punct 2"], ["She PRON nsubjpass 2", "was/be AUX auxpass 2", "greeted/greet VERB ROOT 2"]],
    [["Mrs. PROPN compound 2", "{g} PROPN compound 2 0", "{s} PROPN nsubj 7 0", "and CCONJ cc 2", "Senator PROPN compound 6", "{g} PROPN compound 6 1", "{s} PROPN conj 2 1", "came/come VERB ROOT 7"]],
    [
        ["Mrs. PROPN compound 2", "{g} PROPN compound 2 0", "{s} PROPN nsubj 10 0", ", PUNCT punct 2", "wife NOUN appos 2", "of ADP prep 4", "Senator PROPN compound 8", "Robert PROPN compound 8 1", "{s} PROPN pobj 5 1", ", PUNCT punct 2", "spoke/speak VERB ROOT 10"],
        ["She PRON nsubj 1", "{v} VERB ROOT 1", "no DET dobj 1"],
    ],
    [["Mrs. PROPN compound 2", "{g} PROPN compound 2 0", "{s} PROPN nsubjpass 4 0", "was/be AUX auxpass 4", "elected/elect VERB ROOT 4", "president NOUN oprd 4", "of ADP prep 5", "the DET det 9", "Woman's PROPN poss 9", "Club PROPN pobj 6"]],
    [['" PUNCT punct 7', "We PRON nsubj 3", "will AUX aux 3", "win VERB ccomp 7", '" PUNCT punct 7', "Mrs. PROPN compound 6", "{s} PROPN nsubj 7 0", "{v} VERB ROOT 7"]],
    [["{g} PROPN compound 1 0", "{s} PROPN nsubjpass 7 0", ", PUNCT punct 1", "the DET det 4", "pitcher NOUN appos 1", ", PUNCT punct 1", "was/be AUX auxpass 7", "injured/injure VERB ROOT 7"]],
    [["Miss PROPN compound 1", "{s} PROPN nsubj 2", "left/leave VERB ROOT 2"]],
    [["{g} PROPN compound 1 0", "{s} PROPN nsubj 2 0", "left/leave VERB ROOT 2"], ["Robert PROPN compound 1 1", "{s} PROPN nsubj 2 1", "left/leave VERB ROOT 2"], ["{s} PROPN nsubj 1 2", "left/leave VERB ROOT 1"]],
    [["{g} PROPN compound 1 0", "{s} PROPN nsubj 2 0", "spoke/speak VERB ROOT 2"], ["Mrs. PROPN compound 1", "{s} PROPN nsubj 2 1", "left/leave VERB ROOT 2"]],
    [["old ADJ amod 2", "{g} PROPN compound 2 0", "{s} PROPN nsubj 3 0", "praised/praise VERB ROOT 3", "Robert PROPN compound 5 1", "Hill PROPN dobj 3 1"], ["Clara PROPN compound 1 2", "Moss PROPN poss 2 2", "car NOUN ROOT 2"]],
    [["Sister PROPN compound 2", "{g} PROPN compound 2 0", "{s} PROPN nsubj 7 0", ", PUNCT punct 2", "a DET det 5", "nun NOUN appos 2", ", PUNCT punct 2", "came/come VERB ROOT 7"]],
]


#: A token of a form: ``shown`` is g, s or v where a name or the verb stands; ``at`` is its place without those before it, which are counted.
TEMPLATE = "form int, i int, sent int, shown string, text string, lemma string, pos string, dep string, head int, ent_label string, ent_id int, at int, n_g int, n_s int, n_v int"
#: Tasks the keys are spread over at least: a file of keys is small, its tokens are not.
SPREAD = 24


def _template() -> list[tuple]:
    """The tokens of all forms (schema ``TEMPLATE``)."""
    rows = []
    for f, form in enumerate(FORMS):
        i, at, seen = 0, 0, {"g": 0, "s": 0, "v": 0}
        for sent, tokens in enumerate(form):
            for t in tokens:
                word, pos, dep, head, *ent = t.split(" ")
                text, _, base = word.partition("/")
                shown = text[1] if text in ("{g}", "{s}", "{v}") else None
                rows.append((f, i, sent, shown, text, base or text.lower(), pos, dep, i - tokens.index(t) + int(head), "PERSON" if ent else None, int(ent[0]) if ent else None, at, *seen.values()))
                i += 1
                at += 1 if shown else len(text) + 1
                if shown:
                    seen[shown] += 1
    return rows


def token_table(spark: SparkSession, d: str) -> DataFrame:
    """One token table over all customers. The forms are a table of their own (89 rows, broadcast), so a key is evaluated once and not once a token."""
    key = F.col("c_custkey")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (key % len(names)).cast("int"))
    surname = F.concat(F.lit("S"), F.translate(key.cast("string"), "0123456789", "aeioumnrst"), F.lit("ton"))
    keys = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), key).alias("article_id"))
    keys = keys.repartition(max(SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions"))), "article_id")  # the tokens then lie by article
    a = keys.select("article_id", (key % len(FORMS)).cast("int").alias("form"), pick(GIVEN).alias("g"), surname.alias("s"), pick(VERBS).alias("v"), pick(VERBS.values()).alias("v_lemma"))
    t = a.join(F.broadcast(spark.createDataFrame(_template(), TEMPLATE)), "form")
    word = F.when(F.col("shown") == "g", F.col("g")).when(F.col("shown") == "s", F.col("s")).when(F.col("shown") == "v", F.col("v")).otherwise(F.col("text"))
    base = F.when(F.col("shown") == "g", F.lower("g")).when(F.col("shown") == "s", F.lower("s")).when(F.col("shown") == "v", F.col("v_lemma")).otherwise(F.col("lemma"))
    idx = F.col("at") + F.col("n_g") * F.length("g") + F.col("n_s") * F.length("s") + F.col("n_v") * F.length("v")
    return t.select("article_id", "i", "sent", word.alias("text"), base.alias("lemma"), "pos", "dep", "head", "ent_label", "ent_id", idx.alias("idx"))


def _people(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return rules.extract_entities(token_table(spark, d), LEXICON, columns)


# What must come out: per form its people in the order of their entities. Values are SQL; g, s are the names, v the lemma of the verb.
_BASE = {
    "name": "g || ' ' || s", "surname": "lower(s)", "given": "lower(g)", "hclass": "'N'", "n_mentions": "1", "n_ner_mentions": "1", "gender_h": "'UNKNOWN'", "gender_hp": "'UNKNOWN'", "gender_hpn": "'UNKNOWN'", "src_hp": "'none'", "pron_signal": "'UNKNOWN'",
    "gnoun_signal": "'UNKNOWN'", "n_pron_f": "0", "n_pron_m": "0", "titles": "''", "first_tok": "0", "n_ambiguous_dropped": "0", "roles_a": "''", "roles_b": "''", "n_quotes_name": "0", "n_quotes_pron": "0", "n_direct_name": "0", "quote_chars_name": "0",
    "agent_verbs": "''", "patient_verbs": "''", "poss_nouns": "''", "adjs": "''",
}
_F = {"hclass": "'F'", "gender_h": "'F'", "gender_hp": "'F'", "gender_hpn": "'F'", "src_hp": "'honorific'"}
_EXPECTED = [
    [{"gender_hp": "'F'", "gender_hpn": "'F'", "src_hp": "'pronoun'", "pron_signal": "'F'", "n_pron_f": "1", "agent_verbs": "'arrive'"}],
    [
        _F | {"titles": "'mrs'", "first_tok": "1", "roles_a": "'PUBLIC_OFFICE'", "agent_verbs": "'come'"},
        {"titles": "'senator'", "first_tok": "5", "roles_a": "'PUBLIC_OFFICE'", "roles_b": "'PUBLIC_OFFICE'"},
    ],
    [
        _F | {"titles": "'mrs'", "first_tok": "1", "roles_a": "'FAMILY,PUBLIC_OFFICE'", "roles_b": "'FAMILY'", "gnoun_signal": "'F'", "agent_verbs": "'speak'", "n_quotes_pron": "1"},
        {"name": "'Robert ' || s", "given": "'robert'", "titles": "'senator'", "first_tok": "7", "roles_a": "'FAMILY,PUBLIC_OFFICE'", "roles_b": "'PUBLIC_OFFICE'"},
    ],
    [_F | {"titles": "'mrs'", "first_tok": "1", "roles_a": "'PUBLIC_OFFICE'", "roles_b": "'CIVIC'", "patient_verbs": "'elect'"}],
    [_F | {"name": "s", "given": "''", "titles": "'mrs'", "first_tok": "6", "n_quotes_name": "1", "n_direct_name": "1", "quote_chars_name": "13", "agent_verbs": "v"}],
    [{"roles_a": "'ARTS_SPORTS'", "roles_b": "'ARTS_SPORTS,CRIME_ACCIDENT'", "patient_verbs": "'injure'"}],
    [_F | {"name": "s", "given": "''", "titles": "'miss'", "first_tok": "1", "n_ner_mentions": "0", "agent_verbs": "'leave'"}],
    [{"n_ambiguous_dropped": "1", "agent_verbs": "'leave'"}, {"name": "'Robert ' || s", "given": "'robert'", "first_tok": "3", "n_ambiguous_dropped": "1", "agent_verbs": "'leave'"}],
    [_F | {"n_mentions": "2", "n_ner_mentions": "2", "titles": "'mrs'", "agent_verbs": "'speak,leave'"}],
    [
        {"first_tok": "1", "agent_verbs": "'praise'", "adjs": "'old'"},
        {"name": "'Robert Hill'", "surname": "'hill'", "given": "'robert'", "first_tok": "4", "patient_verbs": "'praise'"},
        {"name": "'Clara Moss'", "surname": "'moss'", "given": "'clara'", "first_tok": "6", "poss_nouns": "'car'"},
    ],
    [{"gender_hpn": "'F'", "gnoun_signal": "'F'", "titles": "'sister'", "first_tok": "1", "agent_verbs": "'come'"}],
]
_SIZES = [sum(len(s) for s in form) for form in FORMS]
_NUMBERS = {"n_mentions", "n_ner_mentions", "n_pron_f", "n_pron_m", "first_tok", "n_ambiguous_dropped", "n_quotes_name", "n_quotes_pron", "n_direct_name", "quote_chars_name"}
_PERSONS = (
    f"WITH c AS (SELECT c_custkey, 'c' || c_custkey AS article_id, c_custkey % {len(FORMS)} AS form, {GIVEN!r}[c_custkey % {len(GIVEN)} + 1] AS g, 'S' || translate(c_custkey::VARCHAR, '0123456789', 'aeioumnrst') || 'ton' AS s, "
    f"{list(VERBS.values())!r}[c_custkey % {len(VERBS)} + 1] AS v FROM customer), p AS ("
    + " UNION ALL ".join(
        f"SELECT article_id, form, article_id || '#{k}' AS entity_id, " + ", ".join(f"({x})::INTEGER AS {c}" if c in _NUMBERS else f"{x} AS {c}" for c, x in (_BASE | person).items()) + f", round(({(_BASE | person)['first_tok']})::DOUBLE / {_SIZES[f]}, 4) AS rel_pos FROM c WHERE form = {f}"
        for f, people in enumerate(_EXPECTED)
        for k, person in enumerate(people)
    )
    + ") "
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flat(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    df = _people(spark, d, ["entity_id", *columns])
    kinds = dict(df.dtypes)
    return df.select("entity_id", *[F.array_join(c, ",").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


MENTIONS = ["name", "surname", "given", "hclass", "n_mentions", "n_ner_mentions", "titles"]
SIGNALS = ["gender_h", "gender_hp", "gender_hpn", "src_hp", "pron_signal", "gnoun_signal", "n_pron_f", "n_pron_m"]
SPEECH = ["n_quotes_name", "n_quotes_pron", "n_direct_name", "quote_chars_name"]
LANGUAGE = ["agent_verbs", "patient_verbs", "poss_nouns", "adjs"]


@query(_PERSONS + f"SELECT entity_id, {', '.join(MENTIONS)} FROM p")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions made and found: names, titles and classes."""
    return _flat(spark, d, MENTIONS)


@query(_PERSONS + "SELECT article_id, count(*) AS n_entities, sum(n_mentions)::BIGINT AS n_kept, max(n_ambiguous_dropped) AS n_dropped FROM p GROUP BY 1")
def entity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each article, their mentions and what was dropped as ambiguous."""
    return _people(spark, d, ["article_id", "n_mentions", "n_ambiguous_dropped"]).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_mentions").alias("n_kept"), F.max("n_ambiguous_dropped").alias("n_dropped"))


@query(_PERSONS + f"SELECT entity_id, {', '.join(SIGNALS)} FROM p")
def entity_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of salience, pronouns and nouns, and the tiers resolved from them."""
    return _flat(spark, d, SIGNALS)


@query(_PERSONS + "SELECT entity_id, roles_a FROM p")
def entity_roles_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, ["roles_a"])


@query(_PERSONS + "SELECT entity_id, roles_b FROM p")
def entity_roles_stated(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, ["roles_b"])


@query(_PERSONS + f"SELECT entity_id, {', '.join(SPEECH)} FROM p")
def entity_speech(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, SPEECH)


@query(_PERSONS + f"SELECT entity_id, {', '.join(LANGUAGE)} FROM p")
def entity_language(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, LANGUAGE)


_SENTS = "[" + ", ".join(str(len(f)) for f in FORMS) + "]"
_NER = [len({t.split(" ")[4] for s in f for t in s if len(t.split(" ")) > 4}) for f in FORMS]


@query(
    _PERSONS + f"SELECT article_id, {_SIZES!r}[form + 1]::INTEGER AS n_tokens, {_SENTS}[form + 1]::INTEGER AS n_sents, {_NER!r}[form + 1]::INTEGER AS n_ner_person, (sum(n_mentions) + max(n_ambiguous_dropped))::INTEGER AS n_mentions, "
    "sum(n_mentions - n_ner_mentions)::INTEGER AS n_pattern_mentions, count(*)::INTEGER AS n_entities, max(n_ambiguous_dropped)::INTEGER AS n_ambiguous_dropped, sum(n_quotes_name + n_quotes_pron)::INTEGER AS n_speech_events FROM p GROUP BY article_id, form"
)
def article_parse(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every article."""
    return rules.count_articles(token_table(spark, d), LEXICON)


@query(_PERSONS + "SELECT article_id, entity_id, first_tok, rel_pos FROM p")
def article_entities(spark: SparkSession, d: str) -> DataFrame:
    """Assembly of articles: numbering of the entities and where they first stand."""
    return _people(spark, d, ["article_id", "entity_id", "first_tok", "rel_pos"])


def _blank_parser():
    """A stand-in for a parser: words at blanks, no tree."""

    def parse(text: str) -> list[tuple]:
        out, at = [], 0
        for i, w in enumerate(text.split()):
            out.append((i, 0, w, w.lower(), "PROPN", "dep", i, None, None, at))
            at += len(w) + 1
        return out

    return parse


@query("SELECT 'c' || c_custkey || '#0' AS entity_id, initcap_name AS name, 'F' AS hclass, 0 AS n_ner_mentions FROM (SELECT c_custkey, 'S' || translate(c_custkey::VARCHAR, '0123456789', 'aeioumnrst') || 'ton' AS initcap_name FROM customer)")
def parsed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Parsing by a plug-in and the rules in one pass over the texts."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Then Miss S"), F.translate(key, "0123456789", "aeioumnrst"), F.lit("ton spoke"))
    docs = table(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("article_id"), text.alias("text"))
    return rules.extract_articles(docs, _blank_parser, LEXICON).select("entity_id", "name", "hclass", "n_ner_mentions")

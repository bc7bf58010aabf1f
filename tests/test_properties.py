"""Text functions on generated texts: what must hold of every result, whatever the text."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import text as T

PIECES = st.sampled_from(list("ab Zé-–.,'\"“”’„\n\t !~|[]()19?") + ["Mr..", "Mrs...", "''", ",,", "-\n", " \n ", "1854-19??", "[volume]", "word", "Straße"])
TEXTS = st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=30, max_size=60)


def letters(t):
    return [c for c in t if c.isalnum()]


def inside_quotes(t):
    """Characters between marks, read one by one: a mark opens, the next closes; one mark alone is open to the end."""
    total = run = marks = 0
    for c in t:
        if c == '"':
            total, run, marks = total + (run if marks % 2 else 0), 0, marks + 1
        elif marks % 2:
            run += 1
    return run if marks == 1 else total


def words_begun(t):
    """Places where a word begins after a blank or the start."""
    return sum(not c.isspace() and (i == 0 or t[i - 1].isspace()) for i, c in enumerate(t))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_text_functions(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    n = T.text_normalize(t)
    rows = d.select(
        "i", n.alias("n"), T.text_normalize(n).alias("nn"), T.title_normalize(t).alias("h"), T.word_count(t).alias("w"), T.word_count(n).alias("wn"), T.exact_key(t).alias("k"),
        T.exact_key(F.upper(F.translate(t, "é–", "é "))).alias("ku"), T.exact_key(F.concat(t, F.lit(" q"))).alias("kq"), T.junk_rate(t).alias("j"), T.quote_length(t).alias("q"), T.tokens(t).alias("tok"), T.shingles(t, 3).alias("s"),
    ).collect()
    for r in rows:
        x = texts[r.i]
        # normalised: no line ends, curly or doubled quotes, no double or outer blanks; no letter lost, and nothing left to do
        assert not any(bad in r.n for bad in ("\n", "“", "”", "„", "’", "''", ",,", "  ", "\t\t")) and r.n == r.n.strip() and r.nn == r.n and letters(r.n) == letters(x) and r.wn <= r.w
        # titles: lower case, no bracketed part, no mark at an end
        assert r.h == r.h.lower() and r.h.strip(" .,;:-") == r.h and "  " not in r.h and not any(o in r.h and c in r.h[r.h.index(o) :] for o, c in ("[]", "()"))
        assert r.w == words_begun(x) and r.q == inside_quotes(x)
        # the key sees tokens only, not case or marks, and every token
        assert r.kq != r.k and (r.ku == r.k or "ß" in x)
        # shingles are distinct runs of tokens that cover the text from end to end
        run = f" {' '.join(r.tok)} "
        assert len(set(r.s)) == len(r.s) <= max(1, len(r.tok) - 2) and all(f" {s} " in run for s in r.s) and all(len(s.split()) == min(3, len(r.tok)) for s in r.s)
        assert bool(r.s) == bool(r.tok) and (not r.tok or any(run.startswith(f" {s} ") for s in r.s) and any(run.endswith(f" {s} ") for s in r.s))
        # junk is the part that neither letters, blanks nor usual marks take up
        assert (r.j is None and not x) or abs(r.j * len(x) - sum(c in "~|[]–" for c in x) - sum(c in "“”’„" for c in x)) < 1e-9

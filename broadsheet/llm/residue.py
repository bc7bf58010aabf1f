"""Template residue, filler text and error pages.

One narrow pass cuts every whole text into messages (sentences and lines), masks quotations, proper names, addresses, dates,
numbers and spelled numbers, and keeps the hash of every masked message per document. The hashes are grouped across
documents and sources; then the groups are classified. Rules decide first: a placeholder, a strong phrase or pseudo-Latin
marks the group wherever it stands, a weak phrase only if the group recurs in several sources. A recurring group without
any of them is residue if nearly all documents that show it hold a group the rules found (the menu line or the ticket
number of an error page). Documents with a group of residue come out. Quoted phrases are masked first, so a report about an
error page is no case. Patterns run in Arrow's RE2, whose time does not grow with the number of alternatives, and once per
distinct message of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import cut, lookup_join, null_safe_join

#: Patterns of unfilled placeholders.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\{%[^{}\n]{0,60}%\}",
    r"<%[^<>\n]{0,60}%>",
    r"\$\{[^{}\n]{1,60}\}",
    r"%\([A-Za-z_ ]{1,40}\)[sd]",
    r"%%?[A-Z_]{3,40}%%?",
    r"<<[A-Za-z_ ]{2,40}>>",
    r"##[A-Za-z_ ]{2,40}##",
    r"@@[A-Za-z_ ]{2,40}@@",
    r"__[A-Z]{2,}[A-Z_]*__",
    r"\[\[[A-Za-z_ .]{2,40}\]\]",
    r"(?i:\[(insert|your|enter|add|put|name|title|date|placeholder|tbd|tk|byline|headline)\b[^\]\n]{0,40}\])",
    r"(?i:<(insert|your|enter)\b[^>\n]{0,40}>)",
    r"\{[a-z]+[_.][a-z_.]+\}",
    r"\{ ?[A-Za-z]{2}[A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+)* ?\}",
    r"\{ ?\d{1,3}(?:[:!][^{}\n]{0,20})? ?\}",
    r"(?i:[(\[<{] ?(your|insert|enter|add|put|type|write)\b[^()\[\]<>{}\n]{1,40}\bhere ?[)\]>}])",
    r"(?i:\byour( [a-z]+){1,3} goes here\b)",
    r"\b(X{4,}|x{4,})\b",
    r"\[[A-Z_]{3,30}\]",
    r"\[[A-Z]{4,20}( [A-Z]{2,20}){1,2}\]",
    r"[A-Za-z_]{3,30} ?%>|<% ?[A-Za-z_]{3,30}",
    r"\$[A-Z][A-Z_]{2,30}\b",
    r"\[[A-Za-z_ ]{2,30} (TK|tk|tbd|TBD)\]",
    r"\[object Object\]",
    r"(?i:\b(undefined|null|nan) (undefined|null|nan)\b)",
]
#: Phrases that mark a message by themselves (masked, lower case: # is a number, Q a quotation).
STRONG = [
    r"lorem ipsum",
    r"(enable|activate|turn on|switch on|allow|requires?|need|needs|without) (java)?scripts?\b|(java)?scripts? (and|or) cookies|(java)?scripts? (is|are) (disabled|turned off|switched off|off|blocked|required)|does not work without (java)?script|(scripts?|javascript|scripting) switched off|(not run|blocks) (java)?scripts?|(turn on|allow|enable|needs?|requires?) scripting",
    r"javascript (ist|sind)? ?(ausgeschaltet|deaktiviert|abgeschaltet)|aktivieren (sie|n) (java)?s[ck]ripte?|skripte? (ist|sind|zulassen|aktivieren|einschalten)|(active|habilite|activez|activer|autorisez) (el |los |les |le )?(java)?scripts?|(java)?scripts? (est|sont) (désactivés?|bloqués?)|(java)?scripts? (está|están) (desactivados?|bloqueados?)",
    r"(http|fatal|database|server|script|syntax|parse|internal) error|error (code )?# *[-:.]|^(error|fehler|erreur) #|^warning cannot|^warning: |null reference|cannot read property|undefined (index|variable|property|reference)|stack trace|unhandled exception|traceback|query timed out|connection (timed out|refused|reset)|could not connect to|fault was logged|segmentation fault|out of memory",
    r"(internal server error|service unavailable|bad gateway|gateway time-?out|request time-?out|# bad request|# unauthorized)",
    r"page (was )?not found|page you (asked|requested|want)|(title|page|item|scan|issue) (is|was)n.t (here|found)|(page|scan|title|issue|reel|item|volume|file) you (asked|requested|want|are looking)|(status|http|code) # (page )?not found|^(die |der )?(n|seite|ausgabe|datei|titel) (wurde |konnte )?nicht gefunden( werden)?\.?$|seite nicht gefunden|(existiert nicht|no existe|n.existe pas)\.?$|^zurück zur (n|startseite)\.?$|später noch einmal versuchen|regrese al inicio|vuelva a intentarlo|retournez à l.accueil|réessayez|p[áa]gina no encontrada|page (introuvable|non trouvée)|no se encontr[óo] la p[áa]gina",
    r"access (is |was )?denied|do not have permission|not authori[sz]ed|(zugriff|^n|: n) verweigert|acceso denegado|accès refusé|# forbidden|log ?in to (continue|view|read)|sign in to (continue|view|read)|please (log|sign) in|reading pass",
    r"too many requests|unusual traffic|checking your browser|check your connection|signed out|session (has )?expired|are you (a )?(human|robot)|verify (that )?you are|rate limit|slow down and",
    r"something went wrong|went wrong|try again later|please try again|unexpected condition|contact the administrator|could not (load|open|find) (this|the) (page|scan|title)|no se pudo (cargar|abrir)|konnte nicht (geladen|angezeigt)|n.a pas pu (être|charger)|impossible de (charger|afficher)|down for upkeep|(viewer|server) did not answer|(image|scan|page) could not be displayed|no text layer|text not available|failed to start|report a broken link",
    r"under construction|(content|story|text|article|page) (is )?(coming soon|to come)|intentionally left blank|check back (soon|later)",
    r"^(this|here) is (dummy|filler|sample|placeholder) (copy|type|text)|^placeholder (page|text|copy|for)|^dummy (copy|type|text)|^filler (copy|type|text)|^(text|copy|caption|photo|story) to (come|follow)|delete before printing|(headline|body text|text|story|caption) goes here|replace this (with|text)|repeat to fit|do not print|\basdf\b|test test test|blah blah|text text text|words words words|\bqwerty\b|\bfoo bar\b|lead paragraph in about|this is (a )?test\b|test headline|hier steht|platzhalter|blindtext|texto de relleno|texte factice|faux texte",
    r"cookies? (are|is|must|need)|accept (all )?cookies|your browser (does not|is not|must)|(newer|unsupported) browser",
    r"template (error|not found|missing)|missing template|\btodo\b",
]
#: Weak phrases, which count only in widely recurring or dominating messages.
WEAK = [r"\b(browser|javascript|(page|web) server|viewer|cookies|settings and refresh|reload|erneut versuchen|servidor|serveur|navigateur|navegador)\b"]
#: Sources in which a message with a weak phrase, or with none, must recur; different documents that must show one with none, and
#: the part of them that must hold residue by the rules.
MIN_SOURCES, MIN_DOCS, COMPANY = 2, 5, 0.8
#: Syllables of pseudo-Latin filler.
LATIN = "lor em ip is sum dol or sit am et con sec tet ur ad pis cing el it sed do eius mod temp inc id id unt ut lab ore mag na al iq ua qua en im min ven iam quis nos trud ex er cit at ion ul la co por vel fac nis int ult tem te a o i um us ibus que se cus ius tu ti ta to".split()
#: Spelled numbers, masked like figures.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split()


_STRONG, _WEAK, _HOLDER = ("|".join(f"(?:{p})" for p in ps) for ps in (STRONG, WEAK, PLACEHOLDERS))
_LATIN = r"\b(?:" + "|".join(sorted(set(LATIN), key=len, reverse=True)) + r"){2,}\b"
_NUMBERS = r"\b(?:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")(?:-[a-z]+)?\b"


#: A line end inside a sentence; the end of a sentence; a quotation; a word that counts for filler.
LINE_END, SENTENCE_END, QUOTED, LONG_WORD = r"([^.!?\n])\n([^\n])", r"([.!?][\"'”]?)\s+", r"[\"“„«][^\"“”„«»]*[\"”“»]", r"\b\pL{4,}\b"
_NAME = (r"([\pL\pN,;:] )\p{Lu}\p{Ll}+\b", r"\1N")
#: Replacements that mask a message, in order: addresses A, names N (neighbours share a blank, so twice), lower case (None), numbers
#: and dates #, blanks.
MASKS = [(r"\b(https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", "A"), _NAME, _NAME, None, (_NUMBERS, "#"), (r"\$?\d[\d,.:]*", "#"), (r"\s+", " ")]


def cut_messages(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(row of each message, message): line ends inside a sentence are blanks; sentences and lines are cut apart."""
    t = pc.fill_null(texts, "")
    for _ in range(2):  # neighbouring one-character lines share a character of the pattern
        t = pc.replace_substring_regex(t, LINE_END, r"\1 \2")
    t = pc.replace_substring_regex(t, SENTENCE_END, "\\1\n")
    parts = pc.split_pattern_regex(t, pattern=r"\n+")
    return pc.list_parent_indices(parts), pc.utf8_trim_whitespace(pc.list_flatten(parts))


def unquoted(messages: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(messages, QUOTED, " Q ")


def masked(messages: pa.Array) -> pa.Array:
    """The normalised form of unquoted messages."""
    x = messages
    for m in MASKS:
        x = pc.utf8_lower(x) if m is None else pc.replace_substring_regex(x, *m)
    return pc.utf8_trim_whitespace(x)


def signs(plain: pa.Array, mask: pa.Array) -> pa.Array:
    """placeholder, phrase, filler or weak for each message, else null."""
    words = pc.count_substring_regex(mask, LONG_WORD)
    latin = pc.count_substring_regex(mask, _LATIN)
    filler = pc.and_(pc.greater_equal(words, 4), pc.greater_equal(pc.cast(latin, pa.float64()), pc.multiply(0.85, pc.cast(words, pa.float64()))))
    kinds = pa.array(["placeholder", "phrase", "filler", "weak"])
    tests = pa.StructArray.from_arrays(
        [pc.match_substring_regex(plain, _HOLDER), pc.match_substring_regex(mask, _STRONG), filler, pc.match_substring_regex(mask, _WEAK)], names=list("abcd")
    )
    return pc.case_when(tests, *kinds)


def _classified(plain: pa.Array, mask: pa.Array) -> tuple[np.ndarray, list[str], pa.Array]:
    """(number of each message's form, distinct masked forms, sign of each message): the rules run once per distinct form."""
    pairs = pc.dictionary_encode(pc.binary_join_element_wise(plain, mask, "\x00"))
    first = np.full(len(pairs.dictionary), -1)
    codes = pairs.indices.to_numpy()
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    at = pa.array(first)
    sign = signs(plain.take(at), mask.take(at)).take(pairs.indices)
    forms = pc.dictionary_encode(mask)
    return forms.indices.to_numpy(), forms.dictionary.to_pylist(), sign


MESSAGES = "source string, copy bigint, hashes array<bigint>, signed array<struct<hash:bigint,message:string,sign:string>>"


def document_messages(docs: DataFrame) -> DataFrame:
    """(doc_id, source, copy, hashes, signed): a hash of each document's text, the distinct hashes of all its messages, and the messages that
    show a sign of residue."""
    key_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(key_type), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("hash", pa.int64()), ("message", pa.string()), ("sign", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            row, raw = cut_messages(b.column(2))
            plain = unquoted(raw)
            form, texts, sign = _classified(plain, masked(plain))
            known = [xxhash.xxh64_intdigest(m) - (1 << 63) for m in texts]
            hashes: list[dict[int, None]] = [{} for _ in range(b.num_rows)]
            signed: list[dict[tuple, None]] = [{} for _ in range(b.num_rows)]
            rows = row.to_pylist()
            for d, f in zip(rows, form.tolist(), strict=True):
                if texts[f]:
                    hashes[d][known[f]] = None
            for at in pc.indices_nonzero(pc.is_valid(sign)).to_pylist():
                f = form[at]
                signed[rows[at]][known[f], texts[f], sign[at].as_py()] = None
            cells = [[dict(zip(("hash", "message", "sign"), x, strict=True)) for x in s] for s in signed]
            copy = [xxhash.xxh64_intdigest(t or "") - (1 << 63) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(copy, kinds[2]), pa.array([list(h) for h in hashes], kinds[3]), pa.array(cells, kinds[4])], names=["doc_id", "source", "copy", "hashes", "signed"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {key_type.simpleString()}, {MESSAGES}")


def message_groups(found: DataFrame) -> DataFrame:
    """One row per masked message that recurs in the company of residue or shows a sign: hash, n_docs and n_sources (a text counts once
    per source), n_marked (documents with a placeholder, phrase or filler), kind (null if it is no residue). For a message without
    a sign copies of a text count once altogether. Counted per (message, source) first, so a message with a third of
    all documents is no hot group."""
    sure = F.exists("signed", lambda x: x["sign"] != "weak")
    one = found.select("copy", F.coalesce("source", F.lit("")).alias("source"), "hashes", sure.alias("sure"))
    one = cut(one.groupBy("copy", "source").agg(F.first("hashes").alias("hashes"), F.max("sure").alias("sure")))
    shown = one.select("copy", "source", "sure", F.explode("hashes").alias("hash"))
    per = shown.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("m"))
    groups = cut(per.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"), F.sum("m").alias("n_marked")).where("n_marked > 0 or n_sources > 1"))
    own = cut(found.select(F.explode("signed").alias("x")).select("x.hash", "x.sign").distinct().groupBy("hash").agg(F.max(F.when(F.col("sign") != "weak", F.col("sign"))).alias("rule")))
    many = (F.col("n_sources") >= MIN_SOURCES) & (F.col("n_docs") >= MIN_DOCS) & (F.col("n_marked") >= COMPANY * F.col("n_docs"))
    ruled = lookup_join(groups, own, ["hash"], "inner")
    ruled = ruled.withColumn("kind", F.coalesce("rule", F.when(F.col("n_sources") >= MIN_SOURCES, "recurring"))).drop("rule")
    silent = cut(lookup_join(groups.where(many), own.select("hash"), ["hash"], "left_anti"))
    texts = lookup_join(shown, silent.select("hash"), ["hash"], "left_semi").groupBy("hash", "copy").agg(F.max("sure").alias("sure"))
    texts = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.count_if("sure").alias("s"))
    silent = silent.join(texts, "hash").withColumn("kind", F.when((F.col("c") >= MIN_DOCS) & (F.col("s") >= COMPANY * F.col("c")), "company"))
    return ruled.unionByName(silent.drop("c", "s"))


def flag_residue(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds): the documents that hold a group of residue, with the sorted kinds placeholder, phrase, filler, recurring (a weak
    phrase in several sources), company (stands nearly always beside residue). Null texts are clean; columns other than
    doc_id, source and text are ignored; repeated doc_ids come out once; null doc_ids too."""
    found = cut(document_messages(docs))
    sure = found.select("doc_id", F.explode("signed").alias("x")).where("x.sign <> 'weak'").select("doc_id", F.col("x.sign").alias("kind"))
    by_group = message_groups(found).where("kind in ('recurring', 'company')").select("hash", "kind")
    rest = lookup_join(found.select("doc_id", F.explode("hashes").alias("hash")), cut(by_group), ["hash"], "inner").select("doc_id", "kind")
    return sure.unionByName(rest).groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def residue_messages(docs: DataFrame) -> DataFrame:
    """Report of all groups of residue: message (its masked form), n_docs, n_sources, n_marked, kind. The forms of the groups found
    are read from the texts in a second pass."""
    groups = cut(message_groups(cut(document_messages(docs))).where("kind is not null"))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = pc.unique(masked(unquoted(cut_messages(b.column(0))[1])))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(m) - (1 << 63) for m in texts.to_pylist()], pa.int64()), texts], names=["hash", "message"])

    named = lookup_join(docs.select("text").mapInArrow(forms, "hash bigint, message string"), groups.select("hash"), ["hash"], "left_semi")
    return groups.join(named.groupBy("hash").agg(F.min("message").alias("message")), "hash").select("message", "n_docs", "n_sources", "n_marked", "kind")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents free of residue, all columns kept; a document without a doc_id is judged like the others without one."""
    return null_safe_join(docs, flag_residue(docs).select("doc_id"), ["doc_id"], "left_anti")

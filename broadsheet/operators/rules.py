"""Rules over parsed text: person mentions, within-article entities, signals, roles and speech events.

Input is a token table (article_id, i, sent, text, lemma, pos, dep, head, ent_label, ent_id, idx); a parser is a plug-in
(``parse_texts``). Rules that need only words near each other are joins; those that walk the dependency tree run per
article on Arrow batches: an article's tokens are bounded, and no group spans articles."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from broadsheet.functions import lexicons as L

TOKENS = "article_id string, i int, sent int, text string, lemma string, pos string, dep string, head int, ent_label string, ent_id int, idx int"
ENTITIES = (
    "article_id string, entity_id string, name string, surname string, given string, hclass string, n_mentions int, n_ner_mentions int, gender_h string, gender_hp string, "
    "gender_hpn string, src_hp string, pron_signal string, gnoun_signal string, n_pron_f int, n_pron_m int, roles_a array<string>, roles_b array<string>, titles array<string>, "
    "n_quotes_name int, n_quotes_pron int, n_direct_name int, quote_chars_name int, agent_verbs array<string>, patient_verbs array<string>, poss_nouns array<string>, "
    "adjs array<string>, first_tok int, rel_pos double, n_ambiguous_dropped int"
)
ARTICLE_COUNTS = "article_id string, n_tokens int, n_sents int, n_ner_person int, n_mentions int, n_pattern_mentions int, n_entities int, n_ambiguous_dropped int, n_speech_events int"
#: Words either side of a mention in which role words are looked for; longest name in tokens.
WINDOW, MAX_NAME = 10, 6
#: Rows of a batch that ``extract_entities`` hands back.
BATCH = 5_000
#: Texts of tokens whose bare words a worker remembers.
WORDS = 50_000
_EDGES, _LETTER, _NO_NAME, _NAME = re.compile(r"^\W+|\W+$"), re.compile("[A-Za-z]"), re.compile(r"[^a-z'-]"), re.compile(r"[A-Z][A-Za-z'\-]*\.?")


def parse_texts(docs: DataFrame, load_parser: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """Token rows of docs(article_id, text). ``load_parser`` runs once per task and returns text -> token tuples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load_parser()
        names = [c.split()[0] for c in TOKENS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(a, *t) for a, text in zip(b["article_id"], b["text"], strict=True) for t in parse(text or "")], columns=names)

    return docs.select("article_id", "text").mapInPandas(run, TOKENS)


# ------------------------------------------------------------------ rules as joins


def pattern_mentions(text: Column) -> Column:
    """Courtesy title, optional dot and one to three name-shaped words, as they stand in the text; initials alone are no name."""
    titles = "|".join(sorted((w.capitalize() for w in L.COURTESY), key=lambda w: (-len(w), w)))
    name = r"(?:[A-Z]\.|[A-Z][A-Za-z'-]+)"
    return F.regexp_extract_all(text, F.lit(rf"\b(?:{titles})\b\.? (?:[A-Z]\. ){{0,2}}[A-Z][A-Za-z'-]+(?: {name})?"), F.lit(0))


def lexical_window_roles(tokens: DataFrame, mentions: DataFrame, lexicon: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (article_id, m, role): roles whose words stand within ``window`` tokens of mention m in its sentence.

    tokens(article_id, sent, i, word), mentions(article_id, m, sent, s, e) with the span [s, e), lexicon(word, role). Only
    tokens that are role words take part in the join on (article, sentence)."""
    hits = tokens.join(lexicon, "word").select("article_id", "sent", "i", "role")
    near = (F.col("i") >= F.col("s") - window) & (F.col("i") < F.col("e") + window) & ~F.col("i").between(F.col("s"), F.col("e") - 1)
    return hits.join(mentions, ["article_id", "sent"]).where(near).select("article_id", "m", "role").distinct()


def resolve_gender(df: DataFrame, hclass: str, pronouns: str, nouns: str) -> DataFrame:
    """Adds gender_h, gender_hp, gender_hpn, src_hp, pron_signal, gnoun_signal from a class F/M/N and two arrays of signals:
    titles decide; else pronouns with a two-thirds majority, nouns (if they agree) before pronouns in the widest tier."""
    n = lambda c, v: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x == v))
    f, m = n(pronouns, "F"), n(pronouns, "M")
    pron = F.when((f > 0) & (3 * f >= 2 * (f + m)), "F").when((m > 0) & (3 * m >= 2 * (f + m)), "M").otherwise("UNKNOWN")
    source = F.when(f + m == 0, "none").when(pron == "UNKNOWN", "conflict").otherwise("pronoun")
    nf, nm = n(nouns, "F") > 0, n(nouns, "M") > 0
    noun = F.when(nf & nm, "CONFLICT").when(nf, "F").when(nm, "M").otherwise("UNKNOWN")
    titled = F.col(hclass).isin("F", "M")
    return df.withColumns(
        {
            "gender_h": F.when(titled, F.col(hclass)).otherwise("UNKNOWN"),
            "gender_hp": F.when(titled, F.col(hclass)).otherwise(pron),
            "gender_hpn": F.when(titled, F.col(hclass)).when(noun.isin("F", "M"), noun).otherwise(pron),
            "src_hp": F.when(titled, "honorific").otherwise(source),
            "pron_signal": pron,
            "gnoun_signal": noun,
        }
    )


# ------------------------------------------------------------------ rules over the dependency tree


@lru_cache(WORDS)
def bare(text: str) -> str:
    """Lower case, without marks at either end."""
    return _EDGES.sub("", text.lower())


@dataclass
class Person:
    """A mention: token span [s, e), its titles and the entity it belongs to (-1 open, -2 ambiguous)."""

    s: int
    e: int
    source: str
    titles: list[int]
    hclass: str
    given: str
    surname: str
    ent: int = -1


@dataclass
class Entity:
    hclass: str
    given: str
    surname: str
    members: list[Person] = field(default_factory=list)


class Article:
    """Token columns of one article with tree access; all rules of one article."""

    def __init__(self, rows: pd.DataFrame | dict[str, list], lexicon: dict[str, str]):
        if isinstance(rows, pd.DataFrame):
            rows = rows.sort_values("i", kind="stable").to_dict("list")
        self.text, self.lemma = [str(x) for x in rows["text"]], [str(x).lower() for x in rows["lemma"]]
        self.pos, self.dep = rows["pos"], rows["dep"]
        base = int(rows["i"][0]) if rows["i"] else 0
        self.head = [int(h) - base for h in rows["head"]]
        self.sent = rows["sent"]
        self.label, self.span = rows["ent_label"], rows["ent_id"]
        self.idx = rows["idx"]
        self.n = len(rows["i"])
        self.kids = defaultdict(list)
        for i, h in enumerate(self.head):
            if h != i:
                self.kids[h].append(i)
        self.word = [bare(t) for t in self.text]
        self.lexicon = lexicon
        self.persons = self._persons()
        self.n_mentions, self.n_pattern = len(self.persons), sum(p.source == "pattern" for p in self.persons)
        self.entities, self.dropped = self._resolve()
        self.persons = [p for p in self.persons if p.ent >= 0]
        self.owner = {i: p.ent for p in self.persons for i in (*p.titles, *range(p.s, p.e))}

    # -- mentions
    def _title(self, i: int) -> bool:
        return self.word[i] in L.ALL_TITLES

    def _person(self, s: int, e: int, source: str) -> Person | None:
        inner = []
        while s < e - 1 and (self.text[s] in ".," or self._title(s)):
            if self._title(s):
                inner.append(s)
            s += 1
        before, i = [], s - 1 - (len(inner) and s - inner[0])
        while i >= 0 and len(before) < 3 and (self.text[i] == "." or (self._title(i) and self.text[i][:1].isupper())):
            if self.text[i] != ".":
                before.insert(0, i)
            i -= 1
        titles = before + inner
        span = [i for i in range(s, e) if _LETTER.search(self.text[i]) and self.text[i] not in ("'s",)]
        if not span or e - s > MAX_NAME or not any(self.text[i][:1].isupper() for i in span):
            return None
        parts = [w for w in (_NO_NAME.sub("", self.text[i].lower()).strip("'-") for i in span) if w]
        last = [w for w in parts if len(w) > 1 and w not in ("jr", "sr", "ii", "iii")]
        if not last:
            return None
        surname = last[-1]
        given = parts[0] if len(parts) > 1 and parts[0] != surname else ""
        words = {self.word[t] for t in titles}
        f, m = bool(words & L.HONORIFIC_F), bool(words & L.HONORIFIC_M)
        return Person(s, e, source, titles, "F" if f and not m else "M" if m and not f else "N", given, surname)

    def _persons(self) -> list[Person]:
        found, used = [], set()
        spans = defaultdict(list)
        for i in range(self.n):
            if self.label[i] == "PERSON" and (k := self.span[i]) is not None and k == k:
                spans[k].append(i)
        for members in spans.values():
            p = self._person(min(members), max(members) + 1, "ner")
            if p:
                found.append(p)
                used.update(members, p.titles)
        for i in range(self.n):
            if i in used or self.word[i] not in L.COURTESY or not self.text[i][:1].isupper():
                continue
            a = i + 1 + (i + 1 < self.n and self.text[i + 1] == ".")
            b = a
            while b < self.n and b - a < 3 and b not in used and _NAME.fullmatch(self.text[b]) and not self._title(b):
                b += 1
            p = self._person(i, b, "pattern") if b > a else None
            if p and any(len(self.text[k].strip(".")) > 1 for k in range(p.s, p.e)):
                found.append(p)
                used.update(range(i, b))
        return sorted(found, key=lambda p: p.s)

    # -- entities
    def _resolve(self) -> tuple[list[Entity], int]:
        """Full names first; a bare surname joins the only fitting entity, makes a new one, or is dropped as ambiguous."""
        ents: list[Entity] = []
        for p in (p for p in self.persons if p.given):
            at = next((k for k, e in enumerate(ents) if (e.hclass, e.given, e.surname) == (p.hclass, p.given, p.surname)), None)
            if at is None:
                at = len(ents)
                ents.append(Entity(p.hclass, p.given, p.surname))
            p.ent = at
            ents[at].members.append(p)
        dropped = 0
        for p in (p for p in self.persons if not p.given):
            kin = [k for k, e in enumerate(ents) if e.surname == p.surname]
            same = [k for k in kin if ents[k].hclass == p.hclass]
            if p.hclass == "N":
                fit = kin
            else:
                fit = same or [k for k in kin if ents[k].hclass == "N"]
            if len(fit) > 1:
                p.ent, dropped = -2, dropped + 1
                continue
            if fit:
                at = fit[0]
                if p.hclass != "N":
                    ents[at].hclass = p.hclass
            else:
                at = len(ents)
                ents.append(Entity(p.hclass, "", p.surname))
            p.ent = at
            ents[at].members.append(p)
        return ents, dropped

    # -- tree helpers
    def root(self, p: Person) -> int:
        return next((i for i in range(p.s, p.e) if not p.s <= self.head[i] < p.e or self.head[i] == i), p.s)

    def under(self, i: int, *deps: str) -> list[int]:
        return [c for c in self.kids[i] if self.dep[c] in deps]

    def subtree(self, i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += self.kids[k]
        return sorted(out)

    def salient(self, p: Person) -> bool:
        """May claim a pronoun: an argument of its sentence, and no other entity is the subject while it is not."""
        d = self.dep[self.root(p)]
        if d in ("nsubj", "nsubjpass"):
            return True
        if d not in ("ROOT", "dobj", "attr", "appos", "conj"):
            return False
        rivals = (o for o in self.persons if o.ent != p.ent and self.sent[o.s] == self.sent[p.s])
        return not any(self.dep[self.root(o)] in ("nsubj", "nsubjpass") for o in rivals)

    def pronoun(self, p: Person) -> str | None:
        """First gendered pronoun up to the end of the next sentence, before any other person or human noun."""
        if not self.salient(p):
            return None
        for i in range(p.e, self.n):
            if self.sent[i] > self.sent[p.s] + 1 or self.owner.get(i, p.ent) != p.ent:
                return None
            w = self.text[i].lower()
            if w in L.PRONOUN_F or w in L.PRONOUN_M:
                return "F" if w in L.PRONOUN_F else "M"
            if self.pos[i] == "NOUN" and (self.lemma[i] in L.NOUN_F or self.lemma[i] in L.NOUN_M or self.lemma[i] in self.lexicon):
                return None
        return None

    def noun_signal(self, p: Person) -> str | None:
        r = self.root(p)
        signs = {L.KIN_TITLES[self.word[t]] for t in p.titles if self.word[t] in L.KIN_TITLES and self.text[t][:1].isupper()}
        near = [c for c in self.under(r, "appos", "compound") if not p.s <= c < p.e]
        if self.dep[r] == "appos":
            near.append(self.head[r])
        signs |= {"F" for c in near if self.lemma[c] in L.NOUN_F} | {"M" for c in near if self.lemma[c] in L.NOUN_M}
        return signs.pop() if len(signs) == 1 else None

    def pronouns(self, e: Entity) -> list[str]:
        return [s for p in e.members if (s := self.pronoun(p))]

    def genders(self) -> list[tuple[str, str, str, str, str, str]]:
        """(honorific, with pronouns, with pronouns and nouns, source, pronoun signal, noun signal) of each entity."""
        out = []
        for e in self.entities:
            sig, src = majority(self.pronouns(e))
            ns = {s for p in e.members if (s := self.noun_signal(p))}
            gn = "CONFLICT" if len(ns) > 1 else next(iter(ns), "UNKNOWN")
            if e.hclass in "FM":
                out.append((e.hclass, e.hclass, e.hclass, "honorific", sig, gn))
            else:
                out.append(("UNKNOWN", sig, gn if gn in "FM" else sig, src, sig, gn))
        return out

    @cached_property
    def gender(self) -> list[tuple[str, str, str, str, str, str]]:
        return self.genders()

    # -- roles
    def roles_near(self, p: Person) -> set[str]:
        span = (i for i in range(max(0, p.s - WINDOW), min(self.n, p.e + WINDOW)) if not p.s <= i < p.e and self.sent[i] == self.sent[p.s] and self.pos[i] in ("NOUN", "PROPN"))
        return {r for i in span if (r := self.lexicon.get(self.word[i]) or self.lexicon.get(self.lemma[i]))}

    def roles_of_head(self, h: int) -> set[str]:
        key = next((w for w in (self.lemma[h], self.word[h]) if w in L.ORG_DEFAULT or w in self.lexicon), None)
        out = set()
        if key in L.ORG_DEFAULT:
            orgs = self.under(h, "compound")
            for prep in self.under(h, "prep"):
                if self.text[prep].lower() in ("of", "for", "at"):
                    for obj in self.under(prep, "pobj"):
                        orgs += [obj, *[x for x in self.subtree(obj) if x != obj]]
            kind = next((L.ORG_ROLE[w] for c in orgs if (w := self.lemma[c].strip(".")) in L.ORG_ROLE), L.ORG_DEFAULT[key])
            out |= {kind} if kind else set()
        elif key:
            out.add(self.lexicon[key])
        for c in self.under(h, "compound"):
            r = self.lexicon.get(self.lemma[c])
            if r and r != "FAMILY" and self.lemma[c] not in L.ORG_DEFAULT:
                out.add(r)
        return out

    def roles_stated(self, p: Person) -> set[str]:
        r = self.root(p)
        v, d = self.head[r], self.dep[r]
        verb = self.lemma[v]
        out = {L.TITLE_ROLE[self.word[t]] for t in p.titles if L.TITLE_ROLE.get(self.word[t])}
        out |= {self.lexicon[self.lemma[c]] for c in self.under(r, "compound") if c < p.s and self.lemma[c] in self.lexicon and self.lemma[c] not in L.ORG_DEFAULT}
        heads = [c for c in self.under(r, "appos") if not p.s <= c < p.e] + ([v] if d == "appos" else [])
        if d in ("nsubj", "nsubjpass"):
            if verb in ("be", "become", "remain"):
                heads += self.under(v, "attr", "acomp")
            if verb == "serve":
                heads += [o for prep in self.under(v, "prep") if self.text[prep].lower() == "as" for o in self.under(prep, "pobj")]
            if verb in L.APPOINT:
                heads += [c for c in self.under(v, "oprd", "xcomp", "attr", "dobj") if not p.s <= c < p.e]
        crime = (d == "nsubjpass" and verb in L.CRIME_PASSIVE) or (d == "nsubj" and verb in L.CRIME_ACTIVE) or (d == "dobj" and verb in L.CRIME_OBJECT)
        out |= {"CRIME_ACCIDENT"} if crime else set()
        return out.union(*[self.roles_of_head(h) for h in heads])

    # -- speech
    def sentence_text(self, s: int) -> str:
        ids = [i for i in range(self.n) if self.sent[i] == s]
        if not ids:
            return ""
        a = self.idx[ids[0]]
        out = [" "] * (self.idx[ids[-1]] + len(self.text[ids[-1]]) - a)
        for i in ids:
            out[self.idx[i] - a : self.idx[i] - a + len(self.text[i])] = self.text[i]
        return "".join(out)

    @staticmethod
    def quoted(t: str) -> int:
        parts = t.split('"')
        return len(parts[1]) if len(parts) == 2 else sum(len(x) for k, x in enumerate(parts[:-1]) if k % 2)

    def speech(self, gender: list[str]) -> list[tuple[int, str, bool, int, str]]:
        """(entity, how, direct, characters, verb) of attributed speech."""
        out = []
        for v in range(self.n):
            if self.pos[v] != "VERB" or self.lemma[v] not in L.SPEECH or not (subj := self.under(v, "nsubj")):
                continue
            s = subj[0]
            who, how = self.owner.get(s), "name"
            if who is None and self.text[s].lower() in ("he", "she"):
                want, how = "F" if self.text[s].lower() == "she" else "M", "pronoun"
                before = [p for p in self.persons if p.e <= s and self.sent[p.s] >= self.sent[s] - 1]
                who = next((p.ent for p in reversed(before) if gender[p.ent] == want and self.salient(p)), None)
            if who is None:
                continue
            here = self.sentence_text(self.sent[v])
            prev = self.sentence_text(self.sent[v] - 1)
            short = sum(x == self.sent[v] for x in self.sent) < 10
            if '"' in here:
                direct, chars = True, self.quoted(here)
            elif short and '"' in prev:
                direct, chars = True, self.quoted(prev)
            else:
                parts = [self.subtree(c) for c in self.under(v, "ccomp")]
                direct, chars = False, sum(self.idx[t[-1]] + len(self.text[t[-1]]) - self.idx[t[0]] for t in parts)
            out.append((who, how, direct, chars, self.lemma[v]))
        return out

    @cached_property
    def said(self) -> list[tuple[int, str, bool, int, str]]:
        return self.speech([g[1] for g in self.gender])

    def language(self, p: Person) -> tuple[list[str], list[str], list[str], list[str]]:
        """(agent verbs, patient verbs, possessed nouns, adjectives)."""
        r = self.root(p)
        d, h = self.dep[r], self.head[r]
        agent = [self.lemma[h]] if d == "nsubj" and self.pos[h] in ("VERB", "AUX") and self.lemma[h] != "be" else []
        patient = [self.lemma[h]] if d in ("nsubjpass", "dobj") else []
        poss = [self.lemma[h]] if d == "poss" else []
        adjs = [self.lemma[a] for x in (*self.under(r, "appos"), r) for a in self.under(x, "amod") if self.pos[a] == "ADJ" and not p.s <= a < p.e]
        return agent, patient, poss, adjs


def majority(signals: list[str]) -> tuple[str, str]:
    """(signal, source) of pronoun signals under the two-thirds rule."""
    if not signals:
        return "UNKNOWN", "none"
    top, n = Counter(signals).most_common(1)[0]
    return (top, "pronoun") if 3 * n >= 2 * len(signals) else ("UNKNOWN", "conflict")


# Parts of a row of ``ENTITIES``: of article a under a key, entity k with the mentions ms.


def _keys(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    return key, f"{key}#{k}"


def _names(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    e = a.entities[k]
    return max((" ".join(a.text[p.s : p.e]) for p in ms), key=len), e.surname, e.given, e.hclass, len(ms), sum(p.source == "ner" for p in ms)


def _signals(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    pronouns = a.pronouns(a.entities[k])
    return *a.gender[k], pronouns.count("F"), pronouns.count("M")


def _roles(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    return sorted(set().union(*[a.roles_near(p) for p in ms])), sorted(set().union(*[a.roles_stated(p) for p in ms]))


def _titles(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    return (sorted({a.word[t] for p in ms for t in p.titles}),)


def _speech(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    names = [q for q in a.said if q[0] == k and q[1] == "name"]
    return len(names), sum(q[0] == k and q[1] == "pronoun" for q in a.said), sum(q[2] for q in names), sum(q[3] for q in names)


def _language(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    lang = [a.language(p) for p in ms]
    return tuple([x for r in lang for x in r[n]] for n in range(4))


def _place(key: str, a: Article, k: int, ms: list[Person]) -> tuple:
    return ms[0].s, round(ms[0].s / max(a.n, 1), 4), a.dropped


#: The parts in the order of ``ENTITIES`` and how many columns each has.
PARTS = ((_keys, 2), (_names, 6), (_signals, 8), (_roles, 2), (_titles, 1), (_speech, 4), (_language, 4), (_place, 3))
ENTITY_COLUMNS = [c.rsplit(" ", 1)[0] for c in ENTITIES.split(", ")]


def parts_of(columns: list[str]) -> tuple[list[Callable], list[int]]:
    """The parts that hold the columns, and the places of the columns in the parts put together."""
    used, held, at = [], [], 0
    for part, n in PARTS:
        own = ENTITY_COLUMNS[at : at + n]
        at += n
        if set(own) & set(columns):
            used.append(part)
            held += own
    return used, [held.index(c) for c in columns]


ALL_PARTS = parts_of(ENTITY_COLUMNS)


def article_entities(key: str, a: Article, wanted: tuple[list[Callable], list[int]] = ALL_PARTS) -> list[tuple]:
    """The rows of ``ENTITIES`` of one article, or their columns of ``parts_of``: other parts are not worked out."""
    parts, places = wanted
    out = []
    for k, e in enumerate(a.entities):
        if not e.members:
            continue
        ms = sorted(e.members, key=lambda p: p.s)
        row = [x for part in parts for x in part(key, a, k, ms)]
        out.append(tuple([row[i] for i in places]))
    return out


def _entity_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ENTITY_COLUMNS)


def extract_entities(tokens: DataFrame, lexicon: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """One row per person of each article (schema ``ENTITIES``, or those of its columns that are asked for) of a token table;
    ``lexicon`` maps role words to roles. Articles without persons have no row; entities whose mentions were all ambiguous have
    none either. Use ``extract_articles`` where the parser can run in the same pass: then no token is shuffled."""

    names, numbers = [c.split()[0] for c in TOKENS.split(", ")], ("sent", "head", "ent_id", "idx")
    columns = columns or ENTITY_COLUMNS
    schema = tokens.sparkSession.createDataFrame([], ENTITIES).select(columns).schema

    def values(c: str, x: pa.Array) -> list:
        if c not in numbers or not x.null_count:
            return x.to_numpy(zero_copy_only=False).tolist()
        return [float("nan") if v is None else v for v in x.to_pylist()]  # a missing number equals nothing

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, list]]]:
        """The columns of one article after another; an article may go on in the next batches."""
        key, held = None, None
        for b in batches:
            cols = {c: values(c, b.column(c)) for c in names}
            ids = cols["article_id"]
            a = 0
            while a < len(ids):
                e = a + 1
                while e < len(ids) and ids[e] == ids[a]:
                    e += 1
                part = {c: x[a:e] for c, x in cols.items()}
                if held is not None and key == ids[a]:
                    for c in names:
                        held[c] += part[c]
                else:
                    if held is not None:
                        yield key, held
                    key, held = ids[a], part
                a = e
        if held is not None:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, wanted = to_arrow_schema(schema), parts_of(columns)
        out: list[tuple] = []
        for key, rows in articles(batches):
            out += article_entities(key, Article(rows, lexicon), wanted)
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    # a window moves the tokens only if they do not lie by article yet; its number is handed on, else it would be left out
    n = F.row_number().over(Window.partitionBy("article_id").orderBy(F.asc_nulls_last("i")))
    return tokens.select(*names).withColumn("_n", n).mapInArrow(run, schema)


def extract_articles(docs: DataFrame, load_parser: Callable[[], Callable[[str], list[tuple]]], lexicon: dict[str, str]) -> DataFrame:
    """Parse docs(article_id, text) and apply the rules in one narrow pass: an article's tokens never leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load_parser()
        names = [c.split()[0] for c in TOKENS.split(", ")][1:]
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b["article_id"], b["text"], strict=True):
                tokens = parse(text or "")
                if tokens:
                    out += article_entities(key, Article(pd.DataFrame(tokens, columns=names), lexicon))
            yield _entity_frame(out)

    return docs.select("article_id", "text").mapInPandas(run, ENTITIES)


def article_counts(key: str, a: Article) -> tuple:
    """The row of ``ARTICLE_COUNTS`` of one article."""
    said = a.speech([genders[1] for genders in a.genders()])
    return (
        key, a.n, len(set(a.sent)), len({s for s, x in zip(a.span, a.label, strict=True) if x == "PERSON" and not pd.isna(s)}), a.n_mentions,
        a.n_pattern, sum(bool(e.members) for e in a.entities), a.dropped, len(said),
    )


def count_articles(tokens: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """One row per article of a token table with the counts of ``ARTICLE_COUNTS``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([article_counts(rows["article_id"].iloc[0], Article(rows, lexicon))], columns=[c.rsplit(" ", 1)[0] for c in ARTICLE_COUNTS.split(", ")])

    return tokens.groupBy("article_id").applyInPandas(run, ARTICLE_COUNTS)

"""Names in running text by a ladder of evidence.

A candidate is a pair of neighbouring words or one word. What a document knows of a word (whether it also occurs bare, with
the definite letter, with another prefix letter) is one hash table of its distinct words, so a long document costs as much
per word as a short one. A document is one row; its words are walked in Arrow batches of bounded size, and only its texts
are shuffled. Lexicons are lists of a fixed size and become hash sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import ship
from ..functions import text as tx


@dataclass(frozen=True)
class Lexicons:
    """Word lists and patterns of a language; an empty list or pattern switches its rules off."""

    speech: list[str] = field(default_factory=list)  # verbs that follow a speaker, and other verbs
    attribution: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    roles2: list[str] = field(default_factory=list)  # roles of two words
    kin: list[str] = field(default_factory=list)
    persons: list[str] = field(default_factory=list)  # prepositions that persons take
    care: list[str] = field(default_factory=list)
    relative: list[str] = field(default_factory=list)
    common: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=list)
    namelike: list[str] = field(default_factory=list)  # ordinary words that are also names
    places: list[str] = field(default_factory=list)
    firsts: list[str] = field(default_factory=list)
    lead: list[str] = field(default_factory=list)
    trail: list[str] = field(default_factory=list)
    placeholders: list[str] = field(default_factory=list)
    prefixes: str = ""
    definite: str = ""
    of: str = ""
    with_: str = ""
    from_the: str = ""  # patterns
    joined: str = ""
    negation: str = ""
    first_person: str = ""
    plural: str = ""
    infinitive: str = ""
    surname: str = ""
    title: str = ""
    public: str = ""
    word_class: str = "any"


#: Fixed values of the Hebrew rules: prefix letters, the definite letter, "of", "with", and the patterns of word forms.
HEBREW = {
    "prefixes": "מבלוהשכ", "definite": "ה", "of": "של", "with_": "עם", "from_the": "^מה[א-ת]{2,}$", "joined": "ו", "negation": "^[בהולמכש]?(?:אינ[הוםן]|איני|אין|לא|בלי|ללא)$",
    "first_person": "(?:תי|נו)$", "plural": "(?:ים|ית|יות)$", "infinitive": "^לה[א-ת]{3,}$", "surname": "(?:ביץ|ביץ'|סקי|סקה|ברג|בורג|שטיין|שטין|צקי|ייב|ייבה)$", "word_class": "he",
}


#: Points of the ladder's steps, and what each step says.
STEPS = [
    (3, "before a verb"), (3, "after an attribution"), (3, "after a role"), (3, "after a role of two words"), (3, "after kin"), (3, "after a preposition of persons"), (3, "after with"), (3, "before a clause"), (2, "after of, with a prefix"), (2, "near care"),
]


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False))


def _has(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.isin(words), F.lit(False)) if words else F.lit(False)


def _like(c: Column, rx: str) -> Column:
    return F.coalesce(c.rlike(rx), F.lit(False)) if rx else F.lit(False)


def _prefixed(c: Column, lex: Lexicons) -> Column:
    return _has(F.substring(c, 1, 1), list(lex.prefixes))


def _rest(c: Column, n: int = 1) -> Column:
    return F.substring(c, n + 1, 1 << 30)


def form_facts(words: DataFrame, by: list[str], lex: Lexicons) -> DataFrame:
    """(by, form, present, definite, prefixes) of the distinct words(by, w): forms that occur bare, with the definite
    letter, and the prefix letters that they occur with."""
    none = F.lit(None).cast("string")
    seen = F.array(F.struct(F.col("w").alias("form"), none.alias("q")), F.struct(F.when(_prefixed(F.col("w"), lex), _rest(F.col("w"))).alias("form"), F.substring("w", 1, 1).alias("q")))
    rows = words.select(*by, F.inline(seen)).where("form <> ''")
    definite = F.bool_or(F.coalesce(F.col("q") == lex.definite, F.lit(False)))
    return rows.groupBy(*by, "form").agg(F.bool_or(F.col("q").isNull()).alias("present"), definite.alias("definite"), F.collect_set("q").alias("prefixes"))


def verb_tail(w: Column, lex: Lexicons) -> Column:
    """Whether a word after a name is a verb or a common word that does not belong to it."""
    family = _has(w, lex.firsts) | _like(w, lex.surname)
    return ~family & (_has(w, lex.speech) | _has(w, lex.common) | _like(w, lex.infinitive))


def _known_words(known: list[str]) -> list[str]:
    """Known names and their words of three letters or more."""
    return [*dict.fromkeys([*known, *(p for k in known for p in k.split() if len(p) >= 3)])]


def _public(name: Column, lex: Lexicons) -> Column:
    if not lex.public:
        return F.lit(False)
    bare = F.when(_prefixed(name, lex), _rest(name)).otherwise(name)
    return _like(name, lex.public) | _like(bare, lex.public)


@dataclass(slots=True)
class _Word:
    """What a document knows of a word: its form without a prefix letter that the document shows to be one, whether that may be
    a name or occurs with the definite letter, whether a letter went, whether the word itself may be a name, and whether
    its prefix letter is evidence. flags tell of the lists that hold the word."""

    w: str
    base: str
    base_ok: bool
    base_defined: bool
    bare: bool
    ok: bool
    letter: bool
    flags: int


#: Flags of a word, and of what may make a neighbour a name: lists on either side.
_SPEECH, _ATTRIBUTION, _ROLE, _ROLE2, _OF, _PERSON, _WITH, _CARE, _RELATIVE, _NEAR = (1 << i for i in range(10))
_BEHIND, _AHEAD = _ATTRIBUTION | _ROLE | _ROLE2 | _OF | _PERSON | _WITH | _CARE | _NEAR, _SPEECH | _RELATIVE | _NEAR
#: Most entries of a table of what was told before; a letter of every class of words.
_TOLD, _LETTER = 1 << 17, "א"


class _Told(dict):
    """A table of what a function told, emptied when it is full."""

    def __init__(self, tell: Callable):
        self.tell = tell

    def __missing__(self, x):
        if len(self) >= _TOLD:
            self.clear()
        self[x] = got = self.tell(x)
        return got


class _Ladder:
    """The ladder over the words of one document at a time. Patterns keep to what Java and Python read alike."""

    def __init__(self, lex: Lexicons, known: list[str], least: int):
        self.lex, self.least = lex, least
        self.full, self.parts = frozenset(known), frozenset(_known_words(known))
        sets = {k: frozenset(v) for k, v in vars(lex).items() if isinstance(v, list)}
        self.sets, self.letters = sets, frozenset(lex.prefixes)
        self.rx = {k: re.compile(v) for k in ("from_the", "negation", "first_person", "plural", "infinitive", "surname", "title", "public") if (v := getattr(lex, k))}
        self.verbs, self.bound = sets["stop"] | sets["speech"] | sets["attribution"], sets["persons"] | sets["kin"] | sets["care"] | sets["relative"]
        self.tails, self.no_first = sets["stop"] | sets["common"] | sets["speech"] | sets["trail"], sets["roles"] | sets["speech"] | self.parts | sets["placeholders"]
        self.quotes, self.joined = re.compile("['\"׳״]"), re.compile(f"^{lex.joined}") if lex.joined else None
        lists = [(_SPEECH, sets["speech"]), (_ATTRIBUTION, sets["attribution"]), (_ROLE, sets["roles"]), (_ROLE2, {x.rpartition(" ")[2] for x in sets["roles2"]}), (_OF, {lex.of}), (_PERSON, sets["persons"]), (_WITH, {lex.with_}), (_CARE, sets["care"]), (_RELATIVE, sets["relative"])]
        self.flags = _Told(lambda w: sum(f for f, words in lists if w in words) | _NEAR * self.near(w))
        apart, breaks, plain, ends = (re.compile(x) for x in (r"[,.;:()\[\]\n]", r"[.!?;:,()\n]", r"[,.;:\n]", r"[.!?;:\n]"))
        self.clean, self.breaks, self.plain, self.ends = _Told(lambda g: not apart.search(g)), _Told(lambda g: bool(breaks.search(g))), _Told(lambda g: not plain.search(g)), _Told(lambda g: bool(ends.search(g)))
        self.public, self.unfit, self.unfit_tail = _Told(self._public), _Told(self._unfit), _Told(self._unfit_tail)
        self.alone = _Told(self._alone)

    def like(self, x: str, rx: str) -> bool:
        return rx in self.rx and self.rx[rx].search(x) is not None

    def prefixed(self, x: str) -> bool:
        return x[:1] in self.letters

    def peel(self, x: str) -> str:
        return x[1:] if self.prefixed(x) else x

    def _public(self, name: str) -> bool:
        return "public" in self.rx and (self.like(name, "public") or self.like(self.peel(name), "public"))

    def facts(self, words: set[str]) -> dict[str, _Word]:
        """The facts of a document's distinct words."""
        with_letter: dict[str, set[str]] = {}
        for w in words:
            if w[0] in self.letters and len(w) > 1:
                with_letter.setdefault(w[1:], set()).add(w[0])
        return {w: self.fact(w, words, with_letter) if w in with_letter or w[0] in self.letters else self.alone[w] for w in words}

    def _alone(self, w: str) -> _Word:
        """A word of which the rest of its document tells nothing."""
        ok = self.nameish(w, [False] * 4, [False] * 4)
        return _Word(w, w, ok, False, False, ok, False, self.flags[w])

    def fact(self, w: str, words: set[str], with_letter: dict[str, set[str]]) -> _Word:
        present, definite, lex = [False] * 4, [False] * 4, self.lex
        for k in range(4):
            form = w[k:]
            if not form or k and w[k - 1] not in self.letters:
                break
            present[k], definite[k] = form in words, lex.definite in with_letter.get(form, ())
        first = w[0] in self.letters
        bare = first and present[1]
        ok, stem_ok = self.nameish(w, present, definite), first and self.nameish(w[1:], present[1:], definite[1:])
        letter = stem_ok and len(w) >= 4 and w[1] != lex.definite and not definite[1] and (present[1] or bool(with_letter.get(w[1:], set()) - {w[0]}))
        return _Word(w, w[1:] if bare else w, stem_ok if bare else ok, definite[1] if bare else definite[0], bare, ok, letter, self.flags[w])

    def nameish(self, x: str, present: list[bool], definite: list[bool]) -> bool:
        """Whether a form may be a name; the lists tell of the form and of what is left of it without prefix letters."""
        s, n = self.sets, len(x)
        if not 3 <= n <= 14 or x in s["places"] or x in s["roles"] or definite[0]:
            return False
        for k in range(3):
            if k and not self.prefixed(x[k - 1 :]):
                break
            st = x[k:]
            ordinary = st not in s["namelike"]
            if len(st) >= 2 and ordinary and st in s["common"]:
                return False
            if len(st) >= 3 and (ordinary and st in self.verbs or st in self.bound or k and definite[k]):
                return False
        return not (self.lex.definite and x.startswith(self.lex.definite) and (n < 5 or present[1]))

    def verb_tail(self, w: str) -> bool:
        """Whether a word after a name is a verb or a common word that does not belong to it."""
        family = w in self.sets["firsts"] or self.like(w, "surname")
        return not family and (w in self.sets["speech"] or w in self.sets["common"] or self.like(w, "infinitive"))

    def _unfit(self, base: str) -> bool:
        return self.like(base, "negation") or len(base) >= 6 and self.like(base, "first_person") or base in self.sets["placeholders"]

    def _unfit_tail(self, w: str) -> bool:
        tail = self.joined.sub("", w) if self.joined else w
        return self.like(tail, "negation") or tail in self.tails or self.verb_tail(tail)

    def fits(self, name: str, row: list[_Word], gap: str, prv: str | None, prv2: str | None) -> bool:
        """Whether the words of row, with this gap before the second, may be a name."""
        s = self.sets
        if not all(t.base_ok and not self.unfit[t.base] for t in row):
            return False
        if len(row) == 2:
            one, two = row
            if self.breaks[gap] or two.bare or one.w in s["lead"] or self.unfit_tail[two.w]:
                return False
            if any(t.w in self.full or self.peel(t.w) in self.full or t.base not in s["firsts"] and self.like(t.base, "plural") for t in row):
                return False
        elif row[0].w not in s["firsts"] and self.like(row[0].w, "from_the"):
            return False
        if all(len(self.quotes.sub("", t.base)) <= 1 for t in row) or name in self.parts or self.like(name + " ", "title"):
            return False
        longer = name if prv is None else f"{prv} {name}"
        return not (self.public[name] or self.public[longer] or prv2 is not None and self.public[f"{prv2} {longer}"])

    def step(self, row: list[_Word], after: _Word | None, gap: str, nxt: _Word | None, prv: _Word | None, prv2: _Word | None, care: bool) -> int | None:
        """The first step of the ladder, counted from 0, that the context of row reaches; gap stands before ``after``."""
        if nxt is not None and nxt.flags & _SPEECH:
            return 0
        f = prv.flags if prv is not None else 0
        if f & _ATTRIBUTION:
            return 1
        if f & _ROLE:
            return 2
        if f & _ROLE2 and prv2 is not None and f"{prv2.w} {prv.w}" in self.sets["roles2"]:
            return 3
        if f & _OF and prv2 is not None and prv2.w in self.sets["kin"]:
            return 4
        if f & _PERSON:
            return 5
        if f & _WITH and len(row) == 2 and not any(t.base_defined for t in row):
            return 6
        if after is not None and after.flags & _RELATIVE and "," in gap and not any(t.base in self.sets["speech"] for t in row) and not (prv is not None and prv.w in self.sets["common"]):
            return 7
        if f & _OF and row[0].bare:
            return 8
        return 9 if care else None

    def near(self, x: str | None) -> int:
        """Whether a word beside a candidate is of a known name."""
        return int(x is not None and (x in self.parts or bool(self.lex.joined) and x.startswith(self.lex.joined) and x[len(self.lex.joined) :] in self.parts))

    def accepted(self, run: list[_Word], gaps: list[str], i: int) -> tuple[str, int, bool, str] | None:
        """(name, points, strong, why) at a word: the pair, or else the single word, that has points."""
        t, many = run[i], len(run)
        b1, b2 = run[i - 1] if i else None, run[i - 2] if i > 1 else None
        prv = b1 if b1 is not None and self.clean[gaps[i]] else None
        prv2 = b2 if prv is not None and b2 is not None and self.clean[gaps[i - 1]] else None
        care = b1 is not None and self.plain[gaps[i]] and bool(b1.flags & _CARE or b2 is not None and b2.flags & _CARE and self.plain[gaps[i - 1]])
        for n in (2, 1):
            j = i + n
            if j > many:
                continue
            row, after = run[i:j], run[j] if j < many else None
            gap = gaps[j] if after is not None else ""
            nxt = after if after is not None and self.clean[gap] else None
            step = self.step(row, after, gap, nxt, prv, prv2, care)
            points = (STEPS[step][0] if step is not None else 0) + 2 * t.letter + (prv is not None and prv.flags & _NEAR > 0) + (nxt is not None and nxt.flags & _NEAR > 0)
            if points > 0:
                name = t.base if n == 1 else f"{t.base} {row[1].base}"
                if self.fits(name, row, gaps[i + 1] if n == 2 else "", prv and prv.w, prv2 and prv2.w):
                    return name, points, step is not None, STEPS[step][1] if step is not None else "prefix without the definite letter" if t.letter else "beside a known name"
        return None

    def full_names(self, runs: list[tuple[int, list[str], list[_Word]]], asked: set[str]) -> dict[str, tuple[int, str]]:
        """(block, the word before) of the asked words that follow a likely name at their first place in a block."""
        out: dict[str, tuple[int, str]] = {}
        for block, gaps, run in runs:
            seen = set()
            for gap, p, t in zip(gaps[1:], run, run[1:]):
                if t.w not in asked or t.w in seen:
                    continue
                seen.add(t.w)
                no = not p.ok or t.bare or len(p.w) < 3 or self.ends[gap] or p.w in self.no_first or self.lex.definite and p.w.startswith(self.lex.definite)
                if not no:
                    out[t.w] = min(out.get(t.w, (block, p.w)), (block, p.w))
        return out

    def names(self, blocks: list[tuple[int, list[str], list[str]]]) -> list[tuple[str, int, int, str, int, int]]:
        """(name, n, points, why, block, s) of a document's blocks (block, gaps, words)."""
        facts = self.facts({w for _, _, ws in blocks for w in ws})
        runs = [(block, gaps, [facts[w] for w in ws]) for block, gaps, ws in sorted(blocks)]
        hits: dict[str, list[tuple]] = {}
        for block, gaps, run in runs:
            flags = [0, 0, *[t.flags for t in run], 0, 0]
            ends = None
            for i, t in enumerate(run):
                # few words have any points: they have a prefix letter, or a listed word one or two places off
                if t.base_ok and (t.letter or flags[i + 1] & _BEHIND or flags[i] & _CARE or (flags[i + 3] | flags[i + 4]) & _AHEAD) and (got := self.accepted(run, gaps, i)):
                    if ends is None:
                        ends = list(accumulate(map(add, map(len, gaps), [len(x.w) for x in run])))
                    hits.setdefault(got[0], []).append(((block, i, ends[i] - len(t.w)), *got[1:]))
        strong, found = {}, {}
        for name, rows in hits.items():
            points = sum(r[1] for r in rows) + (2 if len(rows) >= 3 else len(rows) - 1)
            if points < self.least or not any(r[2] for r in rows) or self.public[name]:
                continue
            strong[name] = points
        single = {name for name in strong if " " not in name}
        whole = self.full_names(runs, single) if single else {}
        for name, points in strong.items():
            rows = hits[name]
            firsts: dict[str, tuple] = {}
            for at, _, _, why in rows:
                firsts[why] = min(firsts.get(why, at), at)
            why = "; ".join([w for _, w in sorted((at, w) for w, at in firsts.items())][:2])
            if name in whole:
                name = f"{whole[name][1]} {name}"
            made = (-points, min(r[0] for r in rows), len(rows), why)
            found[name] = min(found.get(name, made), made)
        words = {x for name in found if " " in name for x in name.split(" ")}
        return [(name, n, -less, why, at[0], at[2]) for name, (less, at, n, why) in found.items() if name not in words]


def body_names(blocks: DataFrame, by: list[str], lex: Lexicons, known: list[str] | None = None, least: int = 3) -> DataFrame:
    """(by, name, n, points, why, block, s) of blocks(by, block, text): names with strong evidence and ``least`` points.

    Every accepted occurrence adds its points; two occurrences add one more, three or more add two. A single word that
    the document writes after another likely name becomes the full name, and single words of a full name go. why lists
    the first two reasons; block and s are the first occurrence. Null and empty blocks, and blocks without ``by``, give
    nothing. Blocks of a document are told apart by ``block``, whose order is the document's.

    A document's texts are shuffled once, to its row; its words stay there. Words are cut in the JVM.
    """
    kinds = {f.name: f for f in blocks.schema.fields}
    rx = tx.WORDS[lex.word_class]
    has = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*by, "text")))
    docs = blocks.where(has).groupBy(*by).agg(F.collect_list(F.struct(F.col("block"), tx.norm(F.col("text")).alias("text"))).alias("_blocks"))
    # no word holds a space, and no gap a letter of words: joined so, they reach Python as two strings a block
    cut = lambda b: F.struct(b["block"].alias("block"), F.array_join(F.split(b["text"], rx, -1), _LETTER).alias("gaps"), F.array_join(F.regexp_extract_all(b["text"], F.lit(rx), F.lit(0)), " ").alias("ws"))
    docs = docs.select(*by, F.transform("_blocks", cut).alias("_blocks"))
    made = StructType([*[kinds[c] for c in by], StructField("name", StringType()), StructField("n", LongType()), StructField("points", LongType()), StructField("why", StringType()), kinds["block"], StructField("s", LongType())])
    schema = to_arrow_schema(made)
    known = known or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ladder = _Ladder(lex, known, least)
        for b in batches:
            at, rows = [], []
            for i in range(b.num_rows):
                got = ladder.names([(x["block"], x["gaps"].split(_LETTER), x["ws"].split(" ") if x["ws"] else []) for x in b.column(len(by))[i].as_py()])
                at += [i] * len(got)
                rows += got
            own = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[own.column(k).cast(schema.field(k).type) for k in range(len(by))], *[pa.array([r[k] for r in rows], schema.field(len(by) + k).type) for k in range(6)]], schema=schema)

    ship.prepare(blocks.sparkSession)
    return docs.mapInArrow(work, made)


# --- predictions of a model, cleaned ----------------------------------------------------------------------------------

#: Kinds of a model's types, pairs of prefix letters that are written together, ends of relative participles.
KINDS = {"PER": "NAME", "ORG": "ORG", "GPE": "PLACE", "LOC": "PLACE", "FAC": "PLACE"}
PAIRS = "^(?:ו[בהלמכ]|כש|מה|לכ)"
PARTICIPLE = "(?:ת|ות|ים)$"


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


def _strip_ends(c: Column, bad_first: Callable[[Column], Column] | None, bad_last: Callable[[Column], Column] | None) -> Column:
    """A value without words at its ends that a test rejects; one word stays."""

    def drop(ws: Column, test: Callable[[Column], Column]) -> Column:
        keep = F.transform(ws, lambda w, i: F.when(~F.coalesce(test(w), F.lit(False)) | (i == F.size(ws) - 1), i))
        return F.slice(ws, F.array_min(keep) + 1, F.size(ws))

    ws = _words(c)
    if bad_last:
        ws = F.reverse(drop(F.reverse(ws), bad_last))
    return F.array_join(drop(ws, bad_first) if bad_first else ws, " ")


def _put(x: DataFrame, value: Column, name: str = "v") -> DataFrame:
    """x with a column replaced, through a generator: later tests are not copied into what the value is made of."""
    return x.select(*[c for c in x.columns if c != name], F.inline_outer(F.array(F.struct(value.alias(name)))))


def clean_predictions(ents: DataFrame, texts: DataFrame, lex: Lexicons, role: str = "", org_head: str = "", group_head: str = "", least: float = 0.6, by: str = "doc_id") -> DataFrame:
    """(by, value, kind, n, score, review, cut) of ents(by, s, e, type, score) over texts(by, text).

    A span grows to whole words; a prefix letter, or a pair of them, goes where the growth, the document or a lexicon says
    that it is one; of several sentences the last stays; titles, leading words, roles and verbs at the ends go; words
    that are no names, placeholders, values without a letter of the language, groups and public bodies are dropped; a
    person of more than four words or with a dash is a body; a body without a head is for review. Equal values are
    counted, and a value inside a longer one of its kind goes. Null texts and spans outside the text give nothing.
    """
    letter = "[\u0591-\u05bd\u05bf-\u05c7\u05d0-\u05ea]" if lex.word_class == "he" else r"[\p{L}\p{M}]"
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("type"))
    x = ents.where((F.col("score") >= least) & (F.col("s") < F.col("e"))).withColumn("kind", kind).where("kind is not null").join(texts.select(by, "text"), by)
    left, right = F.regexp_extract(F.substring("text", F.lit(1), F.col("s")), f"({letter}*)$", 1), F.regexp_extract(_rest_at(F.col("text"), F.col("e")), f"^({letter}*)", 1)
    x = x.select(by, "kind", "score", F.concat(left, F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")), right).alias("v"), (right != "").alias("cut"), F.array_join(F.slice(F.concat(F.array(F.lit("")), F.array(F.lit("")), F.filter(_words(F.substring("text", F.lit(1), F.col("s") - F.length(left))), lambda w: w != "")), -2, 2), " ").alias("back"))
    x = _put(x, tx.trim_edges(F.col("v"))).withColumn("whole", F.col("v")).withColumn("f", F.get(_words(F.col("v")), 0)).where(F.length("v") >= 2)
    docs = texts.join(x.select(by).distinct(), by, "left_semi").select(by, F.explode(F.array_distinct(F.regexp_extract_all(tx.norm(F.col("text")), F.lit(tx.WORDS[lex.word_class]), F.lit(0)))).alias("w"))
    facts = form_facts(docs.select(by, "w").distinct(), [by], lex)
    for k in (1, 2):
        x = x.withColumn("form", _rest(F.col("f"), k)).join(facts.select(by, "form", F.col("present").alias(f"p{k}"), F.col("prefixes").alias(f"q{k}")), [by, "form"], "left").drop("form")
    head = lambda c: _like(c, org_head) | _like(c, group_head)
    stem, stem2 = _rest(F.col("v"), 1), _rest(F.col("v"), 2)
    known = lambda v, f: _has(v, lex.places) | _has(f, lex.firsts) | head(v)
    seen = F.coalesce(F.col("p1"), F.lit(False)) | F.coalesce(F.size(F.array_except("q1", F.array(F.substring("f", 1, 1)))) > 0, F.lit(False))
    one = _prefixed(F.col("f"), lex) & (F.length("f") >= 4) & (F.col("cut") | seen | known(stem, _rest(F.col("f"), 1)))
    two = _prefixed(F.col("f"), lex) & (F.length("f") >= 5) & _like(F.col("f"), PAIRS) & (F.coalesce(F.col("p2"), F.lit(False)) | known(stem2, _rest(F.col("f"), 2)))
    x = _put(x, F.when(one, stem).when(two, stem2).otherwise(F.col("v"))).drop("p1", "q1", "p2", "q2", "f")
    x = _put(x, tx.trim_edges(F.regexp_extract(F.regexp_replace("v", r"[.!?:;\n\s]+$", ""), r"([^.!?:;\n]*)$", 1)))
    if lex.title:
        x = _put(x, tx.trim_edges(F.regexp_replace("v", lex.title, "")))
    x = _put(x, _strip_ends(F.col("v"), lambda w: _has(w, lex.lead), None))
    single = ~F.contains("v", F.lit(" "))
    first = F.get(_words(F.col("v")), 0)
    rest = _rest(first)
    bad = (single & _has(F.col("v"), lex.stop + lex.common + lex.speech)) | (_prefixed(first, lex) & (F.length(first) >= 4) & _has(rest, lex.speech + lex.common))
    if lex.word_class == "he":
        bad = bad | (first.startswith("ש") & (F.length(first) >= 5) & _like(rest, PARTICIPLE) & ~_has(rest, lex.firsts))
    x = x.where(~bad)
    if role:
        is_role = lambda w: _like(w, role)
        x = _put(x.where(~F.forall(_words(F.col("v")), is_role)), _strip_ends(F.col("v"), is_role, is_role))
    x = _put(x, _strip_ends(F.col("v"), None, lambda w: verb_tail(w, lex)))
    x = x.where((F.length("v") >= 2) & ~_has(F.col("v"), lex.placeholders) & F.col("v").rlike(letter))
    x = x.where(~(F.contains("v", F.lit(" ")) & F.forall(_words(F.col("v")), lambda w: F.length(F.regexp_replace(w, "['\"\u05f3\u05f4]", "")) <= 1)))
    x = x.withColumn("kind", F.when((F.col("kind") == "NAME") & (_like(F.col("v"), r"\s[-\u2013]\s") | (F.size(_words(F.col("v"))) > 4)), "ORG").otherwise(F.col("kind")))
    x = _put(x, F.col("kind"), "kind")
    org = F.col("kind") == "ORG"
    x = x.where(~(org & _like(F.col("v"), group_head))).withColumn("review", org & ~_like(F.col("v"), org_head) if org_head else F.lit(False))
    other = F.col("kind") != "NAME"
    near = [F.concat_ws(" ", F.element_at(_words(F.col("back")), -1), "v"), F.concat_ws(" ", F.trim("back"), "v"), F.col("v"), F.col("whole")]
    x = x.where(~(other & _any(*[_public(F.trim(c), lex) for c in near])))
    x = _put(x, F.when(other, _strip_ends(F.col("v"), None, lambda w: _has(w, lex.trail + lex.speech))).otherwise(F.col("v")))
    g = x.groupBy(by, F.col("v").alias("value"), "kind").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.bool_or("review").alias("review"), F.bool_or("cut").alias("cut"))
    words = g.where(F.contains("value", F.lit(" "))).select(F.col(by).alias("_by"), F.col("kind").alias("_kind"), F.col("value").alias("_long"), F.explode(F.array_distinct(_words(F.col("value")))).alias("_word"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = (g[by] == words["_by"]) & (g["kind"] == words["_kind"]) & (F.get(_words(g["value"]), 0) == words["_word"]) & (g["value"] != words["_long"]) & F.contains(pad(words["_long"]), pad(g["value"]))
    return g.join(words, inside, "left_anti")


def _rest_at(c: Column, at: Column) -> Column:
    return F.substring(c, at + 1, F.length(c))

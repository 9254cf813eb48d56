"""Personal data: weak supervision over labelers, reliabilities by expectation-maximisation, and a final span classifier.

Candidates are the base patterns' matches (email, ip, card, phone; these always stay) and looser patterns (spelt-out
addresses, local phone numbers, social security numbers, bank accounts, titled names). Labelers vote 1, -1 or abstain on each:
formats (regex), gazetteers (domains, dialling codes, card issuers, first names, reserved networks), and context (words before,
borders, variety of digits). Expectation-maximisation (Dawid and Skene 1979) estimates each labeler's reliability and the
candidates' chances from counts by vote pattern; a logistic regression on kind, votes, length and share of digits, trained on
those chances, decides on the looser candidates. Both fits see only counts by pattern, whose number is fixed, taken over
all documents.

Patterns match leftmost and without overlap per kind. They run in Java's engine with possessive repeats, which find the
same matches in linear time and without recursion. Positions are code points, ends exclusive, derived from the lengths of what
lies between matches. Lists are built in blocks of BLOCK, overlaps are found by bisection, and texts are cut from chunks of CHUNK
code points, so that work stays near linear in a text's length and matches, however many one text has.

Accepted looser spans say so (base is false): they have kinds of their own or those of the base patterns, and counts and digests
of the base patterns leave them out.

DataFrame functions only. Defined cases: null and empty texts have no spans; a looser candidate that overlaps a base span
or an earlier looser one goes; without any candidates the classifier accepts none; repeated rows are treated alike; other
columns play no part.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
ACCEPT = 0.5
#: Items of a list that are put together at a time, and code points of a chunk that spans are cut from.
BLOCK = 64
CHUNK = 1024

# Fixed patterns: the contract's, with possessive repeats. (?<!x)|\G stands where only a run's start, or the end of the last match, can begin one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of at most 255, zeros in front allowed.
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
#: What a text must contain to have a match at all.
_NEEDS = {"email": "@", "phone": "+", "spelt": "dot"}
LOOSE = {
    "spelt": r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{0,40}+ ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,40}+ ?(?:\(dot\)|\[dot\]) ?[a-z]{2,10}",
    "local": r"(?<![0-9.+-])(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,20}(?: \p{Lu}\p{Ll}{1,20})?",
}
_AS = {"spelt": "email", "local": "phone", "ssn": "ssn", "iban": "iban", "name": "name"}

# The gazetteers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu"
DIALLING = "1|33|34|39|44|49"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
RESERVED = r"0\.|10\.|127\.|192\.168\.|169\.254\.|255\."
FIRST_NAMES = "Anna|Carlos|David|Elena|Emma|Hans|James|Jean|John|José|Julia|Karl|Laura|Lucía|Luis|Maria|María|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sophie|Thomas"
CUES = r"(?iu)(mail|contact|kontakt|phone|telefon|téléphone|teléfono|tel\b|call|fax|mobile|host|address|adresse|card|visa|karte|carte|tarjeta|iban|konto|ssn|dear|liebe|cher|from)"
COUNTER_CUES = r"(?iu)(order|invoice|isbn|version|article|page|serial|ref|id|no|nr)[.:#= ]{0,3}$"
VOTES = ("format", "gazetteer", "cue", "counter", "border", "digits")


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _scan(items: Column, zero: Column, step, out: str) -> Column:
    """What step gives for each item in turn: step(state, item) is a struct of the next state and an item of the result.

    out is the type of the result's items. Results gather in blocks of BLOCK, and then blocks: appending to one list would copy it each time.
    """
    none = F.expr(f"cast(array() as array<{out}>)")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def block(done: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(done["state"].alias("state"), none.alias("out")), lambda d, x: _let(step(d["state"], x), lambda y: F.struct(y["state"].alias("state"), F.concat(d["out"], F.array(y["out"])).alias("out"))))
        return _let(inner, lambda y: F.struct(y["state"].alias("state"), F.concat(done["out"], F.array(y["out"])).alias("out")))

    start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{out}>>)").alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(none)


_MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def _found(text: Column, pattern: str, need: str | None = None) -> Column:
    """The matches of a pattern: start, end, value, and up to 24 code points before and after."""
    none = F.expr(f"cast(array() as array<{_MATCH}>)")

    def place(x: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            start = at + F.length(x["parts"][i])
            end = start + F.length(x["found"][i])
            one = F.struct(start.alias("start"), end.alias("end"), x["found"][i].alias("value"), F.right(x["parts"][i], F.lit(24)).alias("before"), F.left(x["parts"][i + 1], F.lit(24)).alias("after"))
            return F.struct(end.alias("state"), one.alias("out"))

        return F.when(F.size(x["found"]) == 0, none).otherwise(_scan(F.sequence(F.lit(0), F.size(x["found"]) - 1), F.lit(0), step, _MATCH))

    # The two lists are bound by the outer transform, so that each is made once.
    placed = _let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), place)
    return F.when(F.contains(text, F.lit(need)), placed).otherwise(none) if need else placed


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _valid(kind: str, x: Column) -> Column:
    """Whether a base match meets its condition."""
    if kind == "ip":
        return x["value"].rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    n = F.length(_digits(x["value"]))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(x["value"]))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def _candidate(x: Column, kind: str, base: bool) -> Column:
    """A match with its kind, its votes and the classifier's other features."""
    v, digits = x["value"], _digits(x["value"])
    never = F.lit(False)
    formats = {
        "email": lambda: _vote(v.rlike(r"\.[A-Za-z]{2,10}$") | v.contains("("), ~v.rlike(r"[A-Za-z]{2}$")),
        "ip": lambda: _vote(~v.rlike(r"(^|\.)0[0-9]"), v.rlike(r"(^|\.)0[0-9]")),
        "card": lambda: _vote(F.length(digits).between(14, 19) & _luhn(digits), ~_luhn(digits)),
        "phone": lambda: _vote(F.length(digits).between(10, 15), ~F.length(digits).between(10, 15)),
        "ssn": lambda: _vote(~v.rlike(r"^(000|666|9)|-00-|-0000$"), v.rlike(r"^(000|666|9)|-00-|-0000$")),
        "iban": lambda: _vote(F.length(F.replace(v, F.lit(" "))).between(15, 34)),
        "name": lambda: _vote(v.rlike(r" \p{Lu}\p{Ll}+$")),
    }
    gazetteers = {
        "email": lambda: _vote(v.rlike(rf"(?i)[.\])] ?({DOMAINS})$")),
        "ip": lambda: _vote(never, v.rlike(rf"^({RESERVED})")),
        "card": lambda: _vote(digits.rlike(rf"^({ISSUERS})"), ~digits.rlike(rf"^({ISSUERS})")),
        "phone": lambda: _vote(v.rlike(rf"^\+({DIALLING})\b")),
        "ssn": lambda: _vote(never),
        "iban": lambda: _vote(v.rlike("^(DE|FR|ES|GB|IT|NL|BE|AT|CH)")),
        "name": lambda: _vote(v.rlike(rf" ({FIRST_NAMES})\b"), ~v.rlike(rf" ({FIRST_NAMES})\b")),
    }
    glued = x["before"].rlike(r"[\p{L}0-9]$") | x["after"].rlike(r"^[\p{L}0-9]")
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    return F.struct(
        F.lit(kind).alias("kind"),
        x["start"].cast("long").alias("start"),
        x["end"].cast("long").alias("end"),
        F.lit(base).alias("base"),
        formats[kind]().alias("format"),
        gazetteers[kind]().alias("gazetteer"),
        _vote(x["before"].rlike(CUES)).alias("cue"),
        _vote(never, x["before"].rlike(COUNTER_CUES)).alias("counter"),
        _vote(~glued, glued).alias("border"),
        (_vote(kinds >= 4, kinds < 4) if kind in ("ip", "card", "phone", "ssn", "iban") else F.lit(0)).alias("digits"),
        F.least(F.floor(F.log2(F.length(v).cast("double"))), F.lit(7)).cast("int").alias("length"),
        F.floor(4.0 * F.length(digits) / F.length(v)).cast("int").alias("share"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text, with votes and features; ordered by start, and then kind as in KINDS."""
    text = F.coalesce(text, F.lit(""))
    base = F.struct(*(F.transform(F.filter(_found(text, pattern, _NEEDS.get(kind)), _condition(kind)), _as(kind, True)).alias(kind) for kind, pattern in PATTERNS.items()))
    loose = F.concat(*(F.transform(_found(text, pattern, _NEEDS.get(name)), _as(_AS[name], False)) for name, pattern in LOOSE.items()))

    def meets(spans: Column, y: Column) -> Column:
        """Whether y overlaps one of some spans that lie in order and apart: the first that ends after y's start decides, found by bisection."""
        first = F.aggregate(F.expr(_STEPS), F.lit(0), lambda at, n: F.when(F.coalesce(F.get(spans, at + n - 1)["end"] <= y["start"], F.lit(False)), at + n).otherwise(at))
        return F.coalesce(F.get(spans, first)["start"] < y["end"], F.lit(False))

    def apart(end: Column, y: Column) -> Column:
        """Drops a span that begins before the last one that stays has ended."""
        return F.when(y["start"] < end, F.struct(end.alias("state"), F.lit(None).cast(_CANDIDATE).alias("out"))).otherwise(F.struct(y["end"].alias("state"), y.alias("out")))

    def both(x: Column) -> Column:
        """The base spans, and each loose one that meets none of them nor an earlier loose one that stays."""
        free = F.filter(F.array_sort(x["loose"], _by_start), lambda y: ~functools.reduce(Column.__or__, (meets(x["base"][kind], y) for kind in BASE)))
        kept = F.filter(_let(free, lambda y: _scan(y, F.lit(0).cast("long"), apart, _CANDIDATE)), lambda y: y.isNotNull())
        return F.concat(*(x["base"][kind] for kind in BASE), F.when(F.size(x["loose"]) > 0, kept).otherwise(x["loose"]))

    return F.array_sort(_let(F.struct(base.alias("base"), loose.alias("loose")), both), _by_start)


#: A candidate's type, and steps of bisection, which reach any list that one text can have.
_CANDIDATE = "struct<kind:string,start:bigint,end:bigint,base:boolean,format:int,gazetteer:int,cue:int,counter:int,border:int,digits:int,length:int,share:int>"
_STEPS = f"array({', '.join(str(1 << k) for k in range(29, -1, -1))})"


def _condition(kind: str):
    return lambda x: _valid(kind, x)


def _as(kind: str, base: bool):
    return lambda x: _candidate(x, kind, base)


def _rank(x: Column) -> Column:
    return F.array_position(F.lit(list(KINDS)), x["kind"])


def _by_start(x: Column, y: Column) -> Column:
    return F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise((_rank(x) - _rank(y)).cast("int"))


@dataclass
class Model:
    """The classifier's weights, and what expectation-maximisation found: reliability[vote][truth][1 + vote's value] and priors by kind."""

    bias: float = -10.0
    weights: dict[tuple[str, int | str], float] = field(default_factory=dict)
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)

    def chance(self, x: Column) -> Column:
        """The chance that a candidate is personal data, as an expression."""
        total = F.lit(self.bias)
        for name in ("kind", *VOTES, "length", "share"):
            own = {value: w for (n, value), w in self.weights.items() if n == name}
            pick = F.lit(0.0)
            for value, w in own.items():
                pick = F.when(x[name] == value, w).otherwise(pick)
            total = total + pick
        return 1 / (1 + F.exp(-total))


def learn(found: DataFrame, *, column: str = "candidates", rounds: int = 50) -> Model:
    """Fits reliabilities and the classifier to all candidates in a column, from their counts by pattern.

    A pattern is a kind, six votes, eight lengths and five shares: their number doesn't depend on the documents'.
    """
    names = ("kind", *VOTES, "length", "share")
    counts = found.select(F.explode(column).alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model()
    n = np.array([r["n"] for r in counts], float)
    kinds = np.array([KINDS.index(r["kind"]) for r in counts])
    votes = np.array([[r[v] + 1 for v in VOTES] for r in counts])
    chance = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))  # majority vote to begin with
    for _ in range(rounds):
        weight = np.stack([n * (1 - chance), n * chance])
        prior = np.array([(np.bincount(kinds, w, len(KINDS)) + 1) for w in weight])
        prior = np.log(prior / prior.sum(axis=0))
        tables = np.array([[np.bincount(votes[:, k], w, 3) + 1 for w in weight] for k in range(len(VOTES))])
        tables = tables / tables.sum(axis=2, keepdims=True)
        score = prior[:, kinds] + sum(np.log(tables[k][:, votes[:, k]]) for k in range(len(VOTES)))
        chance = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    if (n * chance).sum() < 1e-9:
        return Model()
    columns: dict[tuple[str, int | str], int] = {}
    cells = [[columns.setdefault((name, r[name]), len(columns)) for name in names] for r in counts]
    x = np.zeros((len(counts), len(columns) + 1))
    x[:, -1] = 1
    for row, own in zip(x, cells, strict=True):
        row[own] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    for _ in range(30):  # Newton's method with a Gaussian prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (p - chance)) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    assert all(map(math.isfinite, w))
    return Model(
        float(w[-1]),
        {k: float(w[i]) for k, i in columns.items()},
        {v: tables[k].tolist() for k, v in enumerate(VOTES)},
        dict(zip(KINDS, np.exp(prior[1]).tolist(), strict=True)),
    )


def accepted(found: Column, model: Model, accept: float = ACCEPT) -> Column:
    """The base spans and those the classifier accepts: kind, start, end, and whether a base pattern gave it."""
    kept = F.filter(found, lambda x: x["base"] | (model.chance(x) >= accept))
    return F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"]))


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key and spans (kind, start, end, base), by start and then kind. The model is fitted to these documents."""
    found = materialize(docs.select(F.col(key), candidates(F.col(text)).alias("candidates")), "candidates")
    return found.select(key, accepted(F.col("candidates"), learn(found)).alias("spans"))


def _rewritten(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first one's kind stands for all."""

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        """The code points from start to end, out of the chunks that hold them."""
        part = lambda c: F.substring(F.get(chunks, c), (F.greatest(start, c * CHUNK) - c * CHUNK + 1).cast("int"), (F.least(end, (c + 1) * CHUNK) - F.greatest(start, c * CHUNK)).cast("int"))
        every = F.transform(F.sequence(F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")), part)
        return F.when(end > start, F.array_join(every, "")).otherwise("")

    def rewrite(x: Column) -> Column:
        def step(at: Column, y: Column) -> Column:
            fresh = F.concat(cut(x["chunks"], at, y["start"]), F.lit("<"), F.upper(y["kind"]), F.lit(">"))
            return F.struct(F.greatest(at, y["end"]).alias("state"), F.when(y["start"] < at, "").otherwise(fresh).alias("out"))

        last = F.array_max(F.transform(x["spans"], lambda y: y["end"]))
        return F.concat(F.array_join(_scan(x["spans"], F.lit(0).cast("long"), step, "string"), ""), cut(x["chunks"], last, x["n"]))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0)).alias("chunks"), F.length(text).cast("long").alias("n"), found.alias("spans")), rewrite)


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; all other rows and columns stay as they are.

    Candidates are found once and written beside the rows; columns go by position, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = F.col(names[docs.columns.index(text)])
    found = materialize(docs.toDF(*names).withColumn("_candidates", candidates(own)), "candidates")
    rows = found.withColumn("_spans", accepted(F.col("_candidates"), learn(found, column="_candidates")))
    cleaned = F.when(F.size("_spans") > 0, _rewritten(own, F.col("_spans"))).otherwise(own)
    return rows.select(*(cleaned.alias(n) if n == names[docs.columns.index(text)] else F.col(n) for n in names)).toDF(*docs.columns)

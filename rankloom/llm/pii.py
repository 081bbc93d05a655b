"""Personal data by weak supervision, in DataFrame functions only.

Candidates are what the base patterns match (kept, failed or not) and what wider ones match: e-mail addresses with a
written-out at and dot, card numbers beside other digits, telephone numbers without a plus. Four labelers vote on each candidate (yes, no, silent):
the base rule, the shape, a gazetteer (name endings, calling codes, card issuers, address ranges) and the words
before it. Votes are counted by pattern of votes, a table that the number of labelers bounds; expectation-maximisation
over it estimates how reliable each labeler is and how likely each pattern is personal data, and a logistic model
trained on these estimates classifies all candidates. A base span that passes its rule always stays; the model adds
others where it is sure and no base span overlaps.

Defined results: a null text counts as empty and has no span; offsets are code points, the end exclusive; rows are
answered one by one, so repeated rows, null keys and extra columns do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import fresh

KINDS = ["email", "ip", "card", "phone"]
#: Least probability of an added span.
SURE = 0.9

# The base patterns, written so that a failing start is not tried again inside the same run of characters; the third
# to match one text in a long run of digits without recursion. They match what the plain ones match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider ones.
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+)++"
LOCAL = r"(?<![0-9A-Za-z+.,(/=-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,3}(?![0-9A-Za-z])"

ALONE = r"(?<![0-9])(?:[0-9]{14,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{2,7})(?![0-9])"

# Gazetteers.
NAME_ENDINGS = "com org net edu gov mil int info biz io dev app co eu uk de fr es it nl be ch at pt pl cz se no dk fi ie us ca au nz jp cn in br mx ar cl ru ua tr za kr sg hk".split()
CALLING_CODES = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6[0245])"
CONTEXT = {
    "email": ("mail|contact|write|reach|adresse|correo|courriel", "version|user-agent"),
    "ip": ("ip|host|server|login|address|client|from", "version|section|chapter|release"),
    "card": ("card|visa|master|amex|credit|karte|carte|tarjeta|pay", "isbn|order|invoice|tracking|serial"),
    "phone": ("phone|tel|call|fax|mobile|cell|dial|whatsapp|telefon|m[oó]vil", "isbn|order|invoice|version|serial|pages"),
}

_EMPTY = "cast(array() as array<struct<start:int,stop:int,found:string>>)"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>>: leftmost matches that do not overlap. The gaps between them give the places."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.expr(_EMPTY).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        own = F.array(F.struct(begin.alias("start"), end.alias("stop"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(x["found"].isNull(), state["out"]).otherwise(F.concat(state["out"], own)).alias("out"))

    return F.aggregate(zipped, start, step, lambda state: state["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a short string of digits passes; every second one from the right counts twice."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _shape(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "email":
        ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        return _vote(ending.rlike("^[a-z]{2,24}$") & (F.length(found) <= 254), ending.rlike("[0-9]"))
    if kind == "ip":
        passes = _passes(kind, found) & ~found.rlike(r"(?:^|\.)0[0-9]")
        return _vote(passes, ~passes)
    if kind == "card":
        passes = F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
        return _vote(passes, ~passes)
    return _vote(F.length(digits).between(10, 13) & found.rlike(r"[\x20().-]"), ~F.length(digits).between(10, 15))


def _known(kind: str, found: Column) -> Column:
    if kind == "email":
        ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        return _vote(ending.isin(NAME_ENDINGS), F.length(ending) == 1)
    if kind == "ip":
        first = F.regexp_extract(found, "^0*([0-9]*)", 1)
        return _vote(first.rlike("^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])$"), ~first.rlike("^[0-9]{1,3}$"))
    if kind == "card":
        return _vote(_digits(found).rlike(ISSUERS), ~_digits(found).rlike(ISSUERS))
    return _vote(found.startswith("+") & found.rlike(CALLING_CODES), found.startswith("+") & ~found.rlike(CALLING_CODES))


def _votes(text: Column, kind: str, base: bool) -> Callable[[Column], Column]:
    good, bad = CONTEXT[kind]

    def vote(x: Column) -> Column:
        found = x["found"]
        passes = F.coalesce(_passes(kind, found), F.lit(False)) if base else F.lit(False)
        before = F.lower(F.substring(text, F.greatest(x["start"] - 29, F.lit(1)), F.least(x["start"], F.lit(30))))
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["stop"].alias("stop"),
            passes.alias("base"),
            (F.when(passes, 1).otherwise(-1) if base else F.lit(0)).alias("rule"),
            _shape(kind, found).alias("shape"),
            _known(kind, found).alias("known"),
            _vote(before.rlike(rf"\b(?:{good})"), before.rlike(rf"\b(?:{bad})")).alias("context"),
        )

    return vote


def candidates(text: Column) -> Column:
    """array<struct<start, kind, stop, base, rule, shape, known, context>> of a text that is not null."""
    lists = []
    for kind, pattern, hint, base in (
        ("email", EMAIL, F.contains(text, F.lit("@")), True),
        ("email", SPELLED, text.rlike(r"(?i)[\[(]at[\])]"), False),
        ("ip", IP, text.rlike(IP), True),
        ("card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){8}"), True),
        ("card", ALONE, text.rlike(ALONE), False),
        ("phone", PHONE, F.contains(text, F.lit("+")), True),
        ("phone", LOCAL, text.rlike(LOCAL), False),
    ):
        some = _matches(text, pattern)
        if kind == "card" and base:  # shorter runs of digits are no candidates
            some = F.filter(some, lambda x: F.length(x["found"]) >= 13)
        lists.append(F.when(hint, F.transform(some, _votes(text, kind, base))))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,base:boolean,rule:int,shape:int,known:int,context:int>>)")
    return F.concat(*[F.coalesce(x, empty) for x in lists])


LABELERS = ["rule", "shape", "known", "context"]
_VOTES = (-1, 0, 1)


def estimate(patterns: dict[tuple, float], rounds: int = 50) -> dict[tuple, float]:
    """Probability of personal data for each pattern (kind, vote, …), by expectation-maximisation over their counts.

    Every kind has its own share of personal data; a labeler's reliability is shared by all kinds. It has a prior,
    half as strong as the counts, that a labeler says what is true; without one, the classes could change places.
    """
    prior = {1: 0.85, 0: 0.1, -1: 0.05}
    half = sum(patterns.values()) / 2 + 1
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p in patterns}
    for _ in range(rounds):
        share, rate = {}, {}
        for kind in {p[0] for p in patterns}:
            total = sum(n for p, n in patterns.items() if p[0] == kind)
            share[kind] = (1 + sum(n * belief[p] for p, n in patterns.items() if p[0] == kind)) / (2 + total)
        for k in range(len(LABELERS)):
            for truth in (0, 1):
                weight = {v: half * prior[v if truth else -v] for v in _VOTES}
                for p, n in patterns.items():
                    weight[p[1 + k]] += n * (belief[p] if truth else 1 - belief[p])
                rate[k, truth] = {v: w / sum(weight.values()) for v, w in weight.items()}
        for p in patterns:
            odds = math.log(share[p[0]] / (1 - share[p[0]]))
            odds += sum(math.log(rate[k, 1][v] / rate[k, 0][v]) for k, v in enumerate(p[1:]))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def _features(p: tuple) -> list[str]:
    return ["any", f"kind={p[0]}", *(f"{name}={v}" for name, v in zip(LABELERS, p[1:], strict=True))]


def train(patterns: dict[tuple, float], belief: dict[tuple, float], steps: int = 400) -> dict[str, float]:
    """Weights of a logistic model of the beliefs; each pattern counts by the square root of its number."""
    weights = {f: 0.0 for p in patterns for f in _features(p)}
    size = sum(math.sqrt(n) for n in patterns.values()) or 1.0
    for _ in range(steps):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for p, n in patterns.items():
            z = sum(weights[f] for f in _features(p))
            error = (1 / (1 + math.exp(-z)) - belief[p]) * math.sqrt(n) / size
            for f in _features(p):
                slope[f] += error
        weights = {f: w - 1.5 * slope[f] for f, w in weights.items()}
    return weights


def fit(found: DataFrame, column: str) -> dict[str, float]:
    """Weights from a table with candidates: counts of all of them, by pattern (at most 4 x 81 rows), reach the driver."""
    each = found.select(F.explode(column).alias("c")).select("c.kind", *[f"c.{name}" for name in LABELERS])
    rows = each.groupBy("kind", *LABELERS).count().collect()
    patterns = {tuple(r)[:-1]: float(r["count"]) for r in rows}
    return train(patterns, estimate(patterns)) if patterns else {}


def _chosen(found: Column, weights: dict[str, float], sure: float) -> Column:
    """The base spans, and those wider candidates that the model is sure of and that touch no base span. What failed
    its base rule has taught the model, but is not added."""

    def likely(c: Column) -> Column:
        z = F.lit(weights.get("any", 0.0))
        for name in ["kind", *LABELERS]:
            known = {int(f.split("=")[1]): w for f, w in weights.items() if f.startswith(f"{name}=")}
            part = F.lit(0.0)
            for value, w in known.items():
                part = F.when(c[name] == value, F.lit(w)).otherwise(part)
            z = z + part
        return z >= math.log(sure / (1 - sure))

    base = F.filter(found, lambda c: c["base"])
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    extra = F.filter(found, lambda c: (c["rule"] == 0) & likely(c) & apart(c))
    return F.sort_array(F.transform(F.concat(base, extra), lambda c: c))


def find(docs: DataFrame, text: str = "text", sure: float = SURE, weights: dict[str, float] | None = None) -> tuple[DataFrame, str]:
    """The input with one more column, named in the answer: array<struct<start, kind, stop, base, …>> by start."""
    column, whole = fresh(docs, "spans"), F.coalesce(docs[text], F.lit(""))
    found = docs.withColumn(column, candidates(whole))
    if weights is None:
        weights = fit(found.select(column), column)
    return found.withColumn(column, _chosen(F.col(column), weights, sure)), column


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda kind: F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind, as in <EMAIL>; of overlapping spans the first counts.

    A null text stays null. Column `size`, if there is one, gets the new length where the text changed.
    """
    found, column = find(docs, text)

    def step(state: Column, s: Column) -> Column:
        tag = F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), s["kind"] + 1)
        kept = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["stop"].alias("at"), F.concat(state["out"], kept, tag).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, F.length(F.col(text))))
    clean = F.when(F.size(column) > 0, F.aggregate(F.col(column), start, step, rest)).otherwise(F.col(text))
    out = found.withColumn(text, clean)
    if size in docs.columns:
        changed = F.when(F.size(column) > 0, F.length(text)).otherwise(F.col(size))
        out = out.withColumn(size, changed.cast(docs.schema[size].dataType))
    return out.select(*docs.columns)

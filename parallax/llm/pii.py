"""Personal data by weak supervision, in SQL expressions alone.

Base spans follow fixed expressions and checks (email, ip, card, phone); they always stay. Beyond
them, looser expressions propose candidates (``contact``: telephone numbers without a country, ``ssn``,
``secret``: keys and tokens). Labelers vote on each candidate: its shape, a gazetteer of words before it, the
signs around it, its share of digits, its variety, what follows. Votes are counted by pattern over all documents;
expectation-maximisation on those counts estimates how reliable each labeler is; a logistic span classifier
is trained on the resulting probabilities and features of the candidates, again by pattern, and decides.

The patterns of votes are few (at most ``MAX_PATTERNS``, whatever the input), so they go to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import fresh

#: The base kinds. Possessive forms and what is looked up before a match keep Java's
#: matcher from trying again inside a run; they fit the same spans as the plain forms.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

CONTACT = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"
EXTRA = ("contact", "ssn", "secret")
KINDS = BASE + EXTRA

#: Words that come before personal data.
GAZETTEER = {
    "contact": "phone|tel|telephone|call|mobile|fax|whatsapp|telefon|teléfono|appelez|anruf",
    "ssn": "ssn|social|security|taxpayer|sozialversicherung",
    "secret": "token|key|secret|password|passwd|pwd|api|auth|bearer|credential",
}
LABELERS = 6
#: Three values of each vote, three kinds, three shares of digits, three lengths.
MAX_PATTERNS = 3**LABELERS * 3 * 3 * 3
LEFT, RIGHT = 24, 8
PLACED = "array<struct<start:int,end:int,said:string,left:string,right:string>>"
SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
CANDIDATE = f"struct<start:int,ord:int,end:int,kind:string,{','.join(f'v{i}:int' for i in range(LABELERS))},f0:int,f1:int>"


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; within a lambda, an expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, step) -> Column:
    """The running sums, maxima or the like of an array of ints, each with its own value in it.

    By blocks of about the root of its length, as an array that grows one by one is copied each time.
    """
    none = F.array().cast("array<int>")

    def sweep(block: Column) -> Column:
        start = F.struct(zero.alias("now"), none.alias("seen"))

        def add(acc: Column, x: Column) -> Column:
            return F.struct(step(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(step(acc["now"], x))).alias("seen"))

        return F.aggregate(block, start, add, lambda acc: acc["seen"])

    def by_blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: sweep(F.slice(v, i * width + 1, width)))

    def whole(blocks: Column) -> Column:
        before = F.concat(F.array(zero), sweep(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, before, lambda b, so_far: F.transform(b, lambda x: step(so_far, x))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(by_blocks(v), whole)).otherwise(none))


def sums(lengths: Column) -> Column:
    return running(lengths, F.lit(0), lambda x, y: x + y)


def highest(values: Column) -> Column:
    return running(values, F.lit(-1), lambda x, y: F.greatest(x, y))


def lowest(values: Column) -> Column:
    return running(values, F.lit(2**31 - 1), lambda x, y: F.least(x, y))


def located(text: Column, pattern: str, maybe: Column) -> Column:
    """Matches as (start, end, said, left, right), in code points; only looked for where ``maybe`` holds.

    left and right: up to ``LEFT`` and ``RIGHT`` characters around, but not beyond the matches next to a match.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"), F.split(text, pattern, -1).alias("between"))

    def placed(z: Column) -> Column:
        said, between, n = z["said"], z["between"], F.size(z["said"])
        nothing = F.array(F.lit(""))
        line = F.arrays_zip(
            said.alias("said"),
            sums(F.zip_with(F.slice(between, F.lit(1), n), said, lambda b, s: F.length(b) + F.length(s))).alias("end"),
            F.concat(nothing, F.slice(between, F.lit(1), n - 1)).alias("farther"),
            F.concat(nothing, F.slice(said, F.lit(1), n - 1)).alias("before"),
            F.slice(between, F.lit(1), n).alias("near"),
            F.slice(between, F.lit(2), n).alias("after"),
            F.concat(F.slice(said, F.lit(2), n), nothing).alias("following"),
        )
        return F.transform(
            line,
            lambda x: F.struct(
                (x["end"] - F.length(x["said"])).alias("start"), x["end"].alias("end"), x["said"].alias("said"),
                F.right(F.concat(F.right(x["farther"], F.lit(LEFT)), x["before"], x["near"]), F.lit(LEFT)).alias("left"),
                F.left(F.concat(x["after"], x["following"]), F.lit(RIGHT)).alias("right"),
            ),
        )

    none = F.array().cast(PLACED)
    return F.when(maybe, bound(found, lambda z: F.when(F.size(z["said"]) > 0, placed(z)).otherwise(none))).otherwise(none)


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(said: Column) -> Column:
    number = F.reverse(digits(said))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(number, i, F.lit(1)).cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(number, i, F.lit(1)).cast("int"))),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted base spans of a text that is not null."""
    n_phone = lambda said: F.length(digits(said))
    in_range = lambda said: F.forall(F.split(said, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    found = (
        (located(text, EMAIL, F.contains(text, F.lit("@"))), None),
        (located(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))), in_range),
        (located(text, CARD, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}+"))), luhn),
        (located(text, PHONE, F.contains(text, F.lit("+"))), lambda said: (n_phone(said) >= 9) & (n_phone(said) <= 15)),
    )
    parts = []
    for kind, (spans, valid) in zip(BASE, found, strict=True):
        parts.append(typed(only(spans, valid) if valid else spans, kind))
    return F.array_sort(F.concat(*parts))


def only(spans: Column, valid) -> Column:
    return F.filter(spans, lambda s: valid(s["said"]))


def typed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPANS)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def proposals(text: Column, base: Column) -> Column:
    """Candidates outside base spans, each with its votes and features."""
    found = {
        "contact": located(text, CONTACT, F.rlike(text, F.lit(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"))),
        "ssn": located(text, SSN, F.rlike(text, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"))),
        "secret": located(text, SECRET, F.rlike(text, F.lit(SECRET))),
    }

    def all_voted(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: voted(s, kind))

    return outside(F.concat(*[all_voted(spans, kind) for kind, spans in found.items()]), base)


def outside(candidates: Column, base: Column) -> Column:
    """The ``candidates``, sorted, that overlap none of the ``base`` spans: in order of starts, a base span that overlaps
    one ends beyond its start if it is before it, and starts before its end if it is after it."""

    def free(z: Column) -> Column:
        own = F.transform(z["c"], lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("mine"), F.lit(0).alias("end"), c.alias("c")))
        fixed = F.transform(z["b"], lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("mine"), b["end"].alias("end"), F.lit(None).cast(CANDIDATE).alias("c")))
        return bound(F.array_sort(F.concat(own, fixed)), lambda line: F.transform(kept(line), lambda x: x["line"]["c"]))

    def kept(line: Column) -> Column:
        ended = highest(F.transform(line, lambda x: x["end"]))
        starts = F.reverse(lowest(F.reverse(F.transform(line, lambda x: F.when(x["mine"] == 0, x["start"]).otherwise(2**31 - 1)))))
        joined = F.arrays_zip(line.alias("line"), ended.alias("ended"), starts.alias("next"))
        return F.filter(joined, lambda x: (x["line"]["mine"] == 1) & (x["ended"] <= x["line"]["start"]) & (x["next"] >= x["line"]["c"]["end"]))

    both = F.struct(candidates.cast(f"array<{CANDIDATE}>").alias("c"), base.alias("b"))
    return bound(both, lambda z: F.when((F.size(z["b"]) == 0) | (F.size(z["c"]) == 0), F.array_sort(z["c"])).otherwise(free(z)))


def voted(s: Column, kind: str) -> Column:
    said, left, right = s["said"], F.lower(s["left"]), s["right"]
    size, n_digits = F.length(said), F.length(digits(said))
    variety = F.size(F.array_distinct(F.split(said, "")))
    changes = F.size(F.split(said, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
    shape = {
        "contact": vote(F.rlike(said, F.lit(r"^(\([0-9]{3}\) |[0-9]{3}[.-])[0-9]{3}[.-]")), F.rlike(said, F.lit(r"^[0-9 ]+$"))),
        "ssn": vote(~F.rlike(said, F.lit(r"^(000|666|9)")), F.rlike(said, F.lit(r"^(000|666|9)|-00-|-0000$"))),
        "secret": vote((changes >= 4) | F.rlike(said, F.lit("^[0-9a-f]{32,}$")), changes <= 2),
    }[kind]
    return F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        shape.alias("v0"),
        vote(F.rlike(left, F.lit(rf"(^|[^\p{{L}}])({GAZETTEER[kind]})s?[^\p{{L}}]*$")), F.lit(False)).alias("v1"),
        vote(F.rlike(left, F.lit(r"[=:\"'(]\s*$")), F.rlike(left, F.lit(r"[/\\#&?]$")) | F.startswith(right, F.lit("/"))).alias("v2"),
        vote((n_digits * 5 >= size) if kind == "secret" else F.lit(True), n_digits * 20 < size).alias("v3"),
        vote(variety >= 6, variety <= 3).alias("v4"),
        vote(F.rlike(right, F.lit(r"^[\"'\s.,;)]|^$")), F.rlike(right, F.lit(r"^\p{L}"))).alias("v5"),
        F.least(F.floor(n_digits * 3 / size), F.lit(2)).cast("int").alias("f0"),
        F.when(size < 24, 0).when(size < 40, 1).otherwise(2).alias("f1"),
    )


VOTES = [f"v{i}" for i in range(LABELERS)]
PATTERN = ["kind", *VOTES, "f0", "f1"]


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probabilities that patterns of votes are true: EM for the labelers' chances of each vote given the truth."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))  # starts from the majority
    for _ in range(rounds):
        prior = np.clip((p * n).sum() / n.sum(), 0.02, 0.98)
        score = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                yes = ((p * n)[at].sum() + (2 if v == 1 else 1)) / ((p * n).sum() + 4)
                no = (((1 - p) * n)[at].sum() + (2 if v == -1 else 1)) / (((1 - p) * n).sum() + 4)
                score[at] += np.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


def features(rows: list[dict]) -> np.ndarray:
    """Indicators of kinds, of votes for and against, and of the two features' values."""
    out = [[1.0, *(float(r["kind"] == k) for k in EXTRA), *(float(r[v] == s) for v in VOTES for s in (1, -1)), *(float(r[f] == s) for f in ("f0", "f1") for s in (1, 2))] for r in rows]
    return np.array(out).reshape(len(rows), 1 + len(EXTRA) + 2 * LABELERS + 4)


def fit(rows: list[dict]) -> list[float]:
    """Weights of the span classifier, in the order of ``features``; ``rows``: patterns and their counts ``n``."""
    if not rows:
        return [0.0] * (1 + len(EXTRA) + 2 * LABELERS + 4)
    rows = sorted(rows, key=lambda r: tuple(str(r[c]) for c in PATTERN))
    n = np.array([r["n"] for r in rows], float)
    votes = np.array([[r[v] for v in VOTES] for r in rows])
    p = np.zeros(len(rows))
    for kind in EXTRA:  # labelers are not equally reliable for all kinds
        at = np.array([r["kind"] == kind for r in rows])
        if at.any():
            p[at] = reliabilities(votes[at], n[at])
    x, w = features(rows), np.zeros(1 + len(EXTRA) + 2 * LABELERS + 4)
    weight = np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(60):  # Newton steps, with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - p)) + 1e-3 * w
        hess = (x * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return [float(v) for v in w]


def train(docs: DataFrame) -> list[float]:
    """The span classifier's weights, from the candidates in all of ``docs`` (text)."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    likely = F.rlike(F.col("text"), F.lit("[0-9]"))
    found = texts.filter(likely).select("text", base_spans(F.col("text")).alias("base")).select(F.explode(proposals(F.col("text"), F.col("base"))).alias("c"))
    counts = found.select(*[F.col(f"c.{c}") for c in PATTERN]).groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("n"))
    return fit([r.asDict() for r in counts.collect()])


def accepted(c: Column, weights: list[float]) -> Column:
    """Whether the classifier takes a candidate."""
    terms = [F.lit(weights[0])]
    rest = iter(weights[1:])
    terms += [F.when(c["kind"] == k, next(rest)).otherwise(0.0) for k in EXTRA]
    terms += [F.when(c[v] == s, next(rest)).otherwise(0.0) for v in VOTES for s in (1, -1)]
    terms += [F.when(c[f] == s, next(rest)).otherwise(0.0) for f in ("f0", "f1") for s in (1, 2)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total > 0


def find(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``docs`` with pii_base and pii_spans: arrays of (start, ord, end, kind) by start, then kind.

    Null and empty texts have none. Repeated rows and other columns stay; columns with the new names are
    replaced. Spans of different kinds may overlap; added ones never overlap base ones.
    """
    out = docs.drop("pii_base", "pii_spans")
    held = fresh(out, "_text")
    out = out.withColumn(held, F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col(held)
    some = F.rlike(text, F.lit("[0-9]"))  # but an email, everything has a digit
    maybe = some | F.contains(text, F.lit("@"))
    out = out.withColumn("pii_base", F.when(maybe, base_spans(text)).otherwise(F.array().cast(SPANS)))
    proposed = F.filter(proposals(text, F.col("pii_base")), lambda c: accepted(c, weights))
    added = F.transform(proposed, lambda c: F.struct(*[c[x].alias(x) for x in ("start", "ord", "end", "kind")])).cast(SPANS)
    spans = F.when(some, F.array_sort(F.concat("pii_base", added))).otherwise(F.col("pii_base"))
    return out.withColumn("pii_spans", spans).drop(held)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its (first) kind in brackets.

    Pieces are cut from an array of the text's characters, as a string is read from its start for every piece.
    """

    def cut(z: Column) -> Column:
        joined = F.arrays_zip(z["spans"].alias("s"), F.concat(F.array(F.lit(0)), z["ended"]).alias("at"))
        runs = F.filter(joined, lambda x: x["s"]["start"] >= x["at"])
        return F.concat(F.array_join(F.transform(runs, lambda x: piece(z, x)), ""), rest(z))

    def piece(z: Column, x: Column) -> Column:
        return F.concat(F.array_join(F.slice(z["chars"], x["at"] + 1, x["s"]["start"] - x["at"]), ""), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]"))

    def rest(z: Column) -> Column:
        return F.array_join(F.slice(z["chars"], F.element_at(z["ended"], -1) + 1, F.size(z["chars"])), "")

    whole = F.struct(spans.alias("spans"), highest(F.transform(spans, lambda s: s["end"])).alias("ended"), F.split(text, "").alias("chars"))
    return F.when(F.size(spans) > 0, bound(whole, cut)).otherwise(text)

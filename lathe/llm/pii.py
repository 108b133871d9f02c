"""Personal data by weak supervision, in DataFrame operations only.

Base spans are found by a pattern and a test for each kind. Wider patterns give further candidates (a card number next
to a telephone number, which the base pattern runs together; a number written without its country code; an address with
"(at)"). Five labelers vote on every candidate, base spans included: pattern, checksum or structure, gazetteer,
context words, and edges. Expectation-maximisation over the counts of vote combinations (at most 3^5 a kind, whatever
the input) estimates for each kind how often it is true and how often each labeler says so; its posteriors train a logistic
span classifier on the votes. Candidates that it accepts are added; base spans always stay.

Positions are code points, ends exclusive. They come from the pieces between matches: lengths are added up, so a text is
read once for each pattern and whole, at any length. Patterns with unbounded loops are possessive or of single
characters, so long runs don't overflow the stack. Nulls: a null text is empty and has no spans; a null doc_id is
carried. Repeated rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")

#: Java forms of the base patterns. A run of an address's first part is tried at its start or where a match ended; a
#: card's run of digits is matched only if its digits are 16 to 19, which changes no other match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)|[0-9]{3}))[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
#: What every text with a match has: other texts aren't searched.
BASE_MARK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
WIDE_MARK = {"email": r"@|[(\[]at", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{4}", "phone": "[0-9]{4}"}
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers, as patterns on the match: top-level domains, issuer ranges, country codes, first octets in public use.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|int|info|io|eu|de|fr|es|it|nl|at|ch|be|uk|us|ca|mx|ar|br|pt|pl|se|no|dk|fi|in|jp|cn|au)$",
    "ip": r"^(?!0|10\.|127\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|64|65)",
    "phone": r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
}
#: Words that speak for a kind, and against any, in the CONTEXT characters before a match.
CONTEXT = 24
FOR = {
    "email": r"(?i)(?:e-?mail|mailto|contact|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|login|address|adresse|adres)",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|handy|appel)",
}
AGAINST = r"(?i)(?:token|secret|passw|hash|sha|key|uuid|version|isbn)[^\x20]{0,8}[\x20=:\x22]{0,4}[0-9a-z\x22]*$"
LABELERS = ("pattern", "structure", "gazetteer", "context", "edges")


def matches(text: Column, pattern: str, hand: int = 256) -> Column:
    """Array of (start, end, value) of the leftmost matches that don't overlap.

    Lengths are added up hand by hand and the hands put together, since adding to an array copies it."""
    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, p, F.lit(0)).alias("b"))
    kind = "array<struct<start:int,end:int,value:string>>"
    span = lambda s, e, v: F.struct(s.alias("start"), e.alias("end"), v.alias("value"))

    def step(acc, pair):
        s = acc["at"] + F.char_length(pair["a"])
        e = s + F.char_length(pair["b"])
        return F.when(pair["b"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(span(s, e, pair["b"]))).alias("out")))

    def within(part):
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

    def after(acc, done):
        moved = F.transform(done["out"], lambda m: span(m["start"] + acc["at"], m["end"] + acc["at"], m["value"]))
        return F.struct((acc["at"] + done["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed_all(pairs):
        begins = F.array_compact(F.transform(pairs, lambda x, i: F.when(i % hand == 0, i + 1)))
        parts = F.transform(begins, lambda i: within(F.slice(pairs, i, F.lit(hand))))
        whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), after)
        return F.when(F.size(pairs) <= hand, within(pairs)["out"]).otherwise(F.flatten(whole["out"]))

    return F.element_at(F.transform(F.array(pairs), placed_all), 1)  # so that the text is searched once


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """The base test of a match."""
    n = F.char_length(digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits(value)),
        "phone": n.between(8, 15),
    }[kind]


def tested(kind: str):
    return lambda m: valid(kind, m["value"])


def structured(kind: str, value: Column) -> Column:
    """A second, independent look at the form."""
    return {
        "email": value.rlike(r"^[A-Za-z0-9][^@(\[]*(?:@|\x20?[\[(]at).*\.?[A-Za-z]{2,}$"),
        "ip": value.rlike(r"^(?!0[0-9]|.*\.0[0-9])"),
        "card": F.call_function("luhn_check", digits(value)),
        "phone": value.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}$"),
    }[kind]


def voted(text: Column, kind: str, found: Column) -> Column:
    """Adds the labelers' votes to matches: 1 for, -1 against, 0 for none."""

    def one(m):
        value, start, end = m["value"], m["start"], m["end"]
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        left, right = F.substring(before, -1, 1), F.substring(text, end + 1, F.lit(1))
        votes = {
            "pattern": F.when(valid(kind, value), 1).otherwise(-1),
            "structure": F.when(structured(kind, value), 1).otherwise(-1),
            "gazetteer": F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind == "card" else 0),
            "context": F.when(before.rlike(AGAINST), -1).when(before.rlike(FOR[kind]), 1).otherwise(0),
            "edges": F.when(left.rlike(r"[\p{L}0-9_=\x22/]") | right.rlike(r"[\p{L}_=\x22/]"), -1).otherwise(1),
        }
        return F.struct(start.alias("start"), end.alias("end"), *(v.cast("int").alias(k) for k, v in votes.items()))

    return F.transform(found, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and for each kind base_<kind> and wide_<kind>: spans with votes. The only pass over texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    cols = []
    for kind in KINDS:
        base = F.filter(matches(text, BASE[kind]), tested(kind))
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        for name, found, mark in ((f"base_{kind}", base, BASE_MARK[kind]), (f"wide_{kind}", matches(text, WIDE[kind]), WIDE_MARK[kind])):
            cols.append(voted(text, kind, F.when(text.rlike(mark), found).otherwise(none)).alias(name))
    return rows.select("doc_id", *cols)


def vote_counts(spans: DataFrame) -> dict[str, dict[tuple[int, ...], int]]:
    """How often each combination of votes occurs, by kind, over wide candidates: at most 3^5 rows a kind."""
    out: dict = defaultdict(dict)
    votes = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), *(s[v].alias(v) for v in LABELERS))
    both = F.concat(*(F.transform(f"wide_{kind}", votes(kind)) for kind in KINDS))
    for r in spans.select(F.explode(both).alias("s")).groupBy("s.kind", *(f"s.{v}" for v in LABELERS)).count().collect():
        out[r["kind"]][tuple(r[v] for v in LABELERS)] = r["count"]
    return out


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[list[dict[int, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation: the share of true candidates, each labeler's votes given truth, posteriors of combinations."""
    post = {v: min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v in counts}
    share, table_ = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (2 + sum(n * post[v] for v, n in counts.items())) / (4 + total)
        table_ = []
        for k in range(len(LABELERS)):
            rows = []
            for truth in (0, 1):
                # pseudo-counts say that a labeler is rather right than wrong; they also fix which class is which
                n = {-1: 1.0 + 3 * (1 - truth), 0: 1.0, 1: 1.0 + 3 * truth}
                for v, c in counts.items():
                    n[v[k]] += c * (post[v] if truth else 1 - post[v])
                rows.append({x: y / sum(n.values()) for x, y in n.items()})
            table_.append(rows)
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(table_[k][1][x] / table_[k][0][x]) for k, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-40, min(40, odds))))
    return share, table_, post


def span_classifier(counts: dict[tuple[int, ...], int], post: dict[tuple[int, ...], float], rounds: int = 300, decay: float = 1e-3) -> list[float]:
    """Logistic weights (bias first) on the votes, trained on posteriors as soft labels by gradient descent."""
    w = [0.0] * (len(LABELERS) + 1)
    total = max(1, sum(counts.values()))
    for _ in range(rounds):
        g = [decay * x for x in w]
        for v, n in counts.items():
            x = (1, *v)
            p = 1 / (1 + math.exp(-max(-40, min(40, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, xi in enumerate(x):
                g[i] += n / total * (p - post[v]) * xi
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def placed(k: int):
    return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def accepted(kind: str, weights: list[float], least: float):
    """Whether the classifier accepts a candidate that no base span of its kind overlaps."""

    def test(s):
        score = F.lit(weights[0])
        for v, w in zip(LABELERS, weights[1:], strict=True):
            score = score + F.lit(w) * s[v]
        return (score > least) & ~F.exists(f"base_{kind}", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return test


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), ordered by kind and start."""
    spans = materialize(candidates(docs), "pii")
    weights = {}
    for kind, counts in vote_counts(spans).items():
        _, _, post = reliabilities(counts)
        weights[kind] = span_classifier(counts, post)
    base, added = [], []
    for k, kind in enumerate(KINDS):
        own = placed(k)
        base.append(F.transform(f"base_{kind}", own))
        w = weights.get(kind, [0.0] * (len(LABELERS) + 1))
        added.append(F.transform(F.filter(f"wide_{kind}", accepted(kind, w, math.log(threshold / (1 - threshold)))), own))
    return spans.select("doc_id", F.concat(*base).alias("base"), F.concat(*added).alias("added"))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))

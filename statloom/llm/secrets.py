"""Secret scan: patterns, and sliding-window Shannon entropy over candidate strings.

Patterns (``BASE``) find assignments of secrets, access keys and long hexadecimal strings. The entropy
method adds spans: candidates are runs of one character class (``CLASSES``) of a least length; a window
moves over each candidate one character at a time, and the counts of its characters are updated by the
one that enters and the one that leaves. With g(c) = c * log2(c) the window's entropy is
log2(width) - sum(g(count)) / width, so only the counts and the sum are carried (in whole millionths of
a bit, so that no rounding adds up). Candidates are cut at what the allow-list names, and only the pieces
between are judged: a candidate is reported whole if the largest entropy of a piece's windows reaches the limit of
its class, unless a pattern already covers part of it. The work grows with the length of a candidate.

Everything is a DataFrame expression on one row: no shuffle, no Python. Positions are code points.
Null and empty texts have no spans. Ids, ties and repeated rows are passed on as they are; other
columns are kept. Very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length
BASE = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # shorter runs fail anyway, so they need not be found first
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
WIDTH = 20
#: kind, candidates, what a judged piece must contain, what it must not be, the class, least entropy in bits
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]{20,}", r"[0-9]", r"[0-9]+", "0123456789ABCDEFabcdef", 3.0),
    (
        "entropy_mixed",
        r"[A-Za-z0-9+/_=-]{20,}",
        r"[0-9]",
        r"[0-9A-Fa-f]+|[0-9+/_=-]+",
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-",
        3.7,
    ),
]
KINDS = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]
#: Parts of candidates that are known to be harmless: placeholders, alphabets, UUIDs, paths of short names and links.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|redacted|xxxxx|0123456789|abcdefghij|"
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:/[a-z0-9_-]{1,16}){2,}/|www|http"
)
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def costs(width: int = WIDTH) -> list[int]:
    """c * log2(c) in millionths of a bit."""
    return [0] + [round(c * math.log2(c) * 1e6) for c in range(1, width + 1)]


def most_cost(limit: float, width: int = WIDTH) -> int:
    """The largest sum of costs at which a window has ``limit`` bits of entropy."""
    return round((math.log2(width) - limit) * width * 1e6)


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Every match of a pattern with its code points [start, end): what lies between adds up to the place."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda between, match: F.struct(between.alias("between"), match.alias("match")),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["between"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        more = F.when(x["match"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(span)))
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.aggregate(pieces, first, step, lambda a: a["spans"])


def least_cost(value: Column, alphabet: str, width: int = WIDTH) -> Column:
    """The least sum of costs over the windows of ``value``: its largest entropy."""
    cost = F.array(*[F.lit(c) for c in costs(width)])
    # places in the class, from 1, found once per character; 0 while nothing leaves yet
    places = F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    left = F.concat(F.array_repeat(F.lit(0), width), places)
    moves = F.zip_with(places, left, lambda p, q: F.struct(p.alias("enters"), q.alias("leaves")))
    first = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).alias("n"),
        F.lit(0).alias("sum"),
        F.lit(costs(width)[-1]).alias("least"),
    )

    def step(a: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        n_in, n_out = F.get(a["counts"], enters - 1), F.get(a["counts"], leaves - 1)
        change = F.get(cost, n_in + 1) - F.get(cost, n_in)
        change = change + F.when(leaves > 0, F.get(cost, n_out - 1) - F.get(cost, n_out)).otherwise(0)
        total = a["sum"] + F.when(enters == leaves, 0).otherwise(change)
        counts = F.transform(a["counts"], lambda c, k: c + (k == enters - 1).cast("int") - (k == leaves - 1).cast("int"))
        least = F.when(a["n"] + 1 >= width, F.least(a["least"], total)).otherwise(a["least"])
        return F.struct(counts.alias("counts"), (a["n"] + 1).alias("n"), total.alias("sum"), least.alias("least"))

    return F.aggregate(F.slice(moves, F.lit(1), F.char_length(value)), first, step, lambda a: a["least"])


def _long_enough(pattern: str, group: int, least: int):
    return lambda s: F.char_length(F.regexp_extract(s["value"], pattern, group)) >= least


def _dense(needs: str, never: str, alphabet: str, limit: float):
    def piece(p: Column) -> Column:
        doubtful = (F.char_length(p) >= WIDTH) & p.rlike(needs) & ~p.rlike(f"^(?:{never})$")
        return doubtful & (least_cost(p, alphabet) <= most_cost(limit))

    return lambda s: F.exists(F.split(s["value"], ALLOWED, -1), piece)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: array of (start, kind, end, value), by start, then kind (see ``KINDS``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base, more = {}, {}
    for kind, (_, pattern, group, least) in enumerate(BASE):
        base[f"_spans_{kind}"] = F.filter(_found(whole, pattern, kind), _long_enough(pattern, group, least))
    for kind, (_, pattern, needs, never, alphabet, limit) in enumerate(CLASSES, len(BASE)):
        more[f"_spans_{kind}"] = F.filter(_found(whole, pattern, kind), _dense(needs, never, alphabet, limit))
    out = docs.withColumns(base | more).withColumn("_base", F.concat(*base)).withColumn("_more", F.concat(*more))

    def apart(s: Column) -> Column:
        return ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    new = F.filter(F.col("_more"), apart)
    return out.withColumn("_spans", F.array_sort(F.concat("_base", new))).drop(*base, *more, "_base", "_more")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, _of_kind(KINDS.index(kind)))).cast("long")


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of the spans of the first ``kinds``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    own = F.filter(spans, lambda s: s["kind"] < len(kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

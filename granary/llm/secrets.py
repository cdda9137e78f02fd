"""Secrets: fixed patterns, and strings of high entropy that they miss.

Base: assignments to password-like names, access key ids, and long hexadecimal strings. The method then looks at every other
string of twenty characters or more of the Base64 alphabet: it slides a window over it and keeps the counts
of the characters inside; each step changes two counts and so the sum of ``c log c`` by two terms, and Shannon entropy is the
window's log less that sum over its length. Each character class (no digit, hexadecimal, alphanumeric, Base64) has its own window
and threshold; without a digit it is one that long words, names and paths stay below. An allow-list suppresses candidates: placeholders, runs of the alphabet, and values given by the caller.

Built-in functions only; a document is read once and nothing is shuffled. Memory is that of one text.

Defined results: a null text counts as empty and has no spans. Repeated rows and a null ``doc_id`` are passed through. A match
that fails its length is dropped and not tried again. A candidate that overlaps a base span adds none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let
from granary.llm.spans import count_of, found, of_kind, overlaps, written_out

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"


@dataclass(frozen=True)
class CharClass:
    """Strings of ``pattern``; a window of ``window`` characters counts at ``bits`` of entropy a character or more."""

    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass(r"^(?=[^0-9]+$)(?![a-f]+$|[A-F]+$)", 24, 4.05),
    CharClass(r"^([0-9a-f]+|[0-9A-F]+)$", 20, 3.0),
    CharClass(r"^[A-Za-z0-9]+$", 20, 3.6),
    CharClass(r"^[A-Za-z0-9+/_=-]+$", 24, 3.9),
)
#: Candidates that match one of these aren't secrets.
ALLOW = (r"(?i)example|placeholder|changeme|dummy|sample", r"(?i)abcdefgh|01234567|12345678", r"(.)\1{7}", r"^[0-9]+$", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


def max_entropy(value: Column, window: int) -> Column:
    """The greatest entropy in bits of a window of ``value``, whose characters are those of the Base64 alphabets."""
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    place = lambda i: F.instr(F.lit(_ALPHABET), F.substring(value, i, F.lit(1)))

    def put(counts: Column, at: Column, c: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(c), F.slice(counts, at + 1, F.lit(len(_ALPHABET)) - at))

    def change(state: Column, at: Column, by: int) -> Column:
        def step(c: Column) -> Column:
            return F.struct(put(state["counts"], at, c + by).alias("counts"), (state["s"] + weight(c + by) - weight(c)).alias("s"))

        return let(F.get(state["counts"], at - 1), step)

    def slide(state: Column, i: Column) -> Column:
        gone = F.struct(state["counts"].alias("counts"), state["s"].alias("s"))
        left = F.when(i > window, let(place(i - window), lambda at: change(gone, at, -1))).otherwise(gone)
        held = let(left, lambda x: let(place(i), lambda at: change(x, at, 1)))
        entropy = lambda x: F.when(i >= window, F.lit(math.log2(window)) - x["s"] / window).otherwise(F.lit(0.0))
        return let(held, lambda x: F.struct(x["counts"].alias("counts"), x["s"].alias("s"), F.greatest(state["best"], entropy(x)).alias("best")))

    start = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, slide, lambda x: x["best"])


def suspicious(value: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a candidate string is of high entropy for its class and not allowed."""
    safe = value.isin(*allowed) if allowed else F.lit(False)
    for pattern in ALLOW:
        safe = safe | value.rlike(pattern)
    high = F.lit(False)
    for c in reversed(CLASSES):
        high = F.when(value.rlike(c.pattern), (F.char_length(value) >= c.window) & (max_entropy(value, c.window) >= c.bits)).otherwise(high)
    return ~safe & F.when(~safe, high).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    assigns = F.filter(found(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = found(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = found(text, HEX)
    return F.array_sort(F.concat(of_kind(assigns, 0), of_kind(access, 1), of_kind(hexes, 2)))


def entropy_spans(text: Column, base: Column, allowed: tuple[str, ...] = ()) -> Column:
    near = found(text, CANDIDATE, text.rlike("[A-Za-z0-9+/_-]{20}"))
    return of_kind(F.filter(near, lambda s: ~overlaps(base, s["start"], s["end"]) & suspicious(s["value"], allowed)), 3)


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", allowed: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns with ``base`` and ``spans``: array<struct<start, k, end>> in order of start, then kind."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    held = held.withColumn("base", base_spans(F.col("__text")))
    held = held.withColumn("spans", F.array_sort(F.concat("base", entropy_spans(F.col("__text"), F.col("base"), allowed))))
    return held.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "base", "spans")


def query(docs: DataFrame) -> DataFrame:
    """``op4_secrets``."""
    return find(docs).select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])],
        F.sha2(written_out(F.col("base"), KINDS), 256).alias("base_sha256"),
        written_out(F.col("spans"), KINDS).alias("spans"),
    )

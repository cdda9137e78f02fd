"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

Base: e-mail addresses, IPv4 addresses, card numbers that pass Luhn, and international phone numbers. They are the seeds of
the method: the word to the left of an identifier is a lexical pattern, and patterns and the distinct strings they introduce
form a graph. Rounds score it: a pattern by the mean score of its strings (shrunk, so that few strings prove little), a string
by its patterns (one minus the product of their doubts); seeds stay at 1. A string that scores high is known from then on and
supports other patterns, until no further pattern is sure. Patterns of high confidence and support mark strings of the shape of
an identifier that no base pattern knows.

All of it is built-in functions. Texts are read once; what leaves that pass is places, and the few tokens with a digit or an
at sign with the word before them. The graph is grouped before it is joined, so a pattern or string that holds a third of
all occurrences is one row a pattern and string. Texts aren't shuffled: the sure patterns, up to a stated number, go to the tasks.

The regular expressions are those of the contract made safe for long runs: possessive repeats and look-behinds that match
the same places without trying each start in a run again.

Defined results: a null text counts as empty and has no spans. Repeated rows are judged one by one; a null ``doc_id`` is passed
through. Overlapping base spans are all reported; ``redact`` replaces their union once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let, written
from granary.llm.spans import count_of, found, of_kind, overlaps, replaced, written_out

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Rounds of scoring at most; the least confidence and known strings of a pattern; what is added to its count; characters of context.
ROUNDS, CONFIDENCE, SUPPORT, SHRINK, REACH = 10, 0.9, 5, 1.0, 100
#: Sure patterns that go to all tasks; where there are more, tokens are joined to them.
MOST_HELD = 1000
#: What a discovered identifier looks like once quotes and end marks are gone: six digits at least, or an at sign inside.
SHAPE = r"^[A-Za-z0-9._%+@:/-]{6,64}$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        one = F.transform(F.sequence(F.lit(1), F.char_length(d)), lambda i: let(F.substring(d, i, F.lit(1)).cast("int"), lambda v: F.when(i % 2 == 0, twice(v)).otherwise(v)))
        return F.aggregate(one, F.lit(0), lambda a, v: a + v) % 10 == 0

    return let(F.reverse(_digits(x)), total)


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> in order of start, then kind."""
    digit = text.rlike("[0-9]")
    emails = found(text, EMAIL, F.contains(text, F.lit("@")))
    ips = F.filter(found(text, IP, digit), lambda s: _octets(s["value"]))
    cards = F.filter(found(text, CARD, digit), lambda s: _luhn(s["value"]))
    phones = F.filter(found(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.char_length(_digits(s["value"])).between(9, 15))
    return F.array_sort(F.concat(of_kind(emails, 0), of_kind(ips, 1), of_kind(cards, 2), of_kind(phones, 3)))


def _tokens(text: Column, base: Column) -> Column:
    """array<struct<start, end, value, pattern, seed>>: tokens that may be identifiers, cleared of marks around them, and the word before each."""
    matches = found(text, TOKEN, text.rlike("[0-9@]"))

    def left(m: Column, s: Column, i: Column) -> Column:
        word = F.regexp_extract(F.right(s["before"], F.lit(REACH)), r"([^\x20\x09-\x0D]{1,100})[\x20\x09-\x0D]*$", 1)
        return F.lower(F.when(word != "", word).otherwise(F.right(F.coalesce(F.when(i > 0, F.get(m, i - 1)["value"]), F.lit("")), F.lit(REACH))))

    def one(m: Column, s: Column, i: Column) -> Column:
        head = F.char_length(s["value"]) - F.char_length(F.regexp_replace(s["value"], r"^[\"'(\[<]+", ""))
        value = F.regexp_replace(F.regexp_replace(s["value"], r"^[\"'(\[<]+", ""), r"[^A-Za-z0-9]+$", "")
        start = s["start"] + head
        end = start + F.char_length(value)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), left(m, s, i).alias("pattern"), overlaps(base, start, end).alias("seed"))

    return let(matches, lambda m: F.filter(F.transform(m, lambda s, i: one(m, s, i)), lambda t: t["seed"] | (t["value"].rlike(SHAPE) & ((F.char_length(_digits(t["value"])) >= 6) | t["value"].rlike("[A-Za-z0-9]@[A-Za-z0-9]")))))


def patterns(tokens: DataFrame, most_rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, support) of (pattern, value, seed), of the patterns that are sure.

    Each round scores patterns by their strings and strings by the patterns that have support; a string of high score counts as
    known from then on, and so supports further patterns. It ends when no pattern becomes sure any more, or after ``most_rounds``.
    """
    edges = written(tokens.filter("pattern <> ''").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    strings = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    known, n = None, -1
    for _ in range(most_rounds):
        by_pattern = edges.join(strings, "value").groupBy("pattern")
        scored = by_pattern.agg((F.sum("score") / (F.count("*") + F.lit(SHRINK))).alias("confidence"), F.count(F.when(F.col("score") >= CONFIDENCE, True)).alias("support"))
        # few of all patterns, so a small table that Spark may broadcast
        spoken = written(scored.filter(F.col("support") >= SUPPORT))
        known = spoken.filter(F.col("confidence") >= CONFIDENCE)
        last, n = n, known.count()
        if n == last:
            break
        doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999999))))
        said = edges.join(spoken, "pattern").groupBy("value").agg(doubt.alias("doubt"))
        seeds = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("seed"))
        strings = written(seeds.join(said, "value", "left").select("value", F.greatest("seed", F.lit(1.0) - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("score")))
    return known


def _marked(docs: DataFrame, carry: tuple[str, ...], text: str) -> DataFrame:
    """``carry`` columns as __c0, __c1 ... with __base and __spans."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"__c{i}" for i in range(len(carry))]
    seen = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], body.alias("__text")).withColumn("base", base_spans(F.col("__text")))
    seen = seen.withColumn("tokens", _tokens(F.col("__text"), F.col("base"))).drop("__text")
    seen = written(seen.withColumn("__row", F.monotonically_increasing_id()))
    tokens = seen.select("__row", F.explode("tokens").alias("t")).select("__row", "t.*")
    sure = written(patterns(tokens).select("pattern"))
    span = lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("k"), t["end"].alias("end"))
    if sure.count() <= MOST_HELD:
        # at most MOST_HELD patterns of at most REACH characters
        known = F.array(*[F.lit(r.pattern) for r in sure.collect()]).cast("array<string>")
        joined = seen.withColumn("__sure", known)
        new = F.transform(F.filter("tokens", lambda t: ~t["seed"] & F.array_contains("__sure", t["pattern"])), span)
    else:
        found_ = tokens.filter(~F.col("seed")).join(sure, "pattern", "left_semi")
        joined = seen.join(found_.groupBy("__row").agg(F.collect_list(F.struct("start", F.lit(4).alias("k"), "end")).alias("__new")), "__row", "left")
        new = F.coalesce("__new", F.array().cast("array<struct<start:int,k:int,end:int>>"))
    return joined.select(*names, F.col("base").alias("__base"), F.array_sort(F.concat("base", new)).alias("__spans"))


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` columns with ``base`` and ``spans`` (base and discovered): array<struct<start, k, end>> in order."""
    return _marked(docs, carry, text).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    """``op7_pii``."""
    return find(docs).select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])],
        F.sha2(written_out(F.col("base"), KINDS), 256).alias("base_sha256"),
        written_out(F.col("spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as ``[EMAIL]``; other columns, and null texts, unchanged."""
    names = list(docs.columns)
    marked = _marked(docs, tuple(names), text)
    body = F.col(f"__c{names.index(text)}")
    clean = F.when(body.isNotNull(), replaced(body, F.col("__spans"), KINDS))
    return marked.select(*[clean.alias(c) if c == text else F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])

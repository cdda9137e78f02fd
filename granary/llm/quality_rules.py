"""Quality rules as a short-circuit cascade.

A rule rejects a document by one measure of its text. Run in any order the rules keep the same documents, so the order is
free, and the cascade picks the cheapest: on a sample of all partitions each rule is run by itself, which gives its time and the
share that it rejects; rules are sorted by rejection per cost and evaluated as the branches of one ``CASE``, which stops at the
first rule that rejects. A measure that no caller asks for is computed in the branches that need it, and only if one is reached.
Everything is a built-in expression; nothing is shuffled.

Defined results: a null or empty text has no words, so all measures are 0 and the rule ``few_words`` rejects it. A null
``doc_id`` is passed through. Repeated rows are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import dropped, let, words, written

#: Words in a window of :func:`n_repeat_words`.
WINDOW = 5
#: Rows, about, on which cost and selectivity are measured, and runs of each rule, of which the shortest counts.
SAMPLE_ROWS, RUNS = 1000, 2


def n_symbols(text: Column, _: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long")


def word_chars(_: Column, w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_words(_: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def n_dup_lines(text: Column, _: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_lines(text: Column, _: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def n_upper(text: Column, _: Column) -> Column:
    """ASCII capitals."""
    return F.char_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long")


def n_letters(text: Column, _: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^A-Za-z]+", "")).cast("long")


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at these positions, which are in order."""
    gap = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gap, F.lit(0), lambda a, x: a + x)


def _repeated(keys: Column) -> Column:
    """Covered words, given the hash of the window at each position: sort by hash, keep positions whose neighbour is equal."""
    placed = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), _covered)

    return let(placed, twice)


def n_repeat_words(_: Column, w: Column) -> Column:
    """Words in windows of five words that the text holds twice or more, the first included.

    Windows compare by a 64-bit hash of their words' 64-bit hashes, within one text. Only a text with a repeated window is
    sorted; cost is n log n in its words.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _repeated(keys)).otherwise(0)

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) > WINDOW, let(let(hashed, windows), count)).otherwise(0).cast("long")


#: name -> expression of text and words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_lines": n_lines,
    "n_upper": n_upper,
    "n_letters": n_letters,
    "n_repeat_words": n_repeat_words,
}
#: Those that need the words.
OF_WORDS = ("n_words", "word_chars", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test``, given the columns named in ``measures``, is true."""

    name: str
    measures: tuple[str, ...]
    test: Callable[..., Column]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10, base=True),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n, base=True),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > 30 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 15 * n) | (c < 2 * n)),
    # a line of a page's frame may stand at its head and foot: one or two repeats say nothing of a short text
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d > 2) & (100 * d > 30 * n)),
    Rule("capitals", ("n_upper", "n_letters"), lambda u, n: 100 * u > 50 * n),
)


def with_measures(docs: DataFrame, names: tuple[str, ...], text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with these measures as columns ``prefix + name``."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("__granary_words", words(F.col(text)))
    return held.withColumns({prefix + n: MEASURES[n](body, F.col("__granary_words")) for n in names}).drop("__granary_words")


def _test(rule: Rule, of: Callable[[str], Column]) -> Column:
    return F.coalesce(rule.test(*[of(m) for m in rule.measures]), F.lit(False))


def _judged(text: str, rules: tuple[Rule, ...], given: dict[str, str], body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body`` of measures: columns for those given, expressions for the others; words are bound once, wherever the optimizer moves it."""
    raw = F.coalesce(F.col(text), F.lit(""))
    of = lambda w: lambda n: F.col(given[n]) if n in given else MEASURES[n](raw, w)
    if all(m in given or m not in OF_WORDS for r in rules for m in r.measures):
        return body(of(F.lit(None)))
    return let(words(F.col(text)), lambda w: body(of(w)))


def order_of(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, each with its cost (seconds for the sample) and rejected share.

    given: measures that are there anyway and cost a rule nothing. Only the order depends on the sample and the clock, never a
    verdict; without rows the order is that of the names.
    """
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select(F.col(text).alias("__granary_text")).sample(share, 7).repartition(1)  # read by all tasks; about ``rows`` rows meet
    held = written(with_measures(some, given, "__granary_text", "__granary_"))
    names = {n: f"__granary_{n}" for n in given}

    def run(test: Column) -> tuple[float, int]:
        best, hits = math.inf, 0
        for _ in range(RUNS):
            began = time.monotonic()
            hits = held.agg(F.count(F.when(test, True))).first()[0]
            best = min(best, time.monotonic() - began)
        return best, hits

    nothing, n = run(F.coalesce(F.char_length("__granary_text"), F.lit(0)) >= 0)
    found = []
    for r in rules:
        took, hits = run(_judged("__granary_text", (r,), names, lambda of, r=r: _test(r, of)))
        found.append((r, max(took - nothing, 1e-4), hits / max(1, n)))
    dropped(held)
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1] if n else 0, x[0].name))


def rejected_by(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "rejected_by", given: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``docs``, and the columns ``prefix + name`` of the measures given, with the name of the first rule that rejects the text (null: kept)."""
    order = [r for r, _, _ in order_of(docs, rules, text, given=given)]

    def cascade(of: Callable[[str], Column]) -> Column:
        verdict = F.lit(None).cast("string")
        for r in reversed(order):
            verdict = F.when(_test(r, of), F.lit(r.name)).otherwise(verdict)
        return verdict

    held = with_measures(docs, given, text, prefix) if given else docs
    return held.withColumn(out, _judged(text, rules, {n: prefix + n for n in given}, cascade))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return rejected_by(docs, rules, text, "__granary_rule").filter(F.col("__granary_rule").isNull()).drop("__granary_rule")


def query(docs: DataFrame) -> DataFrame:
    """``op8_quality_rules``: the measures of every document and what the cascade says."""
    given = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rejected_by(docs.select("doc_id", "text"), given=given)
    base = F.coalesce((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), F.lit(False))
    return judged.select("doc_id", *given, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [] END AS g FROM w),
r AS (SELECT *, row_number() OVER () AS k FROM l),
u AS (SELECT k, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM r WHERE len(list_distinct(g)) < len(g)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM u) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM d, (SELECT unnest(range(0, 5)) AS o) GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters
      FROM r LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_upper > 50 * n_letters) AS kept
FROM b
"""

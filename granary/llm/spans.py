"""Matches of patterns with their places, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.llm.common import let

_BLOCK = 128


def prefix_sums(lengths: Column) -> Column:
    """Sums of the elements before each, by blocks: linear but for the blocks' own sums."""

    def place(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda x, y: x + y))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

        def at(offs: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                b = F.floor(i / _BLOCK).cast("int")
                return F.get(offs, b) + F.aggregate(F.slice(a, b * _BLOCK + 1, i - b * _BLOCK), F.lit(0), lambda x, y: x + y)

            return F.transform(a, one)

        return let(starts, at)

    return let(lengths, place)


EMPTY = "array<struct<start:int,end:int,value:string,before:string>>"


def found(text: Column, pattern: str, when: Column | None = None) -> Column:
    """array<struct<start, end, value, before>> of leftmost non-overlapping matches; places in code points, end exclusive.

    ``before`` is the text between the match before and this one. ``split`` gives what lies between matches and
    ``regexp_extract_all`` the matches; running sums of their lengths are the places. A text without a match costs one pass.
    """
    none = F.array().cast(EMPTY)

    def placed(m: Column) -> Column:
        def gaps(g: Column) -> Column:
            def starts(at: Column) -> Column:
                return F.transform(
                    m,
                    lambda v, i: F.struct(
                        (F.get(at, i) + F.char_length(F.get(g, i))).alias("start"),
                        (F.get(at, i) + F.char_length(F.get(g, i)) + F.char_length(v)).alias("end"),
                        v.alias("value"),
                        F.get(g, i).alias("before"),
                    ),
                )

            return let(prefix_sums(F.transform(m, lambda v, i: F.char_length(F.get(g, i)) + F.char_length(v))), starts)

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), gaps)).otherwise(none)

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return every if when is None else F.when(when, every).otherwise(none)


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def written_out(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` joined by commas, of array<struct<start, k, end>> in order."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(matches: Column, k: int) -> Column:
    return F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def count_of(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def replaced(text: Column, spans: Column, names: tuple[str, ...]) -> Column:
    """``text`` with each span, or the part of it after the spans before, replaced by its kind in brackets."""
    labels = F.array(*[F.lit(f"[{n.upper()}]") for n in names])
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def clear(acc: Column, s: Column) -> Column:
        reach = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        cut = F.struct(F.greatest(s["start"], reach).alias("start"), s["k"].alias("k"), s["end"].alias("end"))
        return F.when(s["end"] > reach, F.array_append(acc, cut)).otherwise(acc)

    def put(kept: Column) -> Column:
        ends = lambda i: F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(0)
        parts = F.transform(kept, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), F.get(labels, s["k"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(kept, -1)["end"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, empty, clear), put)).otherwise(text)

"""Packing into fixed windows by minimum bin slack.

A document's token ids, with an end mark, are cut at multiples of the window; full pieces are sequences of their own and the
rest of each document is to be packed. Only the *lengths* of the rests matter, and there are at most ``window`` of them, so
their histogram is a bounded table. Over it, minimum bin slack fills one window after another: the longest length left is
laid down, and a subset-sum dynamic program over a bitset (bit ``s``: some multiset of the lengths left sums to ``s``) finds
the multiset that comes closest to capacity; it is traced back through the bitsets to counts of each length. The same fill is
repeated as often as the counts allow, so there are few thousand fills however many documents there are.

A fill says how many pieces of each length it takes, so (length, rank of a piece in its length) gives sequence and offset.
Ranks come from a window over (length, salt) and a bounded table of counts: a length that a third of all documents share is
dealt over all salts. Texts aren't shuffled; tokenization happens once, and what it says of a piece is a short row.

Defined results: a null text counts as empty, and an empty text is its end mark alone. A null ``doc_id`` is passed through.
Repeated rows are packed as documents of their own. An empty table gives no pieces. Ties of equal lengths go by the written
pieces' order, which a lost executor doesn't change.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import small_batches, written

WINDOW = 2048
END = 1
#: A vocabulary file's name in the tokenizers folder.
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Vocabulary path -> words' ids, for the life of a worker process: tasks that follow in it find the words of those before.
_KNOWN: dict[str, dict[str, bytes]] = {}
#: Marks after an ASCII letter or digit at a part's end. The tokenizer parts them there itself; no apostrophe, which may belong to
#: the word, and no other letter, which normalization may turn into one with a combining mark that joins them.
_MARKS = r"""([A-Za-z0-9])([.,!?;:#$%&*|()"]+)( |$)"""
#: Texts that stay as they are: names of special tokens, and combining marks, which capitals and small letters compose with unlike.
_WHOLE = r"<\||\pM"
#: Normalizers and pattern of words for which parts between spaces have the ids that they have in the text. Fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache(maxsize=2)
def parts_suffice(path: str) -> bool:
    """Whether a vocabulary file's tokenizer drops white space, never joins over it and lower-cases; any other gets whole texts."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    split, *rest = (held["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    wanted = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    levels = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    names = [t["content"] for t in held["added_tokens"]]
    return (held["normalizer"] or {}).get("normalizers") == _NORMALIZERS and split == wanted and rest == levels and held["model"]["type"] == "BPE" and all(re.fullmatch(r"<\|\S+", n) for n in names)


def _ids_of(parts: list[str], path: str) -> list[bytes]:
    """Ids of distinct parts as little-endian unsigned 32-bit bytes."""
    known = _KNOWN.setdefault(path, {})
    found = list(map(known.get, parts))
    if None not in found:
        return found
    new = [p for p, x in zip(parts, found, strict=True) if x is None]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    at = 0
    fresh: list[bytes] = []
    while at < len(new):
        fresh += [array("I", e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(new[at : at + 4096], add_special_tokens=False)]
        at += 4096
    known.update(zip(new, fresh, strict=True))
    rest = iter(fresh)
    return [next(rest) if x is None else x for x in found]


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin (and the last one's end).

    Where the tokenizer drops white space and never joins over it (``parts_suffice``), ids of a text are those of its parts
    between spaces; marks at a word's end are set apart and ASCII capitals lower-cased first, as the tokenizer would, so that
    there are fewer. Arrow splits the texts and numbers their distinct parts; only those are looked up, and only words never
    seen are encoded. Of any other tokenizer whole texts are encoded.
    """
    flat = pc.fill_null(texts.cast(pa.large_string()), "")
    if not parts_suffice(path):
        found = [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(flat.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
    for space in "\n\t\r":
        flat = pc.replace_substring(flat, space, " ")
    plain = pc.replace_substring_regex(pc.ascii_lower(flat), _MARKS, r"\1 \2\3")
    flat = pc.if_else(pc.match_substring_regex(flat, _WHOLE), flat, plain)
    lists = pc.split_pattern(flat, " ")
    coded = lists.flatten().dictionary_encode()
    bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    which = coded.indices.to_numpy()
    ids = _ids_of(coded.dictionary.to_pylist(), path)
    store = np.frombuffer(b"".join(ids), dtype="<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    lengths = size[which]
    ends = np.r_[0, np.cumsum(lengths)]
    place = np.repeat(begin[which] - ends[:-1], lengths) + np.arange(ends[-1])
    return store[place], ends[bounds]


def _blocks(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")) - at)
        yield at, n
        at += n


def pieces(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """``carry`` columns and start, length, ids_crc32, doc_tokens of each piece; with ``ids`` also the ids themselves."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.col(text).alias("__text"))
    schema = T.StructType(kept.schema.fields[:-1]).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType()).add("doc_tokens", T.LongType())
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in _blocks(b.column(b.num_columns - 1)):
                some = b.slice(at, n)
                found, bounds = encoded(some.column(some.num_columns - 1), path)
                rows, start, length, crc, total, held = [], [], [], [], [], []
                for i in range(n):
                    own = np.append(found[bounds[i] : bounds[i + 1]], np.uint32(end))
                    for p in range(0, len(own), window):
                        part = own[p : p + window]
                        rows.append(i)
                        start.append(p)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(own))
                        if ids:
                            held.append(part.astype(np.int32))
                cols = [c.take(pa.array(rows, pa.int64())) for c in some.columns[:-1]] + [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                if ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    small_batches(docs.sparkSession)
    return kept.mapInArrow(cut, schema)


def _closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset with the greatest sum up to ``capacity``: bitset subset sums, binary parts of the counts, traced back."""
    reach, trail, mask = 1, [], (1 << (capacity + 1)) - 1
    for size in sorted(counts, reverse=True):
        left, part = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(part, left)
            trail.append((reach, size, take))
            reach |= (reach << (size * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, size, take in reversed(trail):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + take
            at -= size * take
    return out


def fills(histogram: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """(counts of each length in a sequence, how many such sequences), until no piece is left."""
    left = {k: v for k, v in histogram.items() if v > 0}
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        fill = _closest(rest, window - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        yield fill, times
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, in each sequence, first sequence, offset of the first): pieces of a length, by rank, in sequences."""
    rows, used, first = [], dict.fromkeys(histogram, 0), 0
    for fill, times in fills(histogram, window):
        offset = 0
        for k in sorted(fill, reverse=True):
            rows.append((k, used[k], fill[k] * times, fill[k], first, offset))
            used[k] += fill[k] * times
            offset += k * fill[k]
        first += times
    return rows


def pack(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """Each piece with its sequence_id and offset there."""
    spark = docs.sparkSession
    # numbered before they are written: a later reading may split the files otherwise
    cut = written(pieces(docs, path, carry, text, window, end, ids).withColumn("__piece", F.monotonically_increasing_id()))
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("__piece"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("__salt")
    bases = counts.select("length", "__salt", (F.sum("n").over(by_length) - F.col("n")).alias("__base"))
    # at most window rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length bigint, first bigint, ranks bigint, each bigint, sequence bigint, at bigint"
    # one row for each length of each fill; a fill uses up a length at least
    table = spark.createDataFrame(plan(histogram, window), schema)
    # dealt by (length, salt) already, as the join needs it
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__piece")))
    ranked = ranked.join(bases, ["length", "__salt"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__base"))
    spread = F.broadcast(table)
    placed = ranked.join(spread, (ranked["length"] == spread["length"]) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("first") + F.col("ranks"))).drop(spread["length"])
    k = F.col("__rank") - F.col("first")
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    return placed.select(
        *names,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        *(["ids"] if ids else []),
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(docs: DataFrame) -> DataFrame:
    """``op6_packing``."""
    return pack(docs, vocabulary())

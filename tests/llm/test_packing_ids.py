"""Packing's ids against the tokenizer's own, over letters, numbers and marks of every kind."""

from __future__ import annotations

import json
import random
import unicodedata

import pyarrow as pa
import pytest

from granary.llm import packing

MARKS = '.,!?;:#$%&*|()"'


def wrong(texts: list[str], path: str | None = None) -> list[str]:
    path = path or packing.vocabulary()
    ids, at = packing.encoded(pa.array(texts), path)
    own = packing.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    return [t for i, (t, e) in enumerate(zip(texts, own, strict=True)) if list(ids[at[i] : at[i + 1]]) != e.ids]


@pytest.fixture(scope="module")
def letters() -> list[str]:
    """Every letter, number and combining mark but for the large blocks of ideographs and syllables, of which there are some."""
    many = ((0x3440, 0xA000), (0xAC40, 0xD7A4), (0x20000, 0x32000))
    points = (c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not any(a <= c < b for a, b in many))
    return [chr(c) for c in points if unicodedata.category(chr(c))[0] in "LNM"]


def test_every_letter_before_every_mark(letters):
    for mark in MARKS:
        assert wrong([f"ab {c}{mark} A{c}{mark}" for c in letters]) == []


def test_letters_that_compose(letters):
    combining = [c for c in letters if unicodedata.combining(c)]
    assert wrong([f"x {b}{c}, {b}{c}{b}." for b in "ABCHIJTWYabzİΣᄀ" for c in combining]) == []


def test_random_texts(letters):
    pick = random.Random(1)
    pool = letters + list(" \n\t\r\x0b\x0c\xa0 　'-_<>/@~`" + MARKS) * 300 + list("abcdefgHIJKTWY0123456789") * 300 + ["<|endoftext|>", "<|", "'s", "'ll"] * 100
    assert wrong(["".join(pick.choice(pool) for _ in range(pick.randint(0, 14))) for _ in range(100_000)]) == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    with open(packing.vocabulary(), encoding="utf-8") as f:
        held = json.load(f)
    held["pre_tokenizer"] = None
    held["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held), encoding="utf-8")
    assert packing.parts_suffice(packing.vocabulary()) and not packing.parts_suffice(str(path))
    assert wrong(["one two, three", "", "A b", "İ, x"], str(path)) == []

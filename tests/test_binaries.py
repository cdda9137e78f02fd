"""Sectioned binaries: the interpreter's own ELF file, and others built by hand."""

from __future__ import annotations

import struct
import sys

import pytest

from granary.functions.content import varint
from granary.sources import binaries as bn
from granary.sources import readers


def test_elf(spark, tmp_path):
    with open(sys.executable, "rb") as f:
        data = f.read()
    rows = {r[0]: r for r in bn.elf_sections(data)}
    assert rows[".text"][3] > 0 and data[rows[".shstrtab"][2] :][: rows[".shstrtab"][3]].count(b".text")
    (tmp_path / "x.elf").write_bytes(data)
    assert readers.read(spark, "elf", str(tmp_path), "*.elf").filter("name = '.text'").count() == 1
    with pytest.raises(ValueError):
        list(bn.elf_sections(b"no"))


def test_tagged():
    data = struct.pack("<HIH", 1, 3, 0) + b"abc" + struct.pack("<HIH", 2, 0, 0)
    assert list(bn.e2store(data)) == [(0, 1, 8, 3), (1, 2, 19, 0)]
    with pytest.raises(ValueError):
        list(bn.e2store(data[:9]))
    wasm = b"\0asm\1\0\0\0" + b"\1" + varint(200) + bytes(200) + b"\3" + varint(1) + b"x"
    assert [(r[1], r[3]) for r in bn.wasm_sections(wasm)] == [(1, 200), (3, 1)]
    jvm = b"\xca\xfe\xba\xbe\0\0\0\x34" + struct.pack(">H", 5) + b"\1\0\3abc" + b"\5" + bytes(8) + b"\7\0\1"
    assert [(r[0], r[1], r[3]) for r in bn.class_constants(jvm)] == [(1, 1, 5), (2, 5, 8), (4, 7, 2)]


def test_pe():
    pe = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 0, 0)
    pe += b".text\0\0\0" + struct.pack("<IIIIIIHHI", 4, 4096, 4, len(pe) + 40, 0, 0, 0, 0, 0x20) + b"code"
    assert [(r[0], r[3], pe[r[2] : r[2] + 4]) for r in bn.pe_sections(pe)] == [(".text", 4, b"code")]


def test_qcow2():
    bits = 9
    c = 1 << bits
    head = b"QFI\xfb" + struct.pack(">IQIIQIIQ", 3, 0, 0, bits, 4096, 0, 1, c)
    data = head.ljust(c, b"\0") + struct.pack(">Q", 2 * c).ljust(c, b"\0") + struct.pack(">QQQ", 3 * c, 0, 4 * c).ljust(c, b"\0") + bytes(2 * c)
    assert list(bn.qcow2_clusters(data)) == [(0, 0, 3 * c, c), (2, 0, 4 * c, c)]

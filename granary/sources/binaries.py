"""Readers of tagged and sectioned binaries: e2store, ELF, PE, WebAssembly, JVM classes, QCOW2 maps. Rows give places, so that bodies can be cut out and shared."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from granary.functions.content import read_varint
from granary.sources import readers


def e2store(data: bytes) -> Iterator[tuple]:
    """(ord, type, offset, size): records with a type of two bytes, a length of four and two reserved, little-endian."""
    at = n = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("header beyond the end")
        kind, size, reserved = struct.unpack_from("<HIH", data, at)
        if reserved or at + 8 + size > len(data):
            raise ValueError(f"record at {at}")
        yield n, kind, at + 8, size
        at += 8 + size
        n += 1


TAGGED = "ord int, type int, offset bigint, size bigint"


def elf_sections(data: bytes) -> Iterator[tuple]:
    """(name, kind, offset, size, address) of 32- and 64-bit ELF files of either byte order."""
    if data[:4] != b"\x7fELF":
        raise ValueError("no ELF header")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    at = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
    size, n, names = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
    form = order + ("IIQQQQ" if wide else "IIIIII")
    heads = [struct.unpack_from(form, data, at + i * size) for i in range(n)] if at else []
    if not heads:
        return
    table = heads[names][4]
    for name, kind, _, address, offset, length in heads:
        end = data.index(b"\0", table + name)
        held = 0 if kind == 8 else length
        if offset + held > len(data):
            raise ValueError("section beyond the end")
        yield data[table + name : end].decode(), kind, offset, held, address


def pe_sections(data: bytes) -> Iterator[tuple]:
    """(name, kind, offset, size, address) of PE files."""
    at = struct.unpack_from("<I", data, 60)[0] if data[:2] == b"MZ" else len(data)
    if data[at : at + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    n, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
    for i in range(n):
        p = at + 24 + optional + 40 * i
        name = data[p : p + 8].rstrip(b"\0").decode("latin-1")
        _, address, size, offset = struct.unpack_from("<IIII", data, p + 8)
        if offset + size > len(data):
            raise ValueError("section beyond the end")
        yield name, struct.unpack_from("<I", data, p + 36)[0], offset, size, address


SECTIONS = "name string, kind bigint, offset bigint, size bigint, address decimal(20,0)"


def wasm_sections(data: bytes) -> Iterator[tuple]:
    """(ord, type, offset, size) of a WebAssembly module, version 1."""
    if data[:8] != b"\0asm\1\0\0\0":
        raise ValueError("no module header")
    at = 8
    n = 0
    while at < len(data):
        kind = data[at]
        size, at = read_varint(data, at + 1)
        if at + size > len(data):
            raise ValueError("section beyond the end")
        yield n, kind, at, size
        at += size
        n += 1


#: Bytes after the tag of each constant; strings carry their length. Fixed values of the class file format.
_CONSTANTS = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def class_constants(data: bytes) -> Iterator[tuple]:
    """(index, tag, offset, size) of a JVM class's constant pool."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("no class header")
    n, at, i = int.from_bytes(data[8:10], "big"), 10, 1
    while i < n:
        tag = data[at]
        size = 2 + int.from_bytes(data[at + 1 : at + 3], "big") if tag == 1 else _CONSTANTS[tag]
        yield i, tag, at + 1, size
        at += 1 + size
        i += 2 if tag in (5, 6) else 1


def qcow2_clusters(data: bytes) -> Iterator[tuple]:
    """(ord, type, offset, size) of the allocated guest clusters of a QCOW2 image: type 0 plain, 1 compressed; ord is the guest cluster."""
    if data[:4] != b"QFI\xfb" or int.from_bytes(data[4:8], "big") not in (2, 3):
        raise ValueError("no QCOW2 header")
    bits, l1_size, l1 = int.from_bytes(data[20:24], "big"), int.from_bytes(data[36:40], "big"), int.from_bytes(data[40:48], "big")
    cluster, mask = 1 << bits, (1 << 56) - 512
    for i in range(l1_size):
        l2 = int.from_bytes(data[l1 + 8 * i : l1 + 8 * i + 8], "big") & mask
        if not l2:
            continue
        for j in range(cluster // 8):
            e = int.from_bytes(data[l2 + 8 * j : l2 + 8 * j + 8], "big")
            if e >> 62 & 1:
                shift = 62 - (bits - 8)
                yield i * (cluster // 8) + j, 1, e & (1 << shift) - 1, ((e & (1 << 62) - 1) >> shift) * 512 + 512
            elif e & mask:
                yield i * (cluster // 8) + j, 0, e & mask, cluster


readers.READERS |= {
    "e2store": (e2store, TAGGED),
    "elf": (elf_sections, SECTIONS),
    "pe": (pe_sections, SECTIONS),
    "wasm": (wasm_sections, TAGGED),
    "class": (class_constants, TAGGED),
    "qcow2": (qcow2_clusters, TAGGED),
}

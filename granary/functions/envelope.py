"""Delta envelopes: a COPY/ADD program over bases, with what is needed to prove its result.

Layout: magic, version, flags (1: the program is deflated), SHA-256 and length of the target, number of bases and the SHA-256 of
each, length of the program, program. An operation is a varint ``length << 1 | add``; a copy goes on with base and offset as
varints, an add with its bytes. The program is deflated where that is shorter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from granary.functions.content import delta, read_varint, varint

MAGIC, VERSION = b"GRND", 1
#: Bytes of an envelope besides its program and bases.
FIXED = len(MAGIC) + 2 + 32
Op = tuple[int, int, int, bytes | None]


def _program(ops: list[Op]) -> bytes:
    out = bytearray()
    for base, offset, n, lit in ops:
        out += varint(n << 1 | (lit is not None))
        out += lit if lit is not None else varint(base) + varint(offset)
    return bytes(out)


def _deflated(program: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(program) + z.flush()


def encode(bases: list[bytes], ops: list[Op], target: bytes) -> bytes:
    """The envelope of operations (base, offset, length, bytes or None) over the bases that they use."""
    used = sorted({b for b, _, _, lit in ops if lit is None})
    place = {b: i for i, b in enumerate(used)}
    program = _program([(place.get(b, 0), o, n, lit) for b, o, n, lit in ops])
    small = _deflated(program)
    short = len(small) < len(program)
    body = small if short else program
    refs = b"".join(hashlib.sha256(bases[b]).digest() for b in used)
    return MAGIC + bytes([VERSION, short]) + hashlib.sha256(target).digest() + varint(len(target)) + varint(len(used)) + refs + varint(len(body)) + body


def bounds(ops: list[Op], target_bytes: int) -> tuple[int, int]:
    """(least, most) bytes of the envelope without building it: the program is stored, or deflated to no less than its order-0 literals allow."""
    used = len({b for b, _, _, lit in ops if lit is None})
    raw = sum(len(varint(n << 1)) + (len(lit) if lit is not None else len(varint(b)) + len(varint(o))) for b, o, n, lit in ops)
    fixed = FIXED + len(varint(target_bytes)) + len(varint(used)) + 32 * used
    return fixed + 1, fixed + len(varint(raw)) + raw


def bases_of(envelope: bytes) -> list[bytes]:
    """SHA-256 of the bases that must be had to decode."""
    at = FIXED
    _, at = read_varint(envelope, at)
    n, at = read_varint(envelope, at)
    return [envelope[at + 32 * i : at + 32 * i + 32] for i in range(n)]


def decode(envelope: bytes, get: Callable[[bytes], bytes | None]) -> bytes:
    """The target; ``get`` gives a base by its SHA-256. Every length, place and digest is checked."""
    if envelope[: len(MAGIC)] != MAGIC or envelope[len(MAGIC)] != VERSION or envelope[len(MAGIC) + 1] > 1:
        raise ValueError("no delta envelope of this version")
    want = envelope[FIXED - 32 : FIXED]
    size, at = read_varint(envelope, FIXED)
    count, at = read_varint(envelope, at)
    bases = []
    for _ in range(count):
        digest, at = envelope[at : at + 32], at + 32
        body = get(digest)
        if body is None or hashlib.sha256(body).digest() != digest:
            raise ValueError("base missing or altered")
        bases.append(body)
    n, at = read_varint(envelope, at)
    if at + n != len(envelope):
        raise ValueError("length of the program")
    program = envelope[at:]
    if envelope[len(MAGIC) + 1]:
        z = zlib.decompressobj(-15)
        program = z.decompress(program)
        if not z.eof or z.unused_data:
            raise ValueError("deflated program")
    out, at = bytearray(), 0
    while at < len(program):
        head, at = read_varint(program, at)
        n = head >> 1
        if head & 1:
            part, at = program[at : at + n], at + n
        else:
            b, at = read_varint(program, at)
            o, at = read_varint(program, at)
            part = bases[b][o : o + n] if b < len(bases) else b""
        if len(part) != n or len(out) + n > size:
            raise ValueError("operation beyond its bytes")
        out += part
    if len(out) != size or hashlib.sha256(out).digest() != want:
        raise ValueError("result isn't the target")
    return bytes(out)


def resolved(name: bytes, envelopes: dict[bytes, bytes], stored: dict[bytes, bytes], most: int = 16) -> bytes:
    """The bytes of a digest that is stored whole or as an envelope over others, through at most ``most`` envelopes in a row."""

    def get(digest: bytes, depth: int) -> bytes | None:
        if digest in stored:
            return stored[digest]
        if digest not in envelopes:
            return None
        if depth == most:
            raise ValueError("chain of envelopes too long")
        return decode(envelopes[digest], lambda d: get(d, depth + 1))

    found = get(name, 0)
    if found is None:
        raise ValueError("not stored")
    return found


def over(base: bytes, target: bytes) -> bytes:
    """The envelope of a target over one base."""
    return encode([base], [(0, o, n, lit) for o, n, lit in delta(base, target)], target)


def windows(base: bytes, target: Iterator[bytes]) -> Iterator[bytes]:
    """Envelopes of a target that comes in windows: no more of it is held than one."""
    for part in target:
        yield over(base, part)

"""Plain Python versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def written(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


def pii(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    assign = r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def repeated_bytes(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, digest of what is left) of each text."""
    held = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in held:
        for i in range(len(b) - length + 1):
            k = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for b in held:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def pii_tokens(text: str | None) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, value, word before, overlaps a base span) of tokens that may be identifiers."""
    t, base, out, last = text or "", pii(text), [], ""
    held = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if re.search("[0-9@]", m.group())]
    at = 0
    for m in held:
        before = re.findall(r"[^\x20\x09-\x0D]+", t[max(at, m.start() - 100) : m.start()])
        word = (before[-1] if before else last)[-100:].lower()
        at, last = m.end(), m.group()
        value = re.sub(r"[^A-Za-z0-9]+\Z", "", re.sub(r"^[\"'(\[<]+", "", m.group()))
        start = m.start() + len(m.group()) - len(re.sub(r"^[\"'(\[<]+", "", m.group()))
        end = start + len(value)
        seed = any(s < end and start < e for s, _, e in base)
        like = re.fullmatch(r"[A-Za-z0-9._%+@:/-]{6,64}", value) and (len(re.sub("[^0-9]", "", value)) >= 6 or re.search("[A-Za-z0-9]@[A-Za-z0-9]", value))
        if seed or like:
            out.append((start, end, value, word, seed))
    return out


def pii_patterns(tokens: list[tuple[str, str, bool]], confidence: float = 0.9, support: int = 5, rounds: int = 10) -> set[str]:
    """Patterns that are sure, of (value, pattern, seed)."""
    edges: dict[tuple[str, str], bool] = {}
    for v, p, seed in tokens:
        if p:
            edges[p, v] = edges.get((p, v), False) or seed
    seeds: dict[str, float] = {}
    for (_, v), seed in edges.items():
        seeds[v] = max(seeds.get(v, 0.0), float(seed))
    strings, known = dict(seeds), None
    for _ in range(rounds):
        scored = {}
        for q in {p for p, _ in edges}:
            mine = [strings[v] for p, v in edges if p == q]
            scored[q] = (sum(mine) / (len(mine) + 1), sum(x >= confidence for x in mine))
        new = {q for q, (c, n) in scored.items() if n >= support and c >= confidence}
        if known is not None and len(new) == len(known):
            return new
        known = new
        for v in strings:
            doubt = 1.0
            for p, w in edges:
                if w == v and scored[p][1] >= support:
                    doubt *= 1 - min(scored[p][0], 0.999999)
            strings[v] = max(seeds[v], 1 - doubt)
    return known or set()


def pii_spans(texts: list[str | None]) -> list[str]:
    """All spans of each text, the discovered ones included."""
    held = [pii_tokens(t) for t in texts]
    sure = pii_patterns([(v, w, seed) for x in held for _, _, v, w, seed in x])
    names = ("email", "ip", "card", "phone", "context")
    return [written(pii(t) + [(s, 4, e) for s, e, _, w, seed in x if not seed and w in sure], names) for t, x in zip(texts, held, strict=True)]


def kneser_ney(texts: list[tuple[bytes, int | None]], discount: float = 2.0, shared: float = 0.75):
    """Evidence of six bytes, of texts with label 1, 0 or None: interpolated Kneser-Ney with recursive continuation counts."""
    held = [(b" " + t.lower() + b" ", y) for t, y in texts]
    six = {t[i : i + 6] for t, _ in held for i in range(len(t) - 5)}
    kinds = {n: {s[-n:] for s in six} for n in range(1, 6)} | {6: six}
    before = {n: {s: sum(1 for x in kinds[n + 1] if x[1:] == s) for s in kinds[n]} for n in range(1, 6)}

    def lower(s: bytes) -> float:
        if not s:
            return 1 / 256
        own = {x: c for x, c in before[len(s)].items() if x[:-1] == s[:-1]}
        return (max(own.get(s, 0) - shared, 0) + shared * len(own) * lower(s[1:])) / sum(own.values())

    def of_class(s: bytes, y: int) -> float:
        seen: dict[bytes, int] = {}
        for t, label in held:
            for i in range(len(t) - 5):
                if label == y and t[i : i + 5] == s[:5]:
                    seen[t[i : i + 6]] = seen.get(t[i : i + 6], 0) + 1
        n = sum(seen.values())
        if not n:
            return lower(s[1:])
        return (max(seen.get(s, 0) - discount, 0) + sum(min(c, discount) for c in seen.values()) * lower(s[1:])) / n

    return six, lambda s: math.log(of_class(s, 1)) - math.log(of_class(s, 0))


def quality_features(text: str | None) -> list[float]:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, letters, upper = sum(map(len, w)), len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    ratio = lambda a, b: a / b if b else 0.0
    return [
        math.log1p(len(w)), min(ratio(chars, len(w)), 30.0), min(ratio(len(re.findall(r"[#*$%&|<>]", t)), len(w)), 3.0), ratio(len(lines) - len(set(lines)), len(lines)),
        ratio(upper, letters), ratio(len(repeated), len(w)), math.log1p(len(lines)), ratio(letters, chars),
    ]


def site_posteriors(labelled: list[tuple]) -> tuple[dict[tuple, float], dict, float]:
    """Posteriors of (host, path) and of hosts, and the global rate, of (host, path, 0 or 1)."""

    def strength(groups: list[tuple[int, int, float]]) -> float:
        some = [(n, good, around) for n, good, around in groups if n >= 2]
        if len(some) < 2:
            return 1000.0
        ss = sum(n * (good / n - around) ** 2 for n, good, around in some)
        noise = sum(around * (1 - around) for _, _, around in some)
        between = (ss - noise) / sum(n for n, _, _ in some)
        return min(max(noise / len(some) / between - 1 if between > 0 else 1000.0, 2.0), 1000.0)

    paths: dict[tuple, list[int]] = {}
    hosts: dict = {}
    for h, p, y in labelled:
        for d, k in ((paths, (h, p)), (hosts, h)):
            d.setdefault(k, [0, 0])
            d[k][0] += 1
            d[k][1] += y
    rate = (sum(y for _, _, y in labelled) + 1) / (len(labelled) + 2)
    m = strength([(n, g, rate) for n, g in hosts.values()])
    of_host = {h: (g + m * rate) / (n + m) for h, (n, g) in hosts.items()}
    k = strength([(n, g, of_host[h]) for (h, _), (n, g) in paths.items()])
    return {x: (g + k * of_host[x[0]]) / (n + k) for x, (n, g) in paths.items()}, of_host, rate

"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def within_one(x: list[str], y: list[str]) -> bool:
    if len(x) < len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


def line_dedup(docs: list[tuple[int, str | None]], least: int = 5) -> dict[int, tuple[int, int, str]]:
    """{id: (lines, dropped, digest of what is kept)}"""
    lines = [(i, j, words(line), line) for i, text in sorted(docs) for j, line in enumerate((text or "").split("\n"))]
    seen: list[list[str]] = []
    exact: set[tuple[str, ...]] = set()
    near: dict[int, list[list[str]]] = {}
    out: dict[int, list] = {}
    for i, _, w, line in lines:
        got = out.setdefault(i, [0, 0, []])
        got[0] += 1
        gone = False
        if w:
            gone = tuple(w) in exact
            if not gone and len(w) >= least:
                gone = any(within_one(w, x) for n in (len(w) - 1, len(w), len(w) + 1) if n >= least for x in near.get(n, ()))
            if tuple(w) not in exact:
                exact.add(tuple(w))
                near.setdefault(len(w), []).append(w)
        seen.append(w)
        if gone:
            got[1] += 1
        else:
            got[2].append(line)
    return {i: (a, b, hashlib.sha256("\n".join(c).encode()).hexdigest()) for i, (a, b, c) in out.items()}


def repeated_bytes(docs: list[tuple[int, str | None]], size: int = 200) -> dict[int, tuple[int, int, int, str]]:
    """{id: (bytes, removed, spans, digest of what is kept)}: bytes of strings of `size` that start twice are removed."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    starts: dict[bytes, int] = {}
    for _, b in texts:
        for k in range(len(b) - size + 1):
            starts[b[k:k + size]] = starts.get(b[k:k + size], 0) + 1
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if starts[b[k:k + size]] > 1:
                gone[k:k + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

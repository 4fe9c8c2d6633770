"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lowered(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def in_key_order(rows):
    """Rows (doc_id, text, …) as distinct documents, NULL keys first."""
    return sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))


def repeated(units: list, window: int):
    """For each list of units, True where a window that also starts earlier covers the unit."""
    seen, out = set(), []
    for row in units:
        gone = [False] * len(row)
        for i in range(len(row) - window + 1):
            key = tuple(row[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append(gone)
    return out


def shingles(text: str | None, size: int) -> frozenset:
    words = SPACE_WORDS.findall(lowered(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows, size: int, percent: int = 80) -> dict:
    """Least key that links reach, by comparing all pairs."""
    sets = {k: shingles(t, size) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}

"""Small tables with the awkward cases: NULLs, empty and very long texts, ties, copies, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tag string, doc string, seed int"


def prose(draw: random.Random, words: int) -> str:
    return " ".join("".join(draw.choice("abcdeéß漢 ") for _ in range(draw.randint(1, 7))).strip() or "x" for _ in range(words))


def awkward(seed: int = 1):
    """Rows (doc_id, text)."""
    draw = random.Random(seed)
    passage, other = prose(draw, 60), prose(draw, 45)
    rows = [(3, None), (4, ""), (5, " \t\n "), (6, "One"), (7, "one two"), (None, passage), (9, passage), (10, passage)]
    rows += [(20 + k, f"{prose(draw, 30)} {passage} {prose(draw, 20)}") for k in range(12)]
    rows += [(40 + k, f"{prose(draw, 5)} {other} {passage if k % 2 else ''}") for k in range(8)]
    long = prose(draw, 3000)
    rows += [(60, long), (61, long.replace("a", "A", 3)), (62, " ".join(long.split(" ")[:2900])), (63, "a" * 5000), (64, "ab " * 900)]
    base = prose(draw, 120).split(" ")
    for k in range(15):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "changed%d" % draw.randint(0, 5)
        rows.append((80 + k, " ".join(words)))
    rows += [(9, passage), (20, rows[8][1]), (200, "tail " + passage[:200])]
    draw.shuffle(rows)
    return rows


def table(spark, rows, parts: int = 3):
    full = [(k, t, None, "s", len(t) if t else None, "x", "y", 1) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def same_checksum() -> tuple[str, str]:
    """Two texts of 64 words that have nothing in common but their CRC-32."""
    seen = {}
    for k in range(1_000_000):
        text = " ".join(hashlib.sha256(str(k).encode()).hexdigest())
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            return other, text
    raise AssertionError("no pair found")

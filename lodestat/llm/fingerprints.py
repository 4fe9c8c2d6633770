"""Document fingerprints from prefix polynomial hashes, modulo the prime 2**61 - 1.

With ``prefix[i] = v[0] + v[1] r + ... + v[i-1] r**(i-1)`` the hash of a span is ``(prefix[end] - prefix[start]) *
r**-start``; two different spans of at most n bytes share it for at most n of the 2**61 values of r. The prefix array of a text answers whether any two spans are equal in constant time, and the longest common
extension of two places by binary search over span lengths. A fingerprint is the hash of the whole text and a
sketch: the ``SKETCH`` least distinct hashes of its spans of ``SPAN`` bytes. The likeness of two fingerprints is
the share of common spans that their sketches estimate; it is exact for texts of few spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm import flat
from lodestat.llm.stored import doc_key, stored, whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

SPAN = 24
SKETCH = 48
_DONE, _HEAD, _OPEN = 0, 1, 2
_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]


_PRIME = (1 << 61) - 1
# A random base, and its inverse.
_BASE = 0x10B4A7C2D93E5F71
_INVERSE = pow(_BASE, -1, _PRIME)
_P, _61, _32, _31, _30 = (np.uint64(n) for n in (_PRIME, 61, 32, 31, 30))
_LOW_32, _LOW_31, _LOW_30 = (np.uint64((1 << n) - 1) for n in (32, 31, 30))

_tables: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW_31, b >> _31, b & _LOW_31
    middle = a0 * b1 + a1 * b0
    # 2**62 is 2, and 2**31 times the middle is its upper part plus the lower 30 bits moved up.
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW_30) << _31) + a0 * b0)


def _powers(n: int, base: int) -> np.ndarray:
    """The first powers of a base, doubled from those that are there."""
    have = _tables.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), _PRIME)))])
        _tables[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """The prefix array of some bytes. Sums of the halves of the terms cannot overflow below 2**31 bytes."""
    terms = times(data.astype(np.uint64) + np.uint64(1), _powers(len(data), _BASE))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    upper = _reduced(np.cumsum(terms >> _32, dtype=np.uint64))
    lower = _reduced(np.cumsum(terms & _LOW_32, dtype=np.uint64))
    prefix[1:] = _reduced(times(upper, np.full(1, 1 << 32, dtype=np.uint64)) + lower)
    return prefix


class Prefixes:
    """Prefix arrays of some texts, one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets = offsets
        self.prefix = prefix_hashes(data)

    @classmethod
    def of(cls, texts: list[str]) -> Prefixes:
        return cls(*flat.flat(pa.array(texts, type=pa.large_string())))

    def span(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of spans given by absolute start and length, scrambled one to one."""
        apart = _reduced(self.prefix[start + length] + (_P - self.prefix[start]))
        return flat.mix(times(apart, _powers(len(self.prefix), _INVERSE)[start]))

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of every span of ``size`` bytes."""
        n = max(len(self.prefix) - size, 0)
        apart = _reduced(self.prefix[size:] + (_P - self.prefix[:n]))
        return flat.mix(times(apart, _powers(n, _INVERSE)))


def common_extension(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of absolute places, the longest length up to ``most`` over which the bytes agree."""
    low, high = np.zeros(len(most), dtype=np.int64), most.astype(np.int64).copy()
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high + 1) // 2, low)
        same = a.span(i, middle) == b.span(j, middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def sketches(texts: Prefixes) -> list[np.ndarray]:
    """The least distinct span hashes, 32 bits each and in order, of each text; none for an empty one."""
    rolling = texts.rolling(SPAN) >> np.uint64(32)
    out = []
    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()):
        spans = b - a - SPAN + 1
        if spans < 1:
            short = texts.span(np.array([a]), np.array([b - a])) >> np.uint64(32)
            out.append(short if b > a else short[:0])
            continue
        hashes = rolling[a : a + spans]
        limit = np.uint64(min(1 << 32, (1 << 32) * 4 * SKETCH // spans))
        least = np.unique(hashes[hashes < limit])
        if len(least) < SKETCH and limit < np.uint64(1 << 32):
            least = np.unique(hashes)
        out.append(least[:SKETCH])
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated share of common spans, 0 to 1; 1 for two empty texts."""
    a, b = set(x.tolist()), set(y.tolist())
    if not a and not b:
        return 1.0
    either = sorted(a | b)[:SKETCH]
    return sum(1 for v in either if v in a and v in b) / len(either)


def _packed(whole: np.ndarray, sketch: list[np.ndarray]) -> list[bytes]:
    """Eight bytes of the whole text, then four of each hash of the sketch."""
    return [w.to_bytes(8, "big") + s.astype(">u4").tobytes() for w, s in zip(whole.tolist(), sketch)]


def _written(column: str):
    """A packed fingerprint as text: hexadecimal, a colon after the whole."""
    return F.lower(F.concat_ws(":", F.hex(F.substring(column, 1, 8)), F.hex(F.expr(f"substring({column}, 9)")))).alias(column)


def compared(texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """The columns of ``_RESULT`` for some texts and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts)]
    own, changed, after = Prefixes.of(texts), Prefixes.of(edited), Prefixes.of(nexts)
    sizes = [np.diff(p.offsets) for p in (own, changed, after)]
    starts = [p.offsets[:-1] for p in (own, changed, after)]
    mine, theirs, following = sketches(own), sketches(changed), sketches(after)
    return [
        pa.array([len(t) for t in texts], type=pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], type=pa.string()),
        pa.array(_packed(own.span(starts[0], sizes[0]), mine), type=pa.binary()),
        pa.array(_packed(changed.span(starts[1], sizes[1]), theirs), type=pa.binary()),
        pa.array([likeness(x, y) for x, y in zip(mine, theirs)], type=pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(mine, following)], type=pa.float64()),
        pa.array(common_extension(own, starts[0], changed, starts[1], np.minimum(sizes[0], sizes[1]))),
        pa.array(common_extension(own, starts[0], after, starts[2], np.minimum(sizes[0], sizes[2]))),
    ]


_SCHEMA = (
    "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
    "near_next double, common_edited bigint, common_next bigint"
)


def _in_order(batches):
    """Rows in descending order: each is compared with the row after it.

    The last row of a partition waits, with its text, for the first row of the next one.
    """
    waiting = None

    def row(state: int, part: pa.RecordBatch, text: str) -> pa.RecordBatch:
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), *nothing, pa.array([state], type=pa.int32()), pa.array([text], type=pa.string())],
            names=["doc_id", "doc", "tag", *_RESULT, "state", "text"],
        )

    for part, _, _ in flat.pieces(batches):
        texts = part.column(3).to_pylist()
        part = part.select([0, 1, 2])
        if waiting is None:
            yield row(_HEAD, part.slice(0, 1), texts[0])
        else:
            part = pa.concat_batches([waiting[0], part])
            texts.insert(0, waiting[1])
        n = len(texts) - 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [*part.slice(0, n).columns, *compared(texts[:-1], texts[1:]), pa.array(np.full(n, _DONE, dtype=np.int32)), pa.nulls(n, pa.string())],
                names=["doc_id", "doc", "tag", *_RESULT, "state", "text"],
            )
        waiting = part.slice(n, 1), texts[-1]
    if waiting is not None:
        yield row(_OPEN, *waiting)


def _paired(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays(
                [one.column(0), *compared(one.column(1).to_pylist(), one.column(2).to_pylist())], names=["doc_id", *_RESULT]
            )


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, and the columns of ``_RESULT``, of every document.

    The next document is that of the next smaller ``doc_id`` (NULL is the smallest; equal keys follow by the
    checksum of their texts), and after the last comes the first. The edited text has the last third of the
    characters replaced by as many, or all, first ones of the next. A NULL text is empty. ``common_edited``
    and ``common_next`` are the bytes that a text shares with the start of its edited text and of the next.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", doc_key().alias("doc"), F.xxhash64(whole_text()).alias("tag"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc").desc(), F.col("tag").desc()).sortWithinPartitions(
        F.col("doc").desc(), F.col("tag").desc()
    )
    done = stored(ordered.mapInArrow(_in_order, f"doc_id {kind}, doc bigint, tag bigint, {_SCHEMA}, state int, text string"))
    # One head and one waiting row per partition: their keys, without texts, are put in one order.
    order = Window.orderBy(F.col("doc").desc(), F.col("tag").desc())
    heads = done.where(F.col("state") == _HEAD).select("doc", "tag", F.row_number().over(order).alias("place"))
    opens = done.where(F.col("state") == _OPEN).select("doc", "tag", F.row_number().over(order).alias("place"))
    parts = F.lit(heads.count()).cast("int")
    after = heads.select(F.col("doc").alias("d"), F.col("tag").alias("t"), F.when(F.col("place") == 1, parts).otherwise(F.col("place") - 1).alias("place"))
    pairs = opens.join(after, "place").drop("place")
    own = done.where(F.col("state") == _OPEN).select("doc_id", "doc", "tag", "text")
    following = done.where(F.col("state") == _HEAD).select(F.col("doc").alias("d"), F.col("tag").alias("t"), F.col("text").alias("next"))
    last = own.join(pairs, ["doc", "tag"]).join(following, ["d", "t"]).select("doc_id", "text", "next")
    whole = done.where(F.col("state") == _DONE).select("doc_id", *_RESULT).unionByName(
        last.mapInArrow(_paired, f"doc_id {kind}, {_SCHEMA}")
    )
    return whole.select(
        "doc_id", *[_written(c) if c in ("fingerprint", "edited_fingerprint") else c for c in _RESULT]
    )

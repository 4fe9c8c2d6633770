"""Texts of an Arrow batch as flat numpy arrays, with prefix polynomial hashes over them.

A batch is taken in pieces of a quarter of a megabyte, or one text where it is longer. All arithmetic is modulo 2**64
on uint64 arrays: with ``prefix[i] = v[0] + v[1] r + ... + v[i-1] r**(i-1)`` the hash of any span is
``(prefix[end] - prefix[start]) * r**-start``, so it does not depend on where the span stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestat.session import ship_by_value

ship_by_value(__name__)

PIECE = 1 << 18
STRIP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xA24BAED4963EE407
_LOW_BITS = 22
_LOW = np.uint64((1 << _LOW_BITS) - 1)

_tables: dict[str, np.ndarray] = {}


def _byte_values() -> np.ndarray:
    """A fixed random number per byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["bytes"]


def _lower_values() -> np.ndarray:
    """The same with A-Z valued as a-z."""
    if "lower" not in _tables:
        values = _byte_values().copy()
        values[65:91] = values[97:123]
        _tables["lower"] = values
    return _tables["lower"]


def _powers(n: int, base: int, name: str) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _tables[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(len(values), _BASE, "base"), out=prefix[1:])
    return prefix


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the spans [start, stop), alike for equal spans wherever they stand."""
    inverse = _powers(len(prefix), _INVERSE, "inverse")
    lengths = (stop - start).astype(np.uint64)
    return mix((prefix[stop] - prefix[start]) * inverse[start] + lengths * np.uint64(_LENGTH))


def rolling_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every span of ``size`` units."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    inverse = _powers(len(prefix), _INVERSE, "inverse")
    out = prefix[size:] - prefix[:n]
    out *= inverse[:n]
    out += np.uint64(size * _LENGTH % (1 << 64))
    return mix(out)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; a NULL text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of successive slices of the batches, each of at most ``PIECE`` bytes or one row."""
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        begin, n = 0, batch.num_rows
        while begin < n:
            end = int(np.searchsorted(offsets, offsets[begin] + PIECE, side="right")) - 1
            end = min(max(end, begin + 1), n)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


def byte_units(data: np.ndarray) -> np.ndarray:
    return _byte_values()[data]


def _separators(kind: str) -> np.ndarray:
    """True for the bytes that separate words: white space of ASCII, or all of ASCII but letters and digits."""
    if kind not in _tables:
        codes = np.arange(256)
        if kind == "space":
            table = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        else:
            letters = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
            table = (codes < 128) & ~letters
        _tables[kind] = table
    return _tables[kind]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first): byte spans of the words, and where each text's words begin among them."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_separators(kind)[data]
    apart = np.ones(n + 1, dtype=bool)  # nothing of a word stands on both sides of these places
    apart[1:n] = ~(inside[1:] & inside[:-1])
    apart[offsets] = True
    start = np.flatnonzero(inside & apart[:n])
    stop = np.flatnonzero(inside & apart[1:]) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    prefix = prefix_hashes((_lower_values() if lower else _byte_values())[data])
    return span_hashes(prefix, start, stop)


def _least(packed: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive numbers."""
    n = len(packed) - width + 1
    short = -len(packed) % width
    padded = np.concatenate([packed, np.full(short, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(units: np.ndarray, first: np.ndarray, window: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that share an anchor, as arrays (text, start, count, place, seed hash, context hash).

    Every window of ``window`` units has one anchor, the leftmost of its seeds (``seed`` units) with the least
    hash; equal windows have equal anchors. A run is a maximal stretch of windows of one text with the same
    anchor place, here counted from the start of the run; its context is all the units that its windows cover.
    ``first`` are the places in ``units`` where the texts begin, with the end of the last.
    """
    texts = len(first) - 1
    ends = np.repeat(first[1:], np.diff(first)) if texts else first
    for begin in range(0, max(len(units) - window + 1, 0), STRIP):
        part = units[begin : begin + STRIP + window - 1]
        prefix = prefix_hashes(part)
        seeds = rolling_hashes(prefix, seed)
        packed = (seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64)
        place = (_least(packed, window - seed + 1) & _LOW).astype(np.int64)
        n = len(place)
        valid = np.arange(begin + window, begin + window + n) <= ends[begin : begin + n]
        change = np.ones(n + 1, dtype=bool)
        change[1:n] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(valid & change[:n])
        stop = np.flatnonzero(valid & change[1:]) + 1
        if not len(start):
            continue
        context = span_hashes(prefix, start, stop + window - 1)
        yield (
            np.searchsorted(first, start + begin, side="right") - 1,
            start + begin,
            stop - start,
            place[start] - start,
            seeds[place[start]],
            context,
        )


def covered(length: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True for the places of [0, length) inside any of the spans."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0

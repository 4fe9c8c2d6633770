"""Numbers drawn from texts for the classifiers, a piece of a batch at a time."""

from __future__ import annotations

import numpy as np

from lodestat.llm import flat
from lodestat.session import ship_by_value

ship_by_value(__name__)

SHAPE = (
    "log_bytes", "log_words", "letters", "digits", "spaces", "lines", "stops", "other_marks", "symbols", "upper",
    "wide", "word_length", "distinct_words", "repeated_lines", "short_lines", "line_length",
)

_kinds: dict[str, np.ndarray] = {}


def _kind_of_byte() -> np.ndarray:
    """0 letter, 1 digit, 2 space or tab, 3 line end, 4 sentence mark, 5 other mark, 6 symbol, 7 beyond ASCII."""
    if "byte" not in _kinds:
        kind = np.full(256, 6, dtype=np.int64)
        kind[[*range(65, 91), *range(97, 123)]] = 0
        kind[48:58] = 1
        kind[[9, 32]] = 2
        kind[[10, 13]] = 3
        kind[[ord(c) for c in ".,;:!?"]] = 4
        kind[[ord(c) for c in "'\"()-"]] = 5
        kind[128:] = 7
        _kinds["byte"] = kind
    return _kinds["byte"]


def _per_text(rows: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(rows, minlength=texts).astype(np.float64)


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, hashes cut to 40 bits."""
    packed = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    packed = np.unique(packed)
    return (packed >> np.uint64(40)).astype(np.int64), packed & np.uint64((1 << 40) - 1)


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``SHAPE`` per text: how it is written, not what it says. An empty text has zeros."""
    texts = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(texts), np.diff(offsets))
    kinds = _kind_of_byte()[data]
    share = np.bincount(row * 8 + kinds, minlength=8 * texts).reshape(texts, 8) / np.maximum(size, 1)[:, None]
    upper = _per_text(row[(data >= 65) & (data <= 90)], texts) / np.maximum(size, 1)
    start, stop, first = flat.word_spans(data, offsets)
    words = np.diff(first).astype(np.float64)
    hashes = flat.word_hashes(data, start, stop, lower=True)
    word_row = np.repeat(np.arange(texts), np.diff(first))
    distinct = _per_text(_distinct(word_row, hashes)[0], texts)
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets, breaks + 1]))
    line_row = np.searchsorted(offsets, bounds[:-1], side="right") - 1 if len(bounds) > 1 else np.zeros(0, dtype=np.int64)
    lines, different, short = np.zeros(texts), np.zeros(texts), np.zeros(texts)
    if len(bounds) > 1:
        ends = np.minimum(bounds[1:], len(data))
        ends = ends - (data[ends - 1] == 10)
        line_hash = flat.span_hashes(flat.prefix_hashes(flat.byte_units(data)), bounds[:-1], ends)
        lines = _per_text(line_row, texts)
        different = _per_text(_distinct(line_row, line_hash)[0], texts)
        short = _per_text(line_row[(ends - bounds[:-1]) < 20], texts)
    some = np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4],
            share[:, 5], share[:, 6], upper, share[:, 7], (size - share[:, 2] * size) / np.maximum(words, 1) / 10,
            distinct / np.maximum(words, 1), 1 - different / some, short / some, np.log1p(size / some),
        ]
    )


def vocabulary_rows(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): the distinct words of each text, A-Z in lower case, hashed into 2**bits slots."""
    start, stop, first = flat.word_spans(data, offsets, "marks")
    hashes = flat.word_hashes(data, start, stop, lower=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    packed = (row.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits))
    packed = np.unique(packed)
    return (packed >> np.uint64(bits)).astype(np.int64), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)

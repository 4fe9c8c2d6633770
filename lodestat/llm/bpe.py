"""Byte-level BPE with a queue of merge ranks in a hierarchical bitmap.

A pre-token is a linked list of parts. The bucket of a merge rank holds the places where that merge is possible;
the bitmap has a bit per rank, and a bit per word of bits above it, so the next rank is found by three
find-first-set steps however long the pre-token is. A merge pushes its two new neighbours and leaves the old
entries where they are: an entry whose place no longer has that rank is stale and skipped. The time is
O(n log n) in the length of the pre-token at most.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.stored import whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

# At most this many pre-tokens are remembered by a worker, some 250 bytes each, and none longer than this.
REMEMBERED, LONGEST = 800_000, 64


_BIT = [1 << k for k in range(64)]


class Codec:
    """Encodes texts to ids and decodes ids to bytes by a table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.numerals = [str(k) for k in range(self.size)]
        # A bit per rank, a bit per word of those, and in one number a bit per word of those in turn.
        self.low = [0] * ((self.size >> 6) + 1)
        self.middle = [0] * ((self.size >> 12) + 1)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        low, middle, high, bit = self.low, self.middle, 0, _BIT
        buckets: dict[int, list[int]] = {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = ranks.get
        possible = [find(piece[k : k + 2], -1) for k in range(n - 1)]
        possible.append(-1)
        fresh = [(rank, place) for place, rank in enumerate(possible) if rank >= 0]
        while True:
            for rank, place in fresh:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [place]
                    word = rank >> 6
                    low[word] |= bit[rank & 63]
                    middle[word >> 6] |= bit[word & 63]
                    high |= 1 << (word >> 6)
                else:
                    heappush(bucket, place)
            if not high:
                break
            # The least rank that has an entry: first set bit of each level.
            word = (high & -high).bit_length() - 1
            bits = middle[word]
            word = (word << 6) | ((bits & -bits).bit_length() - 1)
            bits = low[word]
            rank = (word << 6) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            place = heappop(bucket)  # the leftmost place of the rank
            if not bucket:
                del buckets[rank]
                low[word] ^= bit[rank & 63]
                if not low[word]:
                    middle[word >> 6] ^= bit[word & 63]
                    if not middle[word >> 6]:
                        high ^= 1 << (word >> 6)
            fresh = []
            if possible[place] != rank:
                continue  # stale
            gone = after[place]
            end = after[place] = after[gone]
            possible[gone] = -1
            if end < n:
                before[end] = place
                new = possible[place] = find(piece[place : after[end]], -1)
                if new >= 0:
                    fresh.append((new, place))
            else:
                possible[place] = -1
            left = before[place]
            if left >= 0:
                new = possible[left] = find(piece[left:end], -1)
                if new >= 0:
                    fresh.append((new, left))
        out, place = [], 0
        while place < n:
            out.append(ranks[piece[place : after[place]]])
            place = after[place]
        return out

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode()))
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _codec(ranks, path: str, pattern: str) -> Codec:
    """The codec of this worker process, kept from task to task with what it remembers.

    Functions are sent to tasks by value, so a global of this module would not outlive its task.
    """
    kept = sys.modules.setdefault("_lodestat_codecs", types.ModuleType("_lodestat_codecs")).__dict__
    name = (path, pattern)
    if kept.get("name") != name:
        kept["name"], kept["codec"] = name, Codec(ranks.value, pattern)
    return kept["codec"]


def _shared(spark: SparkSession, path: str):
    """The ranks, read once by the driver and sent to each executor once; the vocabulary bounds their size."""
    return spark.sparkContext.broadcast(read_ranks(path))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _simple(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every document; a NULL or empty text has no ids."""
    ranks = _shared(documents.sparkSession, path)

    def work(batches):
        codec = _codec(ranks, path, pattern)
        for batch in _batches(batches):
            ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    rows = documents.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(work, _simple(rows, ["doc_id"]) + ", ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of ids; NULL ids give no bytes."""
    ranks = _shared(encoded.sparkSession, path)

    def work(batches):
        codec = _codec(ranks, path, pattern)
        for batch in _batches(batches):
            out = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["doc_id", "bytes"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(work, _simple(rows, ["doc_id"]) + ", bytes binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again in one pass.

    A NULL text is an empty one: no tokens, and the digests of an empty string. Repeated rows are returned
    alike, each on its own.
    """
    ranks = _shared(documents.sparkSession, path)

    def work(batches):
        codec = _codec(ranks, path, pattern)
        sha, numerals = hashlib.sha256, codec.numerals
        for batch in _batches(batches):
            counts, ids_sha, bytes_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                counts.append(len(ids))
                ids_sha.append(sha(" ".join(map(numerals.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(sha(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(counts, dtype=np.int64)), pa.array(ids_sha), pa.array(bytes_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select("doc_id", whole_text().alias("text"))
    schema = _simple(rows, ["doc_id"]) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(work, schema)

"""BPE with word ends, encoded by dynamic programming over prefixes.

A pre-token is a string of symbols: its bytes, the last one marked as a word end. The encoding of every prefix ends in
one token and no other, so one token per prefix is all there is to store:

* an automaton over the vocabulary gives, at each symbol, the tokens that are suffixes of the prefix read so far;
* of these, the last token of the prefix is the one that is compatible with the last token of what precedes it. Two
  tokens are compatible when merging their joint symbols gives back the two, which is seen by undoing their merges
  from the latest to the earliest and looking for a merge across the border that would have come first;
* back-pointers from the whole pre-token give its ids.

The time is linear in the length of a pre-token, times the number of tokens that end at a place.

This needs merge ranks in the order of training: the parts of a merge are made by earlier merges, and no two merges
make one token. ``Vocabulary`` refuses others.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from lodestat.llm.stored import whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

# A worker remembers at most so many stretches without white space and pre-tokens, none longer than LONGEST
# characters, and so many pairs of tokens.
REMEMBERED, PAIRS, LONGEST = 600_000, 1_000_000, 64
END = "</w>"  # fixed value: the mark of a word end in vocabulary files
NEVER = 1 << 62
# White space to str.split(), but symbols to the pre-token pattern.
_NOT_SPACE = "\x1c", "\x1d", "\x1e", "\x1f"


def little(data: bytes) -> bytes:
    """32-bit numbers of this machine with the lowest byte first."""
    if sys.byteorder == "little":
        return data
    numbers = array("I", data)
    numbers.byteswap()
    return numbers.tobytes()


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, and its byte.

    Printable Latin-1 characters stand for themselves; the other bytes follow from code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary file; the file bounds its size."""

    names: list[str]  # by id
    symbols: dict[str, int]  # symbols of a token and its id, reachable tokens only
    made: list[int]  # rank of the merge that makes a token, -1 for a single symbol
    left: list[int]
    right: list[int]
    merges: dict[int, int]  # first id * size + second id → rank
    special: dict[str, int]
    pattern: str
    rules: str  # the file without its vocabulary

    @property
    def size(self) -> int:
        return len(self.names)

    def fits(self, first: int, second: int, limit: int = NEVER) -> bool:
        """True when the symbols of two tokens side by side are merged to these two before rank ``limit``."""
        made, merges, size = self.made, self.merges, self.size
        while True:
            rank = merges.get(first * size + second)
            if rank is not None and rank < limit:
                return False
            if made[first] > made[second]:  # undo the later merge; of equal ranks the right one is later
                limit = made[first]
                first = self.right[first]
            elif made[second] < 0:
                return True
            else:
                limit = made[second] + 1
                second = self.left[second]


def _rules(content: dict) -> str:
    """A tokenizer file as JSON with an empty model and no special tokens: it normalises and splits only."""
    return json.dumps(content | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary, merges, special tokens and pre-token pattern of a tokenizer file in JSON.

    The file must normalise by composed form, white space and lower case, split by one pattern and map bytes to
    letters, as the public word-level file does; anything else is refused.
    """
    with open(path, encoding="utf-8") as lines:
        content = json.load(lines)
    model = content["model"]
    steps = [n["type"] for n in content["normalizer"]["normalizers"]]
    splits = content["pre_tokenizer"]["pretokenizers"]
    if (
        steps != ["NFC", "Replace", "Lowercase"]
        or [s["type"] for s in splits] != ["Split", "ByteLevel"]
        or model.get("end_of_word_suffix") != END
        or content.get("decoder")
    ):
        raise ValueError(f"{path}: not a vocabulary of words with ends")
    ids: dict[str, int] = model["vocab"]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    names = [""] * size
    for name, key in (ids | special).items():
        names[key] = name
    made, left, right, spelt = [-1] * size, [-1] * size, [-1] * size, {}
    letters = byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    results = {a + b for a, b in pairs}
    for name, key in ids.items():
        if name not in results:
            end = name.endswith(END) and len(name) == len(END) + 1
            if len(name) != 1 and not end:
                raise ValueError(f"{path}: {name!r} is neither a symbol nor made by a merge")
            spelt[key] = chr(letters[name[0]] + (256 if end else 0))
    merges = {}
    for rank, (a, b) in enumerate(pairs):
        first, second, key = ids[a], ids[b], ids[a + b]
        if made[key] >= 0 or first not in spelt or second not in spelt:
            raise ValueError(f"{path}: merge {rank} is not in the order of training")
        made[key], left[key], right[key] = rank, first, second
        spelt[key] = spelt[first] + spelt[second]
        merges[first * size + second] = rank
    found = Vocabulary(names, {}, made, left, right, merges, special, splits[0]["pattern"]["Regex"], _rules(content))
    reachable = [True] * size
    for key in sorted(spelt, key=made.__getitem__):
        if made[key] >= 0:
            a, b = left[key], right[key]
            reachable[key] = reachable[a] and reachable[b] and found.fits(a, b, made[key])
        if reachable[key]:
            found.symbols[spelt[key]] = key
    return found


class Encoder:
    """Encodes texts to ids, and ids to the text that a tokenizer without decoder gives."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = vocabulary
        self.automaton = ahocorasick.Automaton()
        for symbols, key in vocabulary.symbols.items():
            self.automaton.add_word(symbols, (key, len(symbols)))
        self.automaton.make_automaton()
        self.length = [0] * vocabulary.size
        for symbols, key in vocabulary.symbols.items():
            self.length[key] = len(symbols)
        self.split = regex.compile(vocabulary.pattern).findall
        self.spaces = regex.compile(r"\s+").split
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pairs: dict[int, bool] = {}
        # Ids and decoded text of stretches, and of pre-tokens: those that are not plain lower-case words have a
        # line end before them, which no stretch has.
        self.known: dict[str, tuple[bytes, str]] = {}
        self.letters = byte_letters()
        self.library: Tokenizer | None = None

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        data = text.encode()
        symbols = data[:-1].decode("latin-1") + chr(256 + data[-1])
        whole = self.words.symbols.get(symbols)
        if whole is not None:
            return [whole]
        pairs, size, fits = self.pairs, self.words.size, self.words.fits
        last = [-1] * (len(symbols) + 1)  # the last token of every prefix
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                pair = before * size + token
                good = pairs.get(pair)
                if good is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    good = pairs[pair] = fits(before, token)
                if not good:
                    continue
            last[end] = token
        ids, length, at = [], self.length, len(symbols)
        while at:
            token = last[at]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def newer(self, text: str) -> list[str]:
        """Pre-tokens of a stretch with characters that Python's tables do not know yet, by the tokenizers library."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.words.rules)
        normal = self.library.normalizer.normalize_str(text)
        letters = self.letters
        return [bytes(map(letters.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def remember(self, key: str, found: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(key) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def word(self, word: str, key: str) -> tuple[bytes, str]:
        ids = self.piece(word)
        names = self.words.names
        return self.remember(key, (array("I", ids).tobytes(), " ".join([names[k] for k in ids])))

    def stretch(self, text: str) -> tuple[bytes, str]:
        """Ids (32-bit numbers) and decoded text of a stretch without white space."""
        known = self.known
        if text.isascii():
            words = text.lower()
            if words.isalpha():
                found = known.get(words) or self.word(words, words)
                return found if words is text else self.remember(text, found)
            words = self.split(words)
        elif any(unicodedata.category(c) == "Cn" for c in text):
            words = self.newer(text)
        else:
            # A capital sigma is lowered alone here, without regard to where in a word it stands.
            words = self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        data, decoded = [], []
        for word in words:
            key = word if word.isascii() and word.isalpha() else "\n" + word
            found = known.get(key) or self.word(word, key)
            data.append(found[0])
            decoded.append(found[1])
        return self.remember(text, (b"".join(data), " ".join(decoded)))

    def parts(self, text: str) -> tuple[list[bytes], list[str]]:
        """``stretch`` of every stretch and special token of a text."""
        segments = self.special.split(text) if self.special and "<|" in text else (text,)
        known, stretch = self.known, self.stretch
        found: list[tuple[bytes, str]] = []
        for place, segment in enumerate(segments):
            if place % 2:  # a special token
                found.append((array("I", [self.words.special[segment]]).tobytes(), segment))
            elif any(c in segment for c in _NOT_SPACE):
                found += [known.get(word) or stretch(word) for word in self.spaces(segment) if word]
            else:
                found += [known.get(word) or stretch(word) for word in segment.split()]
        return [f[0] for f in found], [f[1] for f in found]

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.parts(text)[0])).tolist()

    def decode(self, ids) -> str:
        """Token names, one space apart: the vocabulary has no decoder that would join them. Unknown ids are left out."""
        names = self.words.names
        return " ".join([names[k] for k in ids if 0 <= k < len(names) and names[k]])


def _encoder(vocabulary, path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task with what it remembers.

    Functions are sent to tasks by value, so a global of this module would not outlive its task.
    """
    kept = sys.modules.setdefault("_lodestat_prefix_bpe", types.ModuleType("_lodestat_prefix_bpe")).__dict__
    if kept.get("path") != path:
        kept["path"], kept["encoder"] = path, Encoder(Vocabulary(**vocabulary.value))
    return kept["encoder"]


def _shared(spark: SparkSession, path: str):
    """The vocabulary, read once by the driver and sent to each executor once; the file bounds its size."""
    return spark.sparkContext.broadcast(vars(read_vocabulary(path)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _key(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every document; a NULL or empty text, or one of white space, has no ids."""
    shared = _shared(documents.sparkSession, path)

    def work(batches):
        encoder = _encoder(shared, path)
        for batch in _slices(batches):
            ids = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = documents.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(work, _key(rows) + ", ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids; NULL ids give an empty text."""
    shared = _shared(encoded.sparkSession, path)

    def work(batches):
        encoder = _encoder(shared, path)
        for batch in _slices(batches):
            out = [encoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(work, _key(rows) + ", text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again in one pass.

    ``ids_sha256`` is over the ids as unsigned 32-bit numbers, lowest byte first; ``decoded_sha256`` over the decoded
    text in UTF-8. A NULL text is an empty one: no tokens, and the digests of nothing. Repeated rows are returned
    alike, each on its own; other columns are ignored.
    """
    shared = _shared(documents.sparkSession, path)

    def work(batches):
        encoder, sha = _encoder(shared, path), hashlib.sha256
        for batch in _slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                data, decoded = encoder.parts(text)
                ids = little(b"".join(data))
                counts.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(" ".join(decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(counts, dtype=np.int64)), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(work, _key(rows) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string")

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestat.llm import prefix_bpe
from tests.llm import brute
from tests.llm.data import awkward, table

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [
    *"aeinrstsdllveTHEInG  \n\t.,!?0123'\x00\x1c\x1f\x85\xa0éÉßñΣσςİıÅÅ漢字🙂‼̈̈́ẛ̣́ᲉꟚ՘",
    "<|endoftext|>", "<|startoftext|>", "</w>", "'ll", "the",
]


@pytest.fixture(scope="module")
def known():
    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    return prefix_bpe.Encoder(prefix_bpe.read_vocabulary(PATH)), library


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_against_the_library(known):
    encoder, library = known
    draw = random.Random(7)
    for size in (0, 1, 2, 3, 10, 100, 1000):
        for _ in range(200):
            text = "".join(draw.choice(LETTERS) for _ in range(size))
            ids = ids_of(library, text)
            assert encoder.encode(text) == ids
            assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False) == " ".join(encoder.parts(text)[1])


def test_every_letter_of_the_basic_plane(known):
    encoder, library = known
    for code in [*range(0xD800), *range(0xE000, 0x10000)]:
        text = f"a{chr(code)}b {chr(code)}"
        assert encoder.encode(text) == ids_of(library, text), hex(code)


def test_very_long_pre_tokens(known):
    encoder, library = known
    draw = random.Random(8)
    for text in ["a" * 20_000, "".join(draw.choice("etaoinshrdlu") for _ in range(20_000)), "!" * 3_333 + "?" * 3, "é" * 9_999]:
        assert encoder.encode(text) == ids_of(library, text)


def test_one_token_ends_every_prefix(known):
    """Of the tokens that end at a place, exactly one is compatible with what precedes it."""
    encoder, _ = known
    words, draw = encoder.words, random.Random(9)
    for _ in range(300):
        symbols = "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 40)))
        last = [None]
        for end in range(1, len(symbols) + 1):
            good = []
            for begin in range(end):
                token = words.symbols.get(symbols[begin:end])
                if token is not None and (begin == 0 or words.fits(last[begin], token)):
                    good.append(token)
            assert len(good) == 1
            last += good


def test_memory_that_is_full(known, monkeypatch):
    encoder, library = known
    monkeypatch.setattr(prefix_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 5)
    fresh = prefix_bpe.Encoder(encoder.words)
    text = "Some words, others and some words again: don't " * 20
    assert fresh.encode(text) == ids_of(library, text)
    assert len(fresh.known) <= 5 and len(fresh.pairs) <= 5


def test_tables(spark, known):
    rows = awkward(10) + [(300, "<|endoftext|>Don't <|startoftext|>STOP\x1c"), (301, "word " * 30_000)]
    docs = table(spark, rows)
    got = prefix_bpe.round_trip(docs, PATH).collect()
    want = []
    for key, text in rows:
        ids = ids_of(known[1], text or "")
        data = b"".join(k.to_bytes(4, "little") for k in ids)
        want.append((key, len(ids), brute.sha(data), brute.sha(known[1].decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    back = prefix_bpe.decode(prefix_bpe.encode(docs, PATH), PATH).collect()
    assert sorted(brute.sha(r.text) for r in back) == sorted(w[3] for w in want)
    assert prefix_bpe.round_trip(docs.where("false"), PATH).count() == 0
    assert prefix_bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).first().text == ""


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        prefix_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))

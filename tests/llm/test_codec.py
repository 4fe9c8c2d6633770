import random

import public_tokenizers
import pytest
import tiktoken

from lodestat.llm import bpe
from tests.llm import brute
from tests.llm.data import awkward, table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def known():
    ranks = bpe.read_ranks(PATH)
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_the_library(known):
    codec, library = known
    draw = random.Random(7)
    letters = "abcdefghij  \n\tABC'!?.,0123456789éßñ漢字🙂  \x1c"
    for size in [0, 1, 2, 5, 30, 300, 3000]:
        for _ in range(30):
            text = "".join(draw.choice(letters) for _ in range(size))
            ids = codec.encode(text)
            assert ids == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_very_long_pre_tokens(known):
    codec, library = known
    draw = random.Random(8)
    for text in ["a" * 20_000, " " * 5_000, "".join(draw.choice("etaoinshrdlu") for _ in range(20_000)), "!" * 3_333 + "?" * 3]:
        assert codec.encode(text) == library.encode_ordinary(text)


def test_bitmap_is_left_clear(known):
    codec, library = known
    draw = random.Random(9)
    for size in (2, 3, 7, 64, 65, 500):
        for _ in range(40):
            piece = bytes(draw.choice(b"aeinrst\x00\xc3\xa9 ") for _ in range(size))
            assert codec.merge(piece) == library._encode_single_piece(piece)
            assert not any(codec.low) and not any(codec.middle)


def test_round_trip_of_a_table(spark, known):
    rows = awkward(10)
    got = bpe.round_trip(table(spark, rows), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text in rows:
        ids = known[1].encode_ordinary(text or "")
        want[key, brute.sha(text or "")] = (len(ids), brute.sha(" ".join(map(str, ids))))
    for r in got:
        assert want[r.doc_id, r.decoded_sha256] == (r.n_tokens, r.ids_sha256)
    docs = table(spark, rows)
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.where("false"), PATH, PATTERN).count() == 0

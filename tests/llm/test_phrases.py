import collections
import random
import re

import numpy as np
import pytest

from lodestat.llm import phrases
from tests.llm import brute
from tests.llm.data import awkward, table


def plain(rows, least, percent=100, top=2000, longest=5):
    """Rows (text, lang) → the result, by counting every run of words in Python."""
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lowered(text)):
            found = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(found)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        cover = collections.Counter()
        for p, a in long.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        ranked = []
        for p, a in long.items():
            if 100 * cover[p] < percent * a:
                s, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [
            (lang, i + 1, p.decode(), -a, left, right, words[lang], -s)
            for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])
        ]
    return sorted(out)


def corpus(seed=3, size=220):
    draw = random.Random(seed)
    stock = ["the", "The", "of", "new", "york", "city", "Zürich", "漢字", "x\x00y", "'s", "é", "é", "a", "b"]
    rows = [(text, None if k % 5 else "fr") for k, (_, text) in enumerate(awkward(seed))]
    for k in range(size):
        words = [draw.choice(stock) + draw.choice(["", "", "", ".", ", ", "\t", "\x0b", "  ", "!?"]) for _ in range(draw.randint(0, 60))]
        rows.append((draw.choice(["", " "]).join(words[:3]) + " ".join(words[3:]), draw.choice(["en", "en", "de", None, "und", ""])))
    rows += [("new york city of the a a a a a a", "en")] * 25 + [(None, "en"), ("", None), ("only", "xx")]
    return rows


def run(spark, rows, **options):
    full = [(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, name string, n int").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_against_counting(spark):
    rows = corpus()
    got = run(spark, rows, least=12)
    assert len(got) > 60 and got == plain(rows, 12)
    assert run(spark, rows, least=12, percent=80, top=7) == plain(rows, 12, 80, 7)
    assert run(spark, rows, least=5, longest=3) == plain(rows, 5, longest=3)


def test_small_pieces_and_a_full_filter(spark, monkeypatch):
    rows = corpus(4, 60) + [("one two. " * 4000, "en"), ("one two three " * 3000, "en")]
    want = plain(rows, 10)
    monkeypatch.setattr(phrases, "PIECE", 64)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(phrases, "BITS_PER_KEY", 1 << 20)
    assert run(spark, rows, least=10) == want


def test_fingerprints_that_collide(spark, monkeypatch):
    """All words share eight hashes, so most fingerprints stand for many phrases; the text tells them apart."""
    rows, hashes = corpus(5, 120), phrases.span_hashes
    monkeypatch.setattr(phrases, "span_hashes", lambda *a: hashes(*a) & np.uint64(7))
    assert run(spark, rows, least=12) == plain(rows, 12)


def test_empty_tables(spark):
    empty = table(spark, [(1, "a")]).where("false")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(table(spark, [(1, None), (2, ""), (3, " .,\n")])).collect() == []


def test_scores_beyond_64_bits(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(200):
        a = draw.randint(100, 10**12)
        rows.append((a, draw.randint(a, 10**13), draw.randint(a, 10**13), draw.randint(10**13, 9 * 10**15)))
    got = phrases.cut_scores(spark.createDataFrame(rows, "a bigint, l bigint, r bigint, n bigint")).collect()
    assert [r.score for r in got] == [1000 * a * n // (left * right) for a, left, right, n in rows]


@pytest.mark.parametrize("texts", [["Ab aB ab", "AB  ab\tcd", "xy"]])
def test_words_alike(texts):
    data = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts])
    words = phrases.Words(np.frombuffer(data, dtype=np.uint8), ends, np.zeros(len(texts), dtype=np.int64), phrases._tables())
    number = phrases.exact_words(words)
    named = [data[a:b].lower() for a, b in zip(words.start, words.stop)]
    assert all((x == y) == (named[i] == named[j]) for i, x in enumerate(number) for j, y in enumerate(number))

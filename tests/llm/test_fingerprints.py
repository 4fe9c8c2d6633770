import random

import numpy as np

from lodestat.llm import fingerprints as fp
from tests.llm import brute
from tests.llm.data import awkward, table


def test_common_extension_by_brute_force():
    draw = random.Random(1)
    texts = ["".join(draw.choice("abß") for _ in range(draw.randint(0, 60))) for _ in range(40)]
    data = [t.encode() for t in texts]
    own = fp.Prefixes.of(texts)
    i = np.array([draw.randint(0, len(d)) for d in data])
    j = np.array([draw.randint(0, len(d)) for d in data[::-1]])
    start, other = own.offsets[:-1], own.offsets[:-1][::-1]
    most = np.minimum(np.array([len(d) for d in data]) - i, np.array([len(d) for d in data[::-1]]) - j)
    got = fp.common_extension(own, start + i, own, other + j, most)
    for a, b, x, y, n in zip(data, data[::-1], i, j, got):
        want = 0
        while x + want < len(a) and y + want < len(b) and a[x + want] == b[y + want]:
            want += 1
        assert want == n


def test_arithmetic_modulo_the_prime():
    draw = random.Random(4)
    p = (1 << 61) - 1
    a = [0, 1, p - 1, p - 1, (1 << 31) - 1, 1 << 60] + [draw.randrange(p) for _ in range(500)]
    b = [p - 1, p - 1, p - 1, 1, 1 << 31, p - 2] + [draw.randrange(p) for _ in range(500)]
    got = fp.times(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
    assert got.tolist() == [x * y % p for x, y in zip(a, b)]
    data = draw.randbytes(3_000)
    want, power = [0], 1
    for byte in data:
        want.append((want[-1] + (byte + 1) * power) % p)
        power = power * fp._BASE % p
    assert fp.prefix_hashes(np.frombuffer(data, dtype=np.uint8)).tolist() == want


def test_texts_that_differ_everywhere_yet_repeat_alike():
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    own, other = fp.Prefixes.of([one]), fp.Prefixes.of([two])
    start, whole = np.array([0]), np.array([4096])
    assert own.span(start, whole)[0] != other.span(start, whole)[0]
    assert fp.common_extension(own, start, other, start, whole)[0] == 0
    assert fp.common_extension(own, start, own, start, whole)[0] == 4096


def _spans(text: str) -> set[bytes]:
    data = text.encode()
    return {data[i : i + fp.SPAN] for i in range(len(data) - fp.SPAN + 1)} or {data} - {b""}


def test_likeness_of_short_texts_is_the_share_of_common_spans(spark):
    draw = random.Random(9)
    base = "".join(draw.choice("abcdefgh") for _ in range(70))
    rows = [(k, base[: draw.randint(0, 70)] if k % 2 else base[k : k + 40]) for k in range(20)]
    texts = dict(rows)
    for r in fp.fingerprints(table(spark, rows)).collect():
        own, after = texts[r.doc_id], texts[(r.doc_id - 1) % 20]
        n = len(own) // 3
        for got, other in ((r.near_next, after), (r.near_edited, own[: len(own) - n] + after[:n])):
            a, b = _spans(own), _spans(other)
            if len(a | b) <= fp.SKETCH:
                assert got == (len(a & b) / len(a | b) if a | b else 1.0), r.doc_id


def test_against_plain_rules(spark):
    rows = awkward(6)
    found = fp.fingerprints(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_key = {}
    for key, text in rows:
        by_key.setdefault(key, set()).add(text or "")
    keys = sorted(by_key, key=lambda k: (k is not None, k or 0), reverse=True)
    one = {k: next(iter(t)) for k, t in by_key.items() if len(t) == 1}
    copies = {k: sum(1 for key, _ in rows if key == k) for k in keys}
    prints = {}
    for r in found:
        text = one[r.doc_id]
        assert r.n_chars == len(text)
        place = keys.index(r.doc_id)
        nexts = {one[keys[(place + 1) % len(keys)]]} | ({text} if copies[r.doc_id] > 1 else set())
        n = len(text) // 3
        assert r.edited_sha256 in {brute.sha(text[: len(text) - n] + t[:n]) for t in nexts}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_likeness_follows_common_spans(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[0]), (6, texts[0])]
    for r in fp.fingerprints(table(spark, rows, 1)).collect():
        assert 0.3 < r.near_edited < 0.75 or r.doc_id == 7
        if r.doc_id == 7:
            assert r.near_next == 1.0
        elif r.doc_id != 6 and r.doc_id != 0:
            assert r.near_next < 0.1


def test_one_and_no_document(spark):
    (r,) = fp.fingerprints(table(spark, [(1, "abcdef")])).collect()
    assert r.edited_sha256 == brute.sha("abcdab") and r.near_next == 1.0
    assert fp.fingerprints(table(spark, [(1, "a")]).where("false")).count() == 0

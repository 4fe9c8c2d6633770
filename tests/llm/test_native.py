from lodestat.llm import decontaminate, sharding
from tests.llm import brute
from tests.llm.data import awkward, same_checksum, table
import zlib


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_contamination_against_brute_force(spark):
    rows = awkward(11)
    passage = next(t for k, t in rows if k == 10)
    items = [(1, passage), (12, "One"), (2, None), (3, ""), (4, "!!"), (5, passage.upper()), (None, "two"), (6, "a b c d e f g h i j k")]
    windows = {}
    for key, text in items:
        words = brute.PLAIN_WORDS.findall(brute.lowered(text))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(key)
    found = decontaminate.contamination(table(spark, rows), _items(spark, items)).collect()
    assert len(found) == len(rows)
    texts = {}
    for key, text in rows:
        texts.setdefault(key, set()).add(text or "")
    for r in found:
        (text,) = texts[r.doc_id]
        words = brute.PLAIN_WORDS.findall(brute.lowered(text))
        hit, ids = set(), set()
        for window, keys in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids |= {str(k) for k in keys if k is not None}
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            len(words), len(hit), len(ids), brute.sha(",".join(sorted(ids))), bool(hit)
        ), r.doc_id


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    rows = awkward(12)
    items = _items(spark, [(k, t) for k, t in rows if k in (10, 60, 6)])
    want = sorted(map(str, decontaminate.contamination(table(spark, rows), items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontaminate.contamination(table(spark, rows), items).collect())) == want


def test_clean_documents_and_empty_tables(spark):
    docs = table(spark, awkward(11))
    items = _items(spark, [(1, "one two")])
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert 7 not in {r.doc_id for r in clean.collect()} and clean.count() == docs.count() - 1
    none = items.where("false")
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    assert not decontaminate.contamination(docs, none).where("contaminated").count()
    assert decontaminate.contamination(docs.where("false"), items).count() == 0


def test_texts_without_id_and_with_one_checksum_stay_apart(spark):
    one, two = same_checksum()
    docs = table(spark, [(None, one), (None, two)])
    found = decontaminate.contamination(docs, _items(spark, [(1, one)])).collect()
    assert sorted((r.n_hit, r.contaminated) for r in found) == [(0, False), (64, True)]
    (kept,) = decontaminate.clean_documents(docs, _items(spark, [(1, one)])).collect()
    assert kept.text == two


def test_shards_where_a_third_has_no_key(spark):
    rows = [(k if k % 3 else None, f"{k} " + "x" * (k * 37 % 500)) for k in range(6000)]
    load = dict.fromkeys(range(16), 0)
    for r in sharding.shard_documents(table(spark, rows)).collect():
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 600


def test_shards(spark):
    rows = [(k, "x" * (k * 37 % 500)) for k in range(3000)] + [(None, None), (None, ""), (7, "x"), (7, "x")]
    found = sharding.shard_documents(table(spark, rows)).collect()
    assert len(found) == len(rows)
    load, places = {}, {}
    for r in found:
        load[r.shard] = load.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(load) == list(range(16)) and max(load.values()) - min(load.values()) < 500
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    known = {(k, zlib.crc32((t or "").encode())) for k, t in rows}
    assert {(r.doc_id, r.text_crc32) for r in found} == known
    assert sharding.shard_documents(table(spark, rows).where("false")).count() == 0


def test_map_versions_change_little():
    sizes = {slot: 1 + slot * 7919 % 100 for slot in range(4096)}
    sizes[5] = 9_000
    first = sharding.first_map(16)
    second = sharding.rebalanced(first, sizes, 16)
    load = [sum(s for slot, s in sizes.items() if second[slot] == k) for k in range(16)]
    assert max(load) - min(load) <= 100
    assert sum(a != b for a, b in zip(first, second)) < 2000
    uneven = sharding.rebalanced(first, sizes | {5: 90_000}, 16)
    rest = sorted(sum(s for slot, s in sizes.items() if uneven[slot] == k) for k in range(16) if k != uneven[5])
    assert rest[-1] - rest[0] <= 100
    third = sharding.grown(second, sizes, 16)
    assert all(a == b or b == 16 for a, b in zip(second, third))
    taken = sum(s for slot, s in sizes.items() if third[slot] == 16)
    assert 0 < taken <= sum(sizes.values()) / 17

import public_tokenizers
import tiktoken

import corpus_pipeline
from lodestat.llm import bpe
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, texts = docs.columns, None
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        if name != "byte_bpe":
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert {labels[k] for k in before if k not in texts and k in labels} <= {0}
            assert {labels[k] for k in texts if k in labels} == {1}
        if name == "minhash_near_dedup":
            roots = brute.components(before.items(), 5)
            assert texts == {k: t for k, t in before.items() if roots[k] == k}
        if name == "substring_dedup":
            rows = brute.in_key_order(before.items())
            words = [brute.SPACE_WORDS.findall(t) for _, t in rows]
            for (key, text), w, gone in zip(rows, words, brute.repeated(words, 20)):
                assert texts[key] == (" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text)
        if name == "benchmark_decontamination":
            windows = set()
            for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
                w = brute.PLAIN_WORDS.findall(brute.lowered(r.text))
                windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1 if w else 0))}
            sizes = {len(w) for w in windows}

            def leaks(text):
                w = brute.PLAIN_WORDS.findall(brute.lowered(text))
                return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

            assert texts == {k: t for k, t in before.items() if not leaks(t)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    )
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])

"""The corpus pipeline on odd and empty tables: each stage against what it takes."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import near_dedup, secrets, toxicity
from tests.llm.test_corpus_ops import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(spark, folder, docs, labels):
    docs.select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def stages(spark, sf_dir, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        yield name, docs, after
        docs = after


def test_stages(spark, odd, tmp_path):
    labels = [(i, 1, int(i % 7 == 0)) for i in range(80)]
    sf_dir = written(spark, tmp_path / "in", odd, labels)
    seen = {}
    for name, before, after in stages(spark, sf_dir, tmp_path / "out"):
        seen[name] = (before.collect(), after.collect())
        if name != "encoding":
            assert after.columns == COLUMNS
    key = lambda r: tuple(map(repr, r))
    given, kept = seen["toxicity"]
    model = toxicity.train(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = toxicity.scores(model, [(r["text"] or "").encode() for r in given], model.table())
    assert sorted(map(key, kept)) == sorted(key(r) for r, s in zip(given, scores, strict=True) if s < 0.5)
    given, kept = seen["near copies"]
    want = components(sorted({r["doc_id"]: r["text"] for r in given if r["doc_id"] is not None}.items()))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i in want if want[i] == i)
    given, kept = seen["secrets"]
    assert Counter((r["doc_id"], r["lang"], r["source"]) for r in given) == Counter((r["doc_id"], r["lang"], r["source"]) for r in kept)
    plain = {r["doc_id"]: r["text"] for r in given if r["doc_id"] is not None}
    for r in kept:
        if r["doc_id"] is not None and r["text"] != plain[r["doc_id"]]:
            assert "[secret]" in r["text"] and r["n_chars"] == len(r["text"])
    given, kept = seen["mixing"]
    assert {key(r) for r in kept} <= {key(r) for r in given} and all(n <= 2 for n in Counter(r["doc_id"] for r in kept).values())
    given, kept = seen["encoding"]
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {r["doc_id"]: r["text"] or "" for r in given}
    assert len(kept) == len(given)
    for r in kept:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(key, run.collect())) == sorted(map(key, kept))


def test_empty_tables(spark, none, tmp_path):
    sf_dir = written(spark, tmp_path, none, [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    assert secrets.scan_secrets(none).count() == near_dedup.near_duplicates(none).count() == 0

"""The pipeline's stages, each held against a plain computation on its own input."""

import random

import pytest

import corpus_pipeline
from bookloom.llm.chunk_tokens import ChunkTokenizer
from bookloom.llm.decontaminate import shingles
from bookloom.llm.quality import score
from bookloom.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.test_sharding_packing import PATH, verify
from tests.llm.test_text_dedup import brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice(["the", "in", "er", "on", "ti", "ha", "è"]) for _ in range(rng.randint(1, 4))) for _ in range(700)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(30) for _ in range(5)]
    shared = [line(12) for _ in range(3)]
    docs, labels = {}, []
    for i in range(260):
        text = [line(rng.randint(8, 40)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            text.append(rng.choice(shared))
        low, toxic = rng.random() < 0.15, rng.random() < 0.12
        if rng.random() < 0.08:
            text.insert(0, rng.choice(items))
        body = "\n".join(text)
        if toxic:
            body = body.replace(" ", " idiot ", 3)
        elif low:
            body = " ".join(w.upper() + "!!" for w in body.split())
        elif docs and rng.random() < 0.2:
            body = docs[rng.choice(list(docs))] + rng.choice(["", " again"])
        docs[i] = body
        labels.append((i, int(not low or toxic), int(toxic)))
    docs |= {900: None, 901: ""}
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[::2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_order(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_copies", "decontamination", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = [r.asDict() for r in out.collect()]
        if name == "quality":
            verdict = score(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()
            assert {r["doc_id"] for r in rows} == {r.doc_id for r in verdict if r.keep} and len(rows) < len(texts)
        elif name == "line_dedup":
            want = {i: "\n".join(x) for i, x in brute_lines(texts).items()}
            assert {r["doc_id"]: r["text"] or "" for r in rows} == want
        elif name == "near_copies":
            sets = {i: shingles(t or "", 5) for i, t in texts.items()}
            kept = {r["doc_id"] for r in rows}
            near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert not [(a, b) for a in kept for b in kept if a < b and near(a, b)]
            assert all(any(near(a, b) for b in sets if b < a) for a in set(texts) - kept)
        elif name == "decontamination":
            found = {i for i, t in texts.items() if any(len(shingles(x, 5) & shingles(t or "", 5)) >= 0.8 * len(shingles(x, 5)) for x in items)}
            assert {r["doc_id"] for r in rows} == set(texts) - found and found
        else:
            verify(rows, {i: t or "" for i, t in texts.items()}, ChunkTokenizer(PATH).encode, 1 << 16)
        docs, texts = out, {r["doc_id"]: r.get("text") for r in rows}


def test_run_applies_all_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 50


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)

"""The stages of the pipeline against plain versions, each on what the one before it kept."""

import random
import zlib

import numpy as np
import plain
import pytest

import corpus_pipeline
from redactory.llm import queries

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    rng = random.Random(9)
    bad = ("vile", "rotten", "nasty")
    rows = {d: t for d, t in corpus if d is not None and d != 306}
    toxic = {}
    for i in range(1000, 1240):
        words = ["".join(rng.choice("klmnopq") for _ in range(4)) for _ in range(rng.choice((12, 60)))]
        toxic[i] = int(i % 3 == 0)
        if toxic[i]:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows[i] = " ".join(words)
    path = tmp_path_factory.mktemp("sf")
    docs = [(d, t, "en", "src", len(t or "")) for d, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(path / "documents.parquet"))
    clean = [(d, 0) for d in rows if d < 1000][::2]
    spark.createDataFrame([*toxic.items(), *clean], "doc_id long, toxic int").selectExpr(
        "doc_id", "1 AS quality", "toxic").write.parquet(str(path / "labels.parquet"))
    return str(path), {d for d, t in toxic.items() if t}


def test_stages(spark, folder, tmp_path):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    kept = pairs(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == COLUMNS
            now = pairs(docs)
            assert all(r.n_chars == len(r.text) and r.lang == "en" for r in docs.collect())
        if name == "toxicity":
            assert {d for d, _ in kept} - {d for d, _ in now} == toxic
            assert now == [(d, t or "") for d, t in kept if d not in toxic]
        elif name == "line_dedup":
            assert now == sorted((d, text) for d, _, _, text in plain.without_lines(kept))
        elif name == "jaccard_join":
            root = {d: r for d, _, r in plain.jaccard_components(kept, 80, 5)}
            assert now == [(d, t) for d, t in kept if root[d] == d] and len(now) < len(kept)
        elif name == "substring_dedup":
            wanted = {d: (gone, text) for d, _, gone, text in plain.without_passages(kept)}
            assert now == [(d, wanted[d][1] if wanted[d][0] else t) for d, t in kept]
            assert any(gone for gone, _ in wanted.values())
        else:
            library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
            ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in kept}
            got = docs.collect()
            assert {r.doc_id: r.doc_tokens for r in got} == {d: len(i) for d, i in ids.items()}
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4").tobytes())
                       for r in got)
        kept = now


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0

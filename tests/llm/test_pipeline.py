"""The pipeline's stages, each on its own input."""

import os
import random
import zlib

import pytest

import corpus_pipeline as pipeline
from tidemark.llm import quality
from tidemark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _text(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_near_duplicates_leave_one(spark):
    rng = random.Random(1)
    a, b = _text(rng), _text(rng)
    near = a.split()
    near[60] = "other"
    out = pipeline.near_duplicate_stage(spark, _docs(spark, [(5, a), (2, a), (7, " ".join(near)), (9, b), (9, b), (None, b), (11, None), (12, "")]), DATA)
    assert out.columns == list(pipeline.COLUMNS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 9), (False, 11), (True, 0)]


def test_near_duplicates_keep_texts_whose_ids_clash(spark):
    rng = random.Random(3)
    a, b, c = _text(rng), _text(rng), _text(rng)
    rows = [(5, a), (5, b), (5, b), (3, c), (5, c), (None, a), (None, a), (None, None), (None, None)]
    out = pipeline.near_duplicate_stage(spark, _docs(spark, rows), DATA)
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(5, a), (5, b), (3, c), (None, a), (None, None)]))


def test_repeated_passages_go(spark):
    rng = random.Random(2)
    passage, own = _text(rng, 60), _text(rng, 20)
    rows = [(1, passage), (2, own + " é" + passage), (3, passage), (4, None), (5, "short"), (None, passage)]
    out = pipeline.repeated_passage_stage(spark, _docs(spark, rows), DATA)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == list(pipeline.COLUMNS)
    assert got == {1: passage, 2: own + " é", 4: "", 5: "short", None: passage}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_quality_stage_by_brute_force(spark):
    """Documents kept, against the model applied to one text after the other."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    rows = docs.collect()
    scores = {r.doc_id: float(model.score(quality.terms((r.text or "").encode())[None])[0]) for r in rows}
    kept = pipeline.quality_stage(spark, docs, DATA)
    assert kept.columns == list(pipeline.COLUMNS)
    got = {tuple(r) for r in kept.collect()}
    assert got == {tuple(r[c] for c in pipeline.COLUMNS) for r in rows if scores[r.doc_id] >= pipeline.THRESHOLD}
    assert 0 < len(got) < len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_packing_stage_by_brute_force(spark):
    """Every id of every document, told by the library, in one place of one sequence."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in docs.collect()}
    pieces, places = {}, {}
    for p in pipeline.packing_stage(spark, docs, DATA).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        assert [a for a, _ in sorted(own)] + [len(ids[d])] == [0, *(a + n for a, n in sorted(own))]
    for own in places.values():
        total = sum(n for _, n in own)
        assert [a for a, _ in sorted(own)] + [total] == [0, *(a + n for a, n in sorted(own))] and total <= 2048 and total & (total - 1) == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = {r.doc_id for r in pipeline.quality_stage(spark, docs, DATA).select("doc_id").collect()}
    told = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum((d in good) == bool(labels[d]) for d in told) >= 0.9 * len(told)
    pieces = pipeline.run(spark, DATA).collect()
    assert {p.doc_id for p in pieces} <= good
    assert len(pipeline.STAGES) == 4 and pipeline.ORACLE_SQL is None


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) < set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found))

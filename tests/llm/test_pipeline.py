"""The pipeline on a small fixture, stage by stage against plain Python."""

import zlib

import corpus_pipeline
import pytest

from tests.llm.test_jaccard_join import brute
from textloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    words = {"en": "the cat sat on a warm mat and looked at every bird".split(), "de": "der hund und die katze schlafen auf einem alten sofa".split()}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        own = [words[lang][(i * 7 + j * (1 + i % 5)) % len(words[lang])] + ("" if j % 3 else str(chr(97 + (i + j) % 26))) for j in range(40)]
        rows.append((i, " ".join(own + (["vile", "scum", "fool"] if i % 8 == 0 else [])), lang, "s", 1))
    rows += [(500, rows[3][1].upper(), "de", "s", 1), (501, rows[5][1] + " end", "de", "s", 1), (502, "1234 ?!", "en", "s", 1), (503, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    expected = {
        "toxicity": lambda own: {d for d in own if d >= 160 or d % 8},
        "language_id": lambda own: own - {502, 503},
        "exact_dedup": lambda own: {max(e for e in own if texts[e].lower() == texts[d].lower()) for d in own},
        "jaccard_join": lambda own: {c for _, _, c in brute([(d, texts[d]) for d in own])},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in table(spark, sf_dir, "documents").schema]
        left = expected[name](left)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == left
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_folds_are_crc32(spark):
    from textloom.llm.language_id import in_fold

    for r in spark.range(50).select("id", in_fold("id", 5, 0).alias("f")).collect():
        assert r.f == (zlib.crc32(str(r.id).encode()) % 5 == 0)


def test_last_stage_against_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").limit(30)
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()
    for r in docs.collect():
        ids = encoder.encode(r.text or "", add_special_tokens=False).ids + [1]
        own = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length])) for p in own)


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    """Repeated rows, null ids, repeated ids with different texts, clashing names; and an empty table."""
    docs = table(spark, sf_dir, "documents").filter("doc_id < 20 AND doc_id % 8 <> 0")
    a, b = (docs.filter(f"doc_id = {i}") for i in (3, 5))
    from pyspark.sql import functions as F

    odd = docs.unionByName(docs).unionByName(a.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(b.withColumn("doc_id", F.lit(3).cast("long")))
    for name in ("_text", "marker", "_digest", "score", "predicted"):
        odd = odd.withColumn(name, F.lit(1))
    path = str(tmp_path / "odd")
    odd.write.parquet(path)
    now = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == odd.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    texts = {r.text for r in docs.collect()}
    kept = [r.text for r in now.collect()]
    assert sorted(kept) == sorted(texts)  # each text once, those of repeated ids as well
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name

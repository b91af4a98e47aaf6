"""The pipeline's stages against plain versions, one by one and together."""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import simjoin
from logweir.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import SF, plain_components, plain_hits, plain_secrets


def by_name(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(1).select((F.col("doc_id") - 1000).alias("doc_id"), F.lit("?! 12").alias("text"), "lang", "source", "n_chars")
    docs = docs.union(more)
    at = by_name("language ID")(spark, docs, SF)
    assert at.columns == docs.columns and at.filter("text = '?! 12'").count() == 0 and at.count() == docs.count() - 1

    rows = [(r.doc_id, r.text) for r in at.collect()]
    parts = plain_components(rows, 5, 80, 100)
    at = by_name("n-gram Jaccard join")(spark, at, SF)
    assert sorted(r.doc_id for r in at.collect()) == sorted({c for _, c in parts.values()})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in at.collect()}
    kept = {i for i, t in rows.items() for n, hit, _ in [plain_hits(t, items)] if not (hit and 20 * hit >= n)}
    at = by_name("benchmark decontamination")(spark, at, SF)
    assert {r.doc_id for r in at.collect()} == kept

    at = by_name("secret scans")(spark, at, SF)
    assert at.columns == docs.columns and at.count() == len(kept)
    for r in at.collect():
        assert not plain_secrets(r.text) and r.n_chars == len(r.text)
        if not plain_secrets(rows[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == rows[r.doc_id]

    packed = by_name("packing")(spark, at, SF).collect()
    assert {r.doc_id for r in packed} == kept
    assert max(Counter({r.sequence_id: r.offset + r.length for r in packed}).values()) <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_written_sends_small_batches(spark):
    from logweir.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    held = spark.conf.get(common.BATCH_LIMIT)
    df = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text")).mapInArrow(sizes, "rows long, bytes long")
    got = common.written(df, "sizes").collect()
    assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_LIMIT) == held


def test_join_leaves_no_tables_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logweir.llm.common.shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"{'a b c d e f g h i j k l m n o p ' * 3}{i // 3}", "en") for i in range(9)] + [(9, None, "en"), (10, "x", "de")], "doc_id long, text string, lang string")
    kept = simjoin.keep_one(docs)
    assert sorted(x.name.split("-")[0] for x in tmp_path.iterdir()) == ["copies", "rows"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100).values()})
    found = simjoin.jaccard_components(docs)
    assert len([x for x in tmp_path.iterdir() if x.name.startswith("classes-")]) == 1 and found.count() == 11

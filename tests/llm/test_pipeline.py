import hashlib
import os
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from recontact.llm import queries

from conftest_paths import tokenizer
from test_chosenpath import brute as brute_groups
from test_packing import check
from test_secrets import base as brute_spans
from test_substrings import brute as brute_windows


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "secrets", "packing"]


def test_each_stage_against_brute_force(spark, documents, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == documents.columns
        seen.append((docs.collect(), now.collect()))
        docs = now
    (all_docs, known), (_, unique), (_, cut), (_, clean) = seen
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    gone = {r.doc_id for r in all_docs} - {r.doc_id for r in known}
    assert not gone & good and all(any(c.isalpha() for c in r.text) for r in known)
    groups = brute_groups([(r.doc_id, r.text) for r in known])
    assert {r.doc_id for r in unique} == {c for _, c, _ in groups.values()}
    expected = dict(zip([r.doc_id for r in unique], brute_windows([r.text for r in unique], 35), strict=True))
    for r in cut:
        words = r.text.encode().split()
        assert len(words) == expected[r.doc_id][0] - expected[r.doc_id][1]
        assert hashlib.sha256(b" ".join(words)).hexdigest() == expected[r.doc_id][2] and r.n_chars == len(r.text)
    before = {r.doc_id: r.text for r in cut}
    for r in clean:
        assert ("[secret]" in r.text) == (r.text != before[r.doc_id])
        assert r.text != before[r.doc_id] or not brute_spans(r.text)
    check(spark, docs, 1024)


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == odd.columns
    rows = docs.collect()
    assert {r.doc_id for r in rows} == {None, 4, 5, 7}
    # Columns called like inner ones pass with their values.
    own = {r.doc_id: (r.n_words, r.piece, r.failed) for r in odd.collect() if r.text}
    assert {r.doc_id: (r.n_words, r.piece, r.failed) for r in rows} == {r.doc_id: own[r.doc_id] for r in rows}
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), "").collect() == []
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_columns_with_inner_names_keep_their_values(spark, documents, tmp_path):
    inner = ["n_words", "n_removed", "kept_sha256", "_row", "_secrets", "_lang_found", "_lang_score", "_c4", "row", "measures", "group_row"]
    docs = documents.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in inner]).drop("source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before.columns
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in inner)


def test_stages_leave_no_tables_but_those_that_are_read(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text", "lang")
    lazy = corpus_pipeline.identify_language(spark, docs, "")
    made = list(corpus_pipeline._left)
    assert made
    unread = corpus_pipeline.drop_near_duplicates(spark, lazy, "")
    unread.write.parquet(f"{tmp_path}/a")
    corpus_pipeline.redact_secrets(spark, spark.read.parquet(f"{tmp_path}/a"), "").write.parquet(f"{tmp_path}/b")
    assert not set(made) & set(corpus_pipeline._left) and not any(os.path.exists(p.removeprefix("file:")) for p in made)


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_registered_once_each():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and Path(tokenizer("byte_bpe_50k.json")).exists()

"""Numbers given to rows hold when later jobs split the same files otherwise."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recontact.llm import chosenpath, common, lmscore, warc

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def resplit(spark, monkeypatch):
    """After every written stage the files are split in another way."""
    old, write, turns = spark.conf.get(SPLIT), common.staged, []

    def staged(frame, name):
        out = write(frame, name)
        turns.append(name)
        spark.conf.set(SPLIT, "64k" if len(turns) % 2 else "128m")
        return out

    for module in (common, chosenpath, lmscore, corpus_pipeline):
        monkeypatch.setattr(module, "staged", staged)
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    spark.conf.set(SPLIT, "128m")
    yield
    spark.conf.set(SPLIT, old)
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.fixture
def files(spark, tmp_path):
    """Eight files of unlike sizes; every third text is a copy."""
    rows = [(i, " ".join(f"w{(i if i % 3 else 0)}x{j}" for j in range(8 + 10 * (i % 7)) if i % 3 or j < 8), "en") for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartitionByRange(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_join(files, resplit):
    rows = chosenpath.with_keys(chosenpath.join(files)).collect()
    expected = {i: i if i % 3 else 0 for i in range(80)}
    assert {r.doc_id: r.copy_id for r in rows} == expected and len(rows) == 80


def test_pipeline_stage(spark, files, resplit):
    kept = corpus_pipeline.drop_near_duplicates(spark, files, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, *(i for i in range(80) if i % 3)]
    assert len({r.text for r in kept}) == len(kept)


def test_scores(files, resplit):
    rows = lmscore.score(files, "doc_id < 60").collect()
    assert len(rows) == 80 and all(r.held_out == (r.doc_id >= 60) for r in rows)
    words = {r.doc_id: r.n for r in files.select("doc_id", F.size(common.words_of(F.col("text"))).alias("n")).collect()}
    assert all(r.n_tokens == words[r.doc_id] + 1 for r in rows)


def test_archive(spark, files, resplit, tmp_path, monkeypatch):
    # The frame is split anew between the job that writes the headers and the one that writes the payloads.
    pages = files.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.repeat("text", 9).alias("html"))
    pages = pages.unionAll(pages.where("page_id < 20")).unionAll(pages.select(F.lit(None).cast("long"), "url", "html"))
    pages.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    write = type(pages.write).parquet

    def parquet(self, path, *rest, **more):
        write(self, path, *rest, **more)
        spark.conf.set(SPLIT, "64k" if path.endswith("headers") else "128m")

    monkeypatch.setattr(type(pages.write), "parquet", parquet)
    assert warc.archive(pages).count() == pages.count() == 180
    folder = f"{tmp_path}/store"
    spark.conf.set(SPLIT, "128m")
    warc.store(pages, folder)
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{folder}/payloads").collect()]
    assert len(stored) == len(set(stored)) and set(stored) == {bytes(r.html, "utf-8") for r in pages.select("html").collect()}

"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.llm import chosenpath, langid, packing, secret_scan, substrings
from recontact.llm.common import numbered, prepare, staged, table
from recontact.llm.queries import tokenizer_path
from recontact.session import recorded_stages, remove_stages

#: A document is rejected where no language is found or none has the larger part of the posterior.
LEAST_SCORE = 0.5
CAPACITY, END_ID = 1024, 2
#: Columns that stages read or change; all others pass by place, whatever their names.
USED = ("doc_id", "text", "lang", "n_chars")


#: Tables that earlier stages wrote for themselves. A stage's result is written and read again before the next one starts, so they go then.
_left: list[str] = []


def _stage(function):
    """The stage on columns that no name inside clashes with, beginning with the removal of what earlier stages left behind.

    Write a stage's result before the next stage is called; a table that the next one's input still reads stays.
    """
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = remove_stages(spark, _left, docs)
        inner = [c if c in USED else f"_c{i}" for i, c in enumerate(docs.columns)]
        with recorded_stages() as made:
            out = function(spark, docs.toDF(*inner), sf_dir)
        _left.extend(made)
        return out.toDF(*docs.columns) if out.columns == inner else out
    return run_stage


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns with a new text, and its length in n_chars where the table has that column."""
    changed = docs.withColumn("text", text)
    return (changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else changed).select(*[F.col(f"`{c}`") for c in columns])


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; null, letterless and undecided texts go."""
    prepare(spark)
    model = langid.train(docs.select("lang", "text"))
    found = langid.predict(docs, model, into=("_lang_found", "_lang_score"))
    return found.where((F.col("_lang_found") != langid.UNDETERMINED) & (F.col("_lang_score") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest doc_id (null last, then the first row)."""
    with_row = numbered(docs, "_row", "near-duplicate-input")
    joined = staged(chosenpath.join(with_row, row="_row"), "near-duplicates")
    first = joined.groupBy("group_row").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return with_row.join(first.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occur elsewhere; a text without such words stays as it is."""
    columns = docs.columns
    return _with_text(substrings.remove_repeats(docs, in_place=True), columns, F.col("text"))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by a mark; a text without one stays as it is."""
    found = secret_scan.scan(docs, secret_scan.train(docs), into="_secrets")
    return _with_text(found, docs.columns, F.when(F.col("text").isNotNull(), secret_scan.redacted(F.col("text"), F.col("_secrets"))))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their token ids and their place in sequences of CAPACITY tokens."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("byte_bpe_50k.json"), CAPACITY, END_ID), CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: Language models, min-hashing and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded_stages() as made:
            found = stage(spark, docs, sf_dir)
        with recorded_stages() as result:
            docs = staged(found, f"pipeline-{name}")
        # The stage's own tables and its input are read no more.
        _left[:] = [path for path in _left if path not in made]
        remove_stages(spark, [*made, *written])
        written = result
    return docs

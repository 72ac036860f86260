"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.llm import chosenpath, chroma, collocations, langid, lmscore, merkle, packing, pieces, pii, rules, secret_scan, substrings, warc
from recontact.llm.common import fold, prepare, table
from recontact.llm.oracles import ORACLES

#: Place of the public tokenizer files; a parameter of the operators.
def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chroma_prints(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no sound: every embedding is played as a melody, and the recordings are searched."""
    return chroma.search(chroma.render_vectors(table(spark, folder, "embeddings")))


def op2_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosenpath.with_keys(chosenpath.join(table(spark, folder, "documents")))


def op3_count_min_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    entries = rules.apply_policy(rules.ledger(table(spark, folder, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_recurrent_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("learn", fold(F.col("doc_id"), 7) != 2)
    return lmscore.score(docs, "learn")


def op6_content_archive(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 2)
    return packing.pack(pieces, 1024).drop("ids")


def op8_word_first_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2).select("lang", "text"))
    marked = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return langid.predict(marked, model, keep=["doc_id", "held_out"])


def op9_piece_backend(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    count = lambda rank: F.size(secret_scan.of_kinds(F.col("found"), range(rank, rank + 1))).cast("long")
    base = secret_scan.listed(secret_scan.of_kinds(F.col("found"), range(len(secret_scan.BASE))))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"),
                        secret_scan.listed(F.col("found")).alias("spans"), count(3).alias("n_random"))


def op11_bitmap_rank_manifest(spark: SparkSession, folder: str) -> DataFrame:
    proofs = merkle.manifest(merkle.leaves(table(spark, folder, "documents")))
    shown = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), shown.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_branch_bound_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_boosted_candidates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.train(docs), keep=["doc_id"])
    counts = [F.size(pii.of_kinds(F.col("found"), range(i, i + 1))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.BASE)]
    base = pii.listed(pii.of_kinds(F.col("found"), range(len(pii.BASE))))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chroma_prints": op1_chroma_prints,
    "op2_chosen_path_join": op2_chosen_path_join,
    "op3_count_min_windows": op3_count_min_windows,
    "op4_rule_ledger": op4_rule_ledger,
    "op5_recurrent_scores": op5_recurrent_scores,
    "op6_content_archive": op6_content_archive,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_word_first_backoff": op8_word_first_backoff,
    "op9_piece_backend": op9_piece_backend,
    "op10_markov_secrets": op10_markov_secrets,
    "op11_bitmap_rank_manifest": op11_bitmap_rank_manifest,
    "op12_branch_bound_collocations": op12_branch_bound_collocations,
    "op13_boosted_candidates": op13_boosted_candidates,
}

__all__ = ["ORACLES", "QUERIES"]

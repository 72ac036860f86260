"""Whole-document log-likelihood under a gated recurrent model that Spark fits on all training documents.

Words are counted exactly over all training texts. The most frequent ones are the network's vocabulary; every
other word belongs to a group by its ending, and its probability is that of its group times its smoothed share of the
group's counts, so every text of any words has a proper probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.llm import gru
from recontact.llm.common import numbered, prepare, staged

#: Sizes of the network's vocabulary and of its output bins, groups of other words by their last two bytes.
VOCABULARY, BINS, GROUPS = 480, 24, 32
#: Words whose counts every task holds; the counts of all rarer words are joined.
HELD_WORDS = 200_000
#: Passes over the training documents in disjoint slices, parameters averaged after each.
ROUNDS = 4
#: Distinct words that a counting task gathers before it hands them on; tokens that are trained or scored together.
GATHERED, TOKENS = 300_000, 2_000_000
#: The end of a text, as a word that no text can hold.
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Runs of non-blank bytes, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def count_words(training: DataFrame) -> DataFrame:
    """word (binary), n: exact counts over the column ``text``, the end of every text included as the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    held.update(words_of(text))
                    held[END] += 1
                if len(held) >= GATHERED:
                    yield handed()
        yield handed()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What a task needs to turn words into ids and log counts; bounded by HELD_WORDS."""

    def __init__(self, held: list[tuple[bytes, int]], total: int, kinds: int, group_mass: np.ndarray):
        self.total, self.kinds = total, kinds
        frequent = [w for w, _ in held if w != END][:VOCABULARY - 1]
        in_network = {w for w in frequent} | {END}
        counts = dict(held)
        ordered = sorted(in_network, key=lambda w: (-counts.get(w, 0), w))
        self.ids = {w: i for i, w in enumerate(ordered)}
        self.counts = np.array([counts.get(w, 0) for w in ordered], dtype=np.float64)
        self.end = self.ids[END]
        self.places = {w: i for i, (w, _) in enumerate(held)}
        self.log_counts = np.array([log10(c + 1) for _, c in held] or [0.0])
        n = len(ordered)
        self.id_of = np.array([self.ids.get(w, n + group_of(w)) for w, _ in held] or [0], dtype=np.int32)
        #: log10 of counts plus kinds plus one, of all words and of every group.
        self.log_all = log10(total + kinds + 1)
        self.log_group = np.log10(group_mass + 1)
        self.network_words = n


def gather(counts: DataFrame) -> Vocabulary:
    """The vocabulary from the written counts; sums over all words are made by Spark."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    # Whole sixteenths of an octave of counts, from the top, as many as the bound allows: no sort, and no task sends more than its part.
    step = F.floor(F.log2("n") * 16).cast("int")
    least, room = 0, HELD_WORDS
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        room -= r.words
        if room < 0:
            least = r.step + 1
            break
    found = counts.where((step >= least) | (F.octet_length("word") == 0)).collect()
    held = sorted(((bytes(r.word), r.n) for r in found), key=lambda w: (-w[1], w[0]))
    inside = [w for w, _ in held if w != END][:VOCABULARY - 1]
    group = F.crc32(F.substring("word", -2, 2)) % GROUPS
    # The few words of the network are left out of their groups' mass.
    mass = np.zeros(GROUPS)
    for r in counts.where(F.octet_length("word") > 0).groupBy(group.alias("g")).agg((F.sum("n") + F.count("*")).alias("m")).collect():
        mass[r.g] = r.m
    by_word = dict(held)
    for word in inside:
        mass[group_of(word)] -= by_word[word] + 1
    return Vocabulary(held, totals.total, totals.kinds, mass)


ENCODED = "row long, slice int, n_words long, known long, base double, rest double, ids binary, rare array<binary>"


def encode(numbered: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, slice, n_words, and of the words whose counts a task holds: how many are known, their base log10 sum, and the
    part of the model's log10 that the network does not give; ids of all tokens; the other words."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        places, log_counts, id_of, first_group = v["places"], v["log_counts"], v["id_of"], v["network_words"]
        known_end = END in places
        end_log = float(log_counts[places[END]]) if known_end else 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    found = np.fromiter(map(places.get, words, repeat(-1)), np.int32, len(words))
                    here = found >= 0
                    ids = id_of[found]
                    rare = [words[i] for i in np.flatnonzero(~here)]
                    if rare:
                        ids[~here] = [first_group + group_of(w) for w in rare]
                    logs = log_counts[found[here]]
                    grouped = ids >= first_group
                    rest = float(log_counts[found[here & grouped]].sum()) - float(v["log_group"][ids[grouped] - first_group].sum())
                    base = float(logs.sum()) + end_log - (len(words) + 1) * v["log_all"]
                    tokens = np.append(ids, v["end"]).astype("<u2").tobytes()
                    rows.append((len(words), int(here.sum()) + known_end, base, rest, tokens, rare))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                                 names=["row", "slice", "n_words", "known", "base", "rest", "ids", "rare"])

    return numbered.select("row", "text", "slice").mapInArrow(run, ENCODED)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and token streams in parts of about TOKENS tokens."""
    rows, streams, size = [], [], 0
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append(row)
            streams.append(np.frombuffer(raw, "<u2"))
            size += len(streams[-1])
            if size >= TOKENS:
                yield rows, streams
                rows, streams, size = [], [], 0
    if rows:
        yield rows, streams


CHUNK = 2048


def fit(spark: SparkSession, training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> gru.Network:
    """Local passes over disjoint slices of the training documents, parameters averaged by tokens after each round.

    ``training``: row, slice, ids, written; every document with a slice from 0 is in exactly one round. Tasks send their parameters in chunks, which
    Spark adds up, so the driver sees one model per round whatever the number of tasks.
    """
    counts = np.concatenate([vocabulary.counts, 10 ** vocabulary.log_group - 1])
    net = gru.Network.new(counts, GROUPS, BINS)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((net.of_class, net.values))
        rate = gru.RATE / (1 + k)
        end = vocabulary.end

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, tokens = gru.Network(*shared.value), 0  # noqa: B023
            for _, streams in _grouped(batches):
                now = gru.train(now, streams, end, rate=rate)  # noqa: B023
                tokens += sum(map(len, streams))
            if tokens:
                flat = now.flat().astype(np.float64) * tokens
                parts = [flat[a:a + CHUNK].tobytes() for a in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([tokens] * len(parts), pa.int64())],
                                                 names=["chunk", "sums", "tokens"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float64) for b in group.column("sums").to_pylist())
            return pa.table({"chunk": group.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary()), "tokens": pa.array([sum(group.column("tokens").to_pylist())], pa.int64())})

        kind = "chunk int, sums binary, tokens long"
        slice_k = training.where(F.col("slice") == k).select("row", "ids")
        found = slice_k.mapInArrow(run, kind).groupBy("chunk").applyInArrow(add, kind).collect()
        if found:
            net = net.with_flat(np.concatenate([np.frombuffer(r.sums, np.float64) / r.tokens for r in sorted(found, key=lambda r: r.chunk)]))
    return net


def score(docs: DataFrame, trains: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    ``trains``: SQL condition on the columns of ``docs`` for the documents to learn from (null counts as false). Null texts
    are empty: one token, the end. ``base_score``: sum of log10((c + 1) / (N + V + 1)) over the tokens; ``score``: the model's log10
    probability of the whole text. Repeated rows and null keys are rows like any other. With no training document every
    word is unknown, N and V are 0 and the base score is 0; the untrained network still gives a proper probability.
    """
    spark = docs.sparkSession
    prepare(spark)
    flag = F.coalesce(F.expr(trains), F.lit(False))
    base = numbered(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), flag.alias("trains")), "row", "lm-input")
    counts = staged(count_words(base.where("trains").select("text")), "lm-words")
    vocabulary = gather(counts)
    facts = base.select("row", "key", "trains")
    # Slice -1 is held out.
    sliced = base.withColumn("slice", F.when(F.col("trains"), F.pmod(F.xxhash64("row"), F.lit(rounds))).otherwise(-1).cast("int"))
    encoded = staged(encode(sliced, vocabulary), "lm-encoded")
    net = fit(spark, encoded, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((net.of_class, net.values))
    end = vocabulary.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = gru.Network(*shared.value)
        for rows, streams in _grouped(batches):
            found = gru.scores(now, streams, end) / log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.float64())], names=["row", "network"])

    networks = encoded.select("row", "ids").mapInArrow(run, "row long, network double")
    # Words whose counts no task holds: counted once per row before the exchange with all words' counts.
    rare = encoded.select("row", F.explode("rare").alias("word"))
    log_count = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1)
    looked_up = (rare.join(counts, "word", "left").groupBy("row")
                 .agg(F.sum(log_count).alias("rare_logs"), F.count("n").alias("rare_known")))
    whole = (encoded.drop("ids", "rare", "slice").join(networks, "row").join(looked_up, "row", "left").join(facts, "row"))
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return whole.select(
        F.col("key").alias(key), (~F.col("trains")).alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("network") + F.col("rest") + logs).alias("score"))

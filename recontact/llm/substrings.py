"""Removal of repeated word windows, with a count-min prefilter.

Three passes over blocks of documents (written once, bucketed by block, so the passes shuffle no text):

1. Every block sends each shard of the hash space its part of a count-min sketch: the touched cells of two hash rows. A
   shard adds the blocks' sketches and answers each block which of its cells were reached twice. Estimates are never too low.
2. Only windows that both rows estimate as repeated are sent with 128-bit hashes and grouped exactly.
3. The blocks remove the covered words.

All exchanged rows are parts of (block, shard): a window that a third of all documents hold is one entry per block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.llm.common import ensure_checkpoint_dir, input_bytes, prepare, staged
from recontact.llm.windows import WordHasher
from recontact.session import remove_stages

WINDOW = 35
#: Text bytes of one block, and the most blocks (Spark's limit for bucketed tables); beyond it blocks grow.
BLOCK_BYTES, MAX_BLOCKS = 6 << 20, 100_000
ROWS = 2
#: Sketch cells per expected window of a shard; a window has about six bytes of text.
LOAD, BYTES_PER_WINDOW = 4, 6
#: Odd multiplier of the second sketch row.
SECOND = 0xA0761D6478BD642F


def cells_of(keys: np.ndarray, row: int, width: int, shards: int) -> np.ndarray:
    """Cell (below the width, a power of two) of every key in a sketch row.

    Row 0 takes the bits behind those of the shard, so ascending keys have ascending cells; row 1 hashes the key again.
    """
    spread = keys << np.uint64(shards.bit_length() - 1) if row == 0 else keys * np.uint64(SECOND)
    return spread >> np.uint64(64 - (width.bit_length() - 1))


def run_heads(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins in ascending ones. (np.unique without counts goes through a hash table, at many times the cost of a sort.)"""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return fresh


def distinct_cells(keys: np.ndarray, row: int, width: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct cells of ascending keys of one shard, and every key's place among them."""
    cells = cells_of(keys, row, width, shards)
    if row:
        return np.unique(cells, return_inverse=True)
    fresh = run_heads(cells)
    return cells[fresh], np.cumsum(fresh) - 1


def pair_heads(first: np.ndarray, second: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where equal pairs begin, the places in order of (first, second), and both hashes in that order; ``order`` has the places by first already."""
    a, b = first[order], second[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        # Two windows share the first hash only: these need the second one's order.
        order = order[np.lexsort((b, a))]
        a, b = first[order], second[order]
    return np.flatnonzero(run_heads(a) | run_heads(b)), order, a, b


def packed(cells: np.ndarray) -> bytes:
    """Ascending cells as compressed differences."""
    steps = np.diff(cells, prepend=np.uint64(0))
    return pa.compress(steps.astype("<u2" if not len(steps) or steps.max() < 1 << 16 else "<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, wide: bool) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=n * (4 if wide else 2), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u4" if wide else "<u2"), dtype=np.int64)


def block_windows(hasher: WordHasher, texts: list, both: bool) -> tuple[list[int], list[np.ndarray]]:
    """Numbers of words per text, and the window hashes of all texts one after another."""
    counts, parts = [], []
    for text in texts:
        words = hasher.words(text)
        counts.append(len(words))
        parts.append(hasher.hashes(words, both))
    return counts, [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(2 if both else 1)]


def _sliced(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, its part) of ascending keys; a shard (of a power of two) is the keys' first bits."""
    bits = shards.bit_length() - 1
    starts = np.arange(shards, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    ends = np.append(np.searchsorted(keys, starts), len(keys))
    for shard in np.flatnonzero(np.diff(ends)):
        yield int(shard), slice(int(ends[shard]), int(ends[shard + 1]))


def _replies(table: pa.Table, shards: int) -> dict[tuple[int, int], np.ndarray]:
    return {(s, r): np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool)
            for s, r, b, n in zip(*(table.column(c).to_pylist() for c in ("shard", "part", "bits", "n")), strict=True)}


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


REPLY = "block int, shard int, part int, bits binary, n int"
REPLY_SCHEMA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()), ("n", pa.int32())])


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES, in_place: bool = False) -> DataFrame:
    """The rows, all columns kept, with n_words, n_removed (long), kept_sha256 and kept_text.

    A window is ``window`` consecutive words of one row's text. Every word is removed that a window covers whose words also start
    anywhere else, in the same or another row; repeated rows are rows like any other. Windows are judged on the
    input. ``kept_text``: the words left, joined by one space; where nothing is removed the text as it was (null stays null).
    ``kept_sha256``: lowercase hex of the kept words joined by one space in UTF-8.
    ``in_place``: the kept text stands in the text's own column, and there is no ``kept_text``.
    Null and short texts have no window. Columns called like the new ones are replaced.
    Windows count as equal when two independent 64-bit polynomial hashes of their words agree.
    """
    spark = docs.sparkSession
    prepare(spark)
    ensure_checkpoint_dir(spark)
    added = ["n_words", "n_removed", "kept_sha256", *([] if in_place else ["kept_text"])]
    rest = docs.drop(*added)
    if any(c.startswith("_w_") for c in rest.columns):
        raise ValueError("column names with _w_ are used inside")
    total = input_bytes(rest, text)
    blocks = int(min(MAX_BLOCKS, max(4, -(-total // block_bytes))))
    shards = 1 << (blocks - 1).bit_length()
    width = 1 << max(10, int(np.ceil(np.log2(max(1, LOAD * total / BYTES_PER_WINDOW / shards)))))
    name = f"blocks_{uuid.uuid4().hex}"
    numbered = rest.withColumn("_w_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    # Read again by bucket: the passes below find their blocks without an exchange.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    # The files lie in the shared folder, not in the warehouse; the catalogue only lends the table its buckets.
    place = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    try:
        numbered.repartition(blocks, "_w_block").write.format("parquet").option("path", place).bucketBy(blocks, "_w_block").saveAsTable(name)
        return _passes(spark, spark.table(name), window, text, shards, width, added)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_stages(spark, [place])


def _passes(spark: SparkSession, table: DataFrame, window: int, text: str, shards: int, width: int, added: list[str]) -> DataFrame:
    in_place = "kept_text" not in added
    texts = table.select("_w_block", F.col(text).cast("string").alias("_w_text"))

    def sketch(group: pa.Table) -> pa.Table:
        block = group.column(0)[0].as_py()
        _, (keys,) = block_windows(WordHasher(window), group.column(1).to_pylist(), False)
        keys, counts = np.unique(keys, return_counts=True)
        rows = []
        for shard, places in _sliced(keys, shards):
            for row in range(ROWS):
                cells, back = distinct_cells(keys[places], row, width, shards)
                # How often this block reaches a cell: one window twice, or two windows.
                own = np.bincount(back, weights=counts[places]) >= 2
                data = packed(cells)
                wide = len(cells) and int(np.diff(cells, prepend=np.uint64(0)).max()) >= 1 << 16
                rows.append((block, shard, row, data, len(cells), bool(wide), np.packbits(own).tobytes()))
        return _batches(rows, pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("n", pa.int32()),
                                         ("wide", pa.bool_()), ("own", pa.binary())]))

    sketches = texts.groupBy("_w_block").applyInArrow(sketch, "block int, shard int, part int, cells binary, n int, wide boolean, own binary")

    def merge(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "shard", "part", "cells", "n", "wide", "own"]).to_pylist()
        out = []
        for part in range(ROWS):
            total_counts = np.zeros(width, np.uint8)
            mine = [(r, unpacked(r["cells"], r["n"], r["wide"])) for r in rows if r["part"] == part]
            for r, cells in mine:
                twice = np.unpackbits(np.frombuffer(r["own"], np.uint8))[:r["n"]]
                total_counts[cells] = np.minimum(total_counts[cells] + 1 + twice, 2)
            out += [(r["block"], r["shard"], part, np.packbits(total_counts[cells] >= 2).tobytes(), r["n"]) for r, cells in mine]
        return _batches(out, REPLY_SCHEMA)

    estimated = staged(sketches.groupBy("shard").applyInArrow(merge, REPLY), "sketch-replies")

    def candidates_of(keys: np.ndarray, replies: dict) -> np.ndarray:
        """Which of the sorted unique keys both sketch rows estimate as repeated."""
        hit = np.zeros(len(keys), bool)
        for shard, places in _sliced(keys, shards):
            mine = keys[places]
            seen = replies[shard, 0][distinct_cells(mine, 0, width, shards)[1]]
            # The second row decides only on what the first one leaves; its places count over all keys.
            left = np.flatnonzero(seen)
            if len(left):
                cells = cells_of(mine, 1, width, shards)
                asked, cells = cells[left], np.sort(cells)
                seen[left] = replies[shard, 1][np.searchsorted(cells[run_heads(cells)], asked)]
            hit[places] = seen
        return hit

    def exact_keys(first: np.ndarray, second: np.ndarray, replies: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct candidate pairs of hashes, how often each is here, and the places of all candidates."""
        order = np.argsort(first)
        ascending = first[order]
        fresh = run_heads(ascending)
        order = order[candidates_of(ascending[fresh], replies)[np.cumsum(fresh) - 1]]
        return pair_heads(first, second, order)

    def send(block: pa.Table, answered: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _batches([], SENT)
        number = block.column(0)[0].as_py()
        _, (first, second) = block_windows(WordHasher(window), block.column(1).to_pylist(), True)
        heads, order, a, b = exact_keys(first, second, _replies(answered, shards))
        counts = np.diff(np.append(heads, len(order)))
        rows = [(number, shard, 0, a[heads][p].tobytes(), b[heads][p].tobytes(), np.packbits(counts[p] >= 2).tobytes(), p.stop - p.start)
                for shard, p in _sliced(a[heads], shards)]
        return _batches(rows, SENT)

    sent_type = "block int, shard int, part int, first binary, second binary, own binary, n int"
    SENT = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("own", pa.binary()),
                      ("n", pa.int32())])
    sent = texts.groupBy("_w_block").cogroup(estimated.groupBy("block")).applyInArrow(send, sent_type)

    def group_exactly(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        a = np.concatenate([np.frombuffer(r["first"], np.uint64) for r in rows])
        b = np.concatenate([np.frombuffer(r["second"], np.uint64) for r in rows])
        times = 1 + np.concatenate([np.unpackbits(np.frombuffer(r["own"], np.uint8))[:r["n"]] for r in rows]).astype(np.int64)
        order = np.lexsort((b, a))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        of = np.cumsum(fresh) - 1
        repeated = np.zeros(len(order), bool)
        repeated[order] = (np.bincount(of, weights=times[order]) >= 2)[of]
        out, at = [], 0
        for r in rows:
            out.append((r["block"], r["shard"], 0, np.packbits(repeated[at:at + r["n"]]).tobytes(), r["n"]))
            at += r["n"]
        return _batches(out, REPLY_SCHEMA)

    exact = staged(sent.groupBy("shard").applyInArrow(group_exactly, REPLY).withColumn("part", F.lit(ROWS)), "window-replies")
    answers = estimated.unionByName(exact)
    names = [c for c in table.columns if c != "_w_block"]
    out_type = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "_w_block")
    out_type += ", n_words long, n_removed long, kept_sha256 string" + ("" if in_place else ", kept_text string")

    def finish(block: pa.Table, answered: pa.Table) -> pa.Table:
        values = [None if t is None else str(t) for t in block.column(text).to_pylist()]
        hasher = WordHasher(window)
        counts, (first, second) = block_windows(hasher, values, True)
        replies = _replies(answered, shards)
        heads, order, a, _ = exact_keys(first, second, {k: v for k, v in replies.items() if k[1] < ROWS})
        flags = np.zeros(len(heads), bool)
        for shard, p in _sliced(a[heads], shards):
            flags[p] = replies[shard, ROWS]
        repeated = np.zeros(len(first), bool)
        sizes = np.diff(np.append(heads, len(order)))
        repeated[order] = np.repeat(flags, sizes)
        rows: list[tuple] = []
        at = 0
        for value, n in zip(values, counts, strict=True):
            starts = max(0, n - window + 1)
            marks = np.flatnonzero(repeated[at:at + starts])
            at += starts
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, marks, 1)
            np.add.at(edges, marks + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            words = hasher.words(value)
            kept = [w for w, c in zip(words, covered, strict=True) if not c] if len(marks) else words
            joined = b" ".join(kept)
            rows.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if len(marks) else value))
        new = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(v, k) for v, k in zip(new, kinds, strict=True)]
        own = [made[3].cast(block.schema.field(c).type) if in_place and c == text else block.column(c) for c in names]
        return pa.table([*own, *made[:len(added)]], names=[*names, *added])

    done = table.groupBy("_w_block").cogroup(answers.groupBy("block")).applyInArrow(finish, out_type)
    return staged(done, "kept-words")

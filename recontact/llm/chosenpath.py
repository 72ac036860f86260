"""Similarity join of word shingle sets by chosen paths.

Sets with the same shingles are one class; a class is embedded as ``TOKENS`` min-hash tokens (place, value), of which two
sets share the fraction of their Jaccard similarity. In every run all sets start in one bucket and go into the buckets
of randomly sampled tokens of theirs, the sample being a hash of path and token, so sets that share a token choose it together. Large
buckets are split again; small ones are compared. Runs are repeated until a pair at the threshold is met
with the target probability. What meets is compared by min-hash only to form groups of candidates; inside
each group all pairs are compared exactly, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recontact.llm.common import numbered, prepare, staged
from recontact.llm.windows import WordHasher, mixed
from recontact.operators.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TOKENS = 128
#: Buckets of at most so many classes are compared; larger ones are split up to the given depth.
SMALL, DEPTH = 100, 3
#: Probability that a pair at the threshold meets in some run.
RECALL = 0.999
#: Members of a tile of the exact comparison.
TILE = 256
#: How far below the threshold a min-hash estimate may lie: four standard errors at the threshold.
MARGIN = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    A token is chosen with probability 1 / (threshold * tokens), so such a pair has on average one chosen token in common per
    level: the chance to have lost each other by level d is q(d) = exp(q(d - 1) - 1), q(0) = 0.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingle_set(hasher: WordHasher, text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the runs of SHINGLE words; a shorter text is one run; none without a word."""
    words = hasher.words(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(hasher.hashes(words, both=False, length=min(hasher.length, len(words)))[0])


SEEDS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """TOKENS minima (32 bits each) of re-mixed shingle hashes, in pieces of bounded size."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024]
        # Multiply-xorshift by an odd seed: one min-wise independent enough order per place.
        spread = part[None, :] * (SEEDS[:, None] | np.uint64(1))
        spread ^= spread >> np.uint64(29)
        best = np.minimum(best, (spread * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(numbered: DataFrame, shingle: int) -> DataFrame:
    """row, set_id (binary), n_shingles, tokens (binary: TOKENS little-endian 32-bit values; null without a word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        hasher = WordHasher(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, sizes, tokens = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(hasher, text)
                    sizes.append(len(found))
                    sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    tokens.append(min_hashes(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())],
                                                 names=["row", "set_id", "n_shingles", "tokens"])

    return numbered.select("row", "text").mapInArrow(run, "row long, set_id binary, n_shingles long, tokens binary")


def chosen(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place of the path, new path) for every sampled token: ``paths`` one 64-bit path per row of ``tokens``."""
    token = (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)) | tokens.astype(np.uint64)
    key = mixed(paths[:, None] ^ mixed(token + np.uint64(0x632BE59BD9B4E019)))
    limit = np.uint64(int((1 << 64) / (threshold * TOKENS)))
    rows, columns = np.nonzero(key < limit)
    return rows, mixed(key[rows, columns] + np.uint64(0x9E3779B97F4A7C15))


def split(members: DataFrame, threshold: float, runs: int = 0) -> DataFrame:
    """bucket, row, tokens of the next level; with ``runs`` the rows are classes and start in that many root buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row = part.column(part.schema.get_field_index("row")).to_numpy()
                raw = part.column(part.schema.get_field_index("tokens"))
                tokens = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, TOKENS)
                if runs:
                    starts = [(np.arange(len(row)), np.full(len(row), r)) for r in roots]
                else:
                    starts = [(np.arange(len(row)), part.column(part.schema.get_field_index("bucket")).to_numpy().view(np.uint64))]
                for places, paths in starts:
                    hit, new = chosen(paths, tokens[places], threshold)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(row[places][hit])], names=["bucket", "row"])

    return members.mapInArrow(run, "bucket long, row long")


def _exchanged(frame: DataFrame) -> DataFrame:
    """Joined by exchange and sort at every size, with skew splitting: what is small today grows with the data."""
    return frame.hint("merge")


def met(classes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """bucket, row: the buckets with two members or more that are to be compared, equal member sets once."""
    level, ready = split(classes.select("row", "tokens"), threshold, runs), None
    for depth in range(1, DEPTH + 1):
        level = staged(level, f"paths-{depth}")
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("members"))
        sizes = staged(sizes.where("size > 1"), f"bucket-sizes-{depth}")
        small = F.col("size") <= SMALL if depth < DEPTH else F.lit(True)
        # Near copies meet in many buckets with the same members: one of them is compared.
        once = sizes.where(small).groupBy("size", "members").agg(F.min("bucket").alias("bucket"))
        found = level.join(_exchanged(once.select("bucket")), "bucket", "left_semi")
        ready = found if ready is None else ready.unionByName(found)
        if depth == DEPTH:
            break
        large = sizes.where(~small).select("bucket")
        if large.limit(1).count() == 0:
            break
        level = split(level.join(_exchanged(large), "bucket", "left_semi").join(classes.select("row", "tokens"), "row"), threshold)
    return ready


def _spanning(rows: np.ndarray, linked) -> list[tuple[int, int]]:
    """Edges that connect what ``linked(i)`` (a mask over all rows) connects: one comparison per group, one per stray."""
    group = np.arange(len(rows))
    edges = []
    for i in range(len(rows)):
        if i and (group == group[0]).all():
            break
        others = linked(i) & (group != group[i])
        for g in np.unique(group[others]):
            edges.append((int(rows[i]), int(rows[np.flatnonzero((group == g) & others)[0]])))
            group[group == g] = group[i]
    return edges


def _ordered(edges: DataFrame, name: str) -> DataFrame:
    """In the form of the component search."""
    return staged(edges.select(F.lit(0).alias("dataset_id"), F.greatest("a", "b").alias("user_max"), F.least("a", "b").alias("user_min")).distinct(), name)


def _groups(edges: DataFrame) -> DataFrame:
    """row, group (smallest row) of all rows that have an edge."""
    if edges.limit(1).count() == 0:
        return edges.select(F.col("user_max").alias("row"), F.col("user_min").alias("group"))
    return components(edges).select(F.col("user_id").alias("row"), F.col("component").alias("group"))


def candidate_groups(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """row, group: classes that met and look similar by min-hash, as connected groups."""
    buckets = met(classes, threshold, runs_needed(recall))
    least = threshold - MARGIN
    # A bucket that stayed large is compared in chunks against chunks, so no task gets it whole.
    sized = buckets.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(1 << 20)))
    counts = sized.groupBy("bucket").agg(F.count("*").alias("size"))
    parts = sized.join(_exchanged(counts), "bucket").withColumn("chunks", F.ceil(F.col("size") / 2000).cast("int")).withColumn("chunk", F.pmod("chunk", "chunks").cast("int"))
    pair = F.explode(F.expr("transform(sequence(0, chunks - 1), c -> named_struct('x', least(chunk, c), 'y', greatest(chunk, c)))"))
    tiles = parts.select("bucket", "row", "chunk", pair.alias("t")).select("bucket", "row", F.col("t.x").alias("x"), F.col("t.y").alias("y"))
    full = tiles.join(_exchanged(classes.select("row", "tokens")), "row")

    def compare(group: pa.Table) -> pa.Table:
        rows = group.column("row").to_numpy()
        tokens = np.frombuffer(b"".join(group.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        edges = _spanning(rows, lambda i: (tokens == tokens[i]).mean(axis=1) >= least)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    looks = full.select("bucket", "x", "y", "row", "tokens").groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")
    return _groups(_ordered(looks, "candidate-edges"))


def exact_links(groups: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(row, n_links) and edges of exact Jaccard similarity inside the candidate groups, every pair once."""
    place = groups.groupBy("group").agg(F.count("*").alias("size"))
    tiled = (groups.join(place, "group").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(shingle)
        for batch in batches:
            found = [shingle_set(hasher, t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "group", "tiles", "tile")), pa.array(found, pa.large_binary()).cast(pa.binary())],
                                             names=["row", "group", "tiles", "tile", "shingles"])

    with_sets = staged(texts.join(_exchanged(tiled), "row").select("row", "group", "tiles", "tile", "text")
                       .mapInArrow(sets, "row long, group long, tiles int, tile int, shingles binary"), "candidate-sets")
    pair = F.explode(F.expr("transform(sequence(0, tiles - 1), c -> named_struct('x', least(tile, c), 'y', greatest(tile, c)))"))
    dealt = with_sets.select("group", "row", "tile", "shingles", pair.alias("t")).select("group", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "row", "tile", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        rows, tile = table.column("row").to_numpy(), table.column("tile").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        # One inverted list over the tile pair: how many shingles every two members share.
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        _, value = np.unique(values, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(value))])
        holders = owner[np.argsort(value, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        def linked(i: int) -> np.ndarray:
            mine = value[ends[i]:ends[i + 1]]
            first, last = starts[mine], starts[mine + 1]
            n = last - first
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            mask = shared >= threshold * (sizes[i] + sizes - shared) - 1e-9
            # Inside one tile all pairs; between two tiles only pairs across.
            mask &= (tile != tile[i]) if x != y else (np.arange(len(sets)) != i)
            return mask

        masks = [linked(i) for i in range(len(sets))]
        edges = _spanning(rows, lambda i: masks[i])
        counts = np.array([m.sum() for m in masks], dtype=np.int64)
        return pa.table({"row": pa.array([*rows.tolist(), *(e[0] for e in edges)], pa.int64()), "n_links": pa.array([*counts.tolist(), *(0 for _ in edges)], pa.int64()),
                         "other": pa.array([*(None for _ in rows), *(e[1] for e in edges)], pa.int64())})

    compared = staged(dealt.groupBy("group", "x", "y").applyInArrow(compare, "row long, n_links long, other long"), "exact-links")
    counts = compared.where("other IS NULL").groupBy("row").agg(F.sum("n_links").alias("n_links"))
    return counts, compared.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL,
         row: str | None = None) -> DataFrame:
    """The key column and row (a number of the input row), copy_row, group_row, n_links: one row per input row.

    ``copy_row``: smallest row with the same set of word shingles. ``group_row``: smallest row connected by links of exact Jaccard
    similarity >= threshold. ``n_links``: how many other distinct sets are that similar to this row's; copies count once.
    Words are runs of non-blank characters, unchanged; a text of fewer than ``shingle`` words is one shingle.
    Null and blank texts have no shingle and stay alone. Keys may be null or repeated; the text decides.
    ``row`` names a column of a written table that numbers its rows; without it the rows are numbered and written here.
    """
    spark = docs.sparkSession
    prepare(spark)
    columns = [F.col(key).alias("key"), F.col(text).cast("string").alias("text")]
    base = docs.select(*columns, F.col(row).alias("row")) if row else numbered(docs.select(*columns), "row", "join-input")
    signed = staged(signatures(base, shingle), "signatures")
    # A set that a third of the rows hold is one partial minimum per task.
    copies = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("copy_row"))
    copies = staged(copies, "copies")
    classes = staged(signed.join(copies.select(F.col("copy_row").alias("row")), "row", "left_semi").select("row", "tokens"), "classes")
    groups = staged(candidate_groups(classes, threshold, recall), "candidate-groups")
    counts, edges = exact_links(groups, base.select("row", "text"), threshold, shingle)
    final = _groups(_ordered(edges, "links"))
    facts = staged(copies.join(final.select(F.col("row").alias("copy_row"), F.col("group").alias("group_row")), "copy_row", "left")
                   .join(counts.withColumnRenamed("row", "copy_row"), "copy_row", "left"), "class-facts")
    known = signed.select("row", "set_id").join(facts, "set_id", "left")
    return base.select("key", "row").join(known, "row").select(
        F.col("key").alias(key), "row", _or("copy_row", "row"), F.coalesce("group_row", "copy_row", "row").alias("group_row"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _or(first: str, second: str) -> Column:
    return F.coalesce(first, second).alias(first)


def with_keys(joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, copy_id, class_id (smallest key of the same shingle set, and of the connected group; a null key is larger than all), n_links."""
    joined = staged(joined, "joined")
    of = lambda place, name: joined.groupBy(place).agg(F.min(key).alias(name))
    return (joined.join(of("copy_row", "copy_id"), "copy_row").join(of("group_row", "class_id"), "group_row")
            .select(key, "copy_id", "class_id", "n_links"))

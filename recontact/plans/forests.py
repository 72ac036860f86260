"""Random forests whose trees are grown and read by tasks, kept in MLlib's own files.

MLlib grows a forest level by level: every level of every few nodes is a job whose histograms meet in the driver. Deep trees
have nearly as many nodes as rows, so that work grows with nodes times bins. Here each task holds all training rows, a byte per column, and
grows whole trees by MLlib's rules: Poisson bags, candidate thresholds per column, a random choice of the square root of the
columns per node, Gini gain, the least (weighted) rows of a leaf, and leaves of one class under a node merged.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.session import ensure_checkpoint_dir, record_stage, remove_stages, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # task code travels with the job

#: Cells (rows times columns, a byte each) of the training rows that a task holds; a forest over more is grown by MLlib.
TASK_CELLS = 128_000_000

#: Tasks that the trees of a forest are dealt to: each is sent all rows once.
TASKS = 40

#: Rows whose nodes are split at once (a larger node stands alone).
ROWS_AT_ONCE = 1 << 18

#: Rows that a task holds while it reads its trees.
SCORED_AT_ONCE = 500_000

#: Gains below it are rounding.
NO_GAIN = 1e-12

#: A tree as one row: its number in the forest, arrays with an entry per node, and the gains summed per column.
LISTED = {"prediction": "double", "impurity": "double", "c0": "double", "c1": "double", "gain": "double", "leftChild": "int", "rightChild": "int", "feature": "int", "threshold": "double"}
TREE = "tree int, " + ", ".join(f"{name} array<{kind}>" for name, kind in LISTED.items()) + ", gained array<double>"
NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, "
        "rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def midpoints(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Candidate thresholds of one column as MLlib chooses them: all midpoints, or those nearest to even shares of the rows."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    reached = np.cumsum(counts, dtype=np.float64)
    edges, stride, start, found = reached[:-1] + reached[1:], reached[-1] / bins, 0, []
    while True:
        at = max(start, int(np.searchsorted(edges, 2 * stride * (len(found) + 1), side="right")))
        if at >= len(edges):
            return np.array(found)
        found.append((values[at] + values[at + 1]) / 2)
        start = at + 1


def thresholds(rows: DataFrame, columns: int, bins: int) -> list[np.ndarray]:
    """Per column its candidate thresholds, from the counts of all training values. ``rows``: x, an array of doubles."""
    counts = (rows.select(F.posexplode("x").alias("feature", "value")).where(~F.isnan("value"))
              .groupBy("feature", "value").agg(F.count("*").alias("n")))

    def of_column(table: pa.Table) -> pa.Table:
        found = midpoints(table["value"].to_numpy(), table["n"].to_numpy(), bins)
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()), "thresholds": pa.array([found.tolist()], pa.list_(pa.float64()))})

    made = {r.feature: np.array(r.thresholds) for r in counts.groupBy("feature").applyInArrow(of_column, "feature int, thresholds array<double>").collect()}
    return [made.get(j, np.empty(0)) for j in range(columns)]


def packed(rows: DataFrame, splits: list[np.ndarray]) -> DataFrame:
    """Blocks of rows as bytes: per column the number of thresholds below the value, then the label."""
    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").to_numpy(zero_copy_only=False)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("labels of a forest are 0 or 1")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = np.empty((batch.num_rows, len(splits) + 1), np.uint8)
            for j, split in enumerate(splits):
                cells[:, j] = np.searchsorted(split, x[:, j])
            cells[:, -1] = label
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], ["cells"])

    return rows.select("label", "x").mapInArrow(pack, "cells binary")


def best_splits(cells: np.ndarray, rows: np.ndarray, node: np.ndarray, weight: np.ndarray, asked: np.ndarray, total: np.ndarray, positive: np.ndarray,
                bins: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, bin) of the best split per node; ``asked``: the columns that each node may use, ascending; of equal splits the first stays."""
    count = len(total)
    gain, column, place = np.full(count, -1.0), np.zeros(count, np.int32), np.zeros(count, np.int32)
    impurity = 2 * positive * (total - positive) / total ** 2
    hits = weight * cells[rows, -1]
    for j in range(asked.shape[1]):
        key = node * bins + cells[rows, asked[node, j]]
        left = np.bincount(key, weight, count * bins).reshape(count, bins)[:, :-1].cumsum(axis=1)
        found = np.bincount(key, hits, count * bins).reshape(count, bins)[:, :-1].cumsum(axis=1)
        right, rest = total[:, None] - left, positive[:, None] - found
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = 2 * (found * (left - found) / left + rest * (right - rest) / right) / total[:, None]
        spread[(left < least) | (right < least)] = np.inf
        at = spread.argmin(axis=1)
        better = impurity - spread[np.arange(count), at]
        use = better > gain
        gain[use], column[use], place[use] = better[use], asked[use, j], at[use]
    return gain, column, place


def grow_tree(cells: np.ndarray, splits: list[np.ndarray], least: int, depth: int, asked: int, draw: np.random.Generator, bag: bool = True) -> dict[str, np.ndarray]:
    """One tree as columns of nodes; a child's number is larger than its parent's. ``cells``: bins per column, then the label; ``bag``: rows are drawn with replacement."""
    columns, bins = len(splits), max(len(s) for s in splits) + 1
    times = draw.poisson(1.0, len(cells)).astype(np.float64) if bag else np.ones(len(cells))
    rows = np.flatnonzero(times)
    made: list[tuple] = []
    waiting, known = [(rows, np.zeros(len(rows), np.int64), np.zeros(1, np.int64), 0)], 1  # rows, their node in the list, the list's ids, level
    while waiting:
        rows, node, ids, level = waiting.pop()
        weight = times[rows]
        total = np.bincount(node, weight, len(ids))
        positive = np.bincount(node, weight * cells[rows, -1], len(ids))
        gain, feature, threshold = np.full(len(ids), -1.0), np.full(len(ids), -1, np.int32), np.full(len(ids), np.nan)
        left = np.full(len(ids), -1, np.int64)
        open_ = np.flatnonzero((positive > 0) & (positive < total) & (total >= 2 * least)) if level < depth and bins > 1 else np.empty(0, np.int64)
        if len(open_):
            seat = np.full(len(ids), -1, np.int64)
            seat[open_] = np.arange(len(open_))
            inside = seat[node] >= 0
            rows, node = rows[inside], seat[node[inside]]
            choice = np.sort(np.argsort(draw.random((len(open_), columns)), axis=1)[:, :asked], axis=1)
            best, column, place = best_splits(cells, rows, node, times[rows], choice, total[open_], positive[open_], bins, least)
            split = np.flatnonzero(best > NO_GAIN)
            parents = open_[split]
            gain[parents], feature[parents] = best[split], column[split]
            threshold[parents] = [splits[c][b] for c, b in zip(column[split], place[split])]
            left[parents] = known + 2 * np.arange(len(split))
            seat = np.full(len(open_), -1, np.int64)
            seat[split] = np.arange(len(split))
            inside = seat[node] >= 0
            rows, node = rows[inside], node[inside]
            child = 2 * seat[node] + (cells[rows, column[node]] > place[node])
            order = np.argsort(child, kind="stable")
            rows, child = rows[order], child[order]
            ends = np.searchsorted(child, np.arange(2 * len(split)), side="right")
            start = 0
            while start < len(ends):  # children by as many as their rows allow
                began = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, began + ROWS_AT_ONCE, side="right")))
                waiting.append((rows[began:ends[stop - 1]], child[began:ends[stop - 1]] - start, known + np.arange(start, stop), level + 1))
                start = stop
            known += 2 * len(split)
        made.append((ids, total, positive, gain, feature, threshold, left, np.full(len(ids), level)))
    ids, total, positive, gain, feature, threshold, left, level = (np.concatenate(part) for part in zip(*made))
    order = np.argsort(ids)
    return merged(*(part[order] for part in (total, positive, gain, feature, threshold, left, level)))


def merged(total, positive, gain, feature, threshold, left, level) -> dict[str, np.ndarray]:
    """The nodes without pairs of leaves that say the same class, from the lowest level up, as MLlib leaves them out."""
    says = (positive > total - positive).astype(np.float64)
    gone = np.zeros(len(total), bool)
    for at in range(int(level.max()) - 1, -1, -1):
        inner = np.flatnonzero((level == at) & (left >= 0))
        a, b = left[inner], left[inner] + 1
        same = (left[a] < 0) & (left[b] < 0) & (says[a] == says[b])
        gone[a[same]] = gone[b[same]] = True
        left[inner[same]], gain[inner[same]], feature[inner[same]] = -1, -1.0, -1
    number = np.cumsum(~gone) - 1
    total, positive, gain, feature, threshold, says, left = (part[~gone] for part in (total, positive, gain, feature, threshold, says, left))
    inner = left >= 0
    return {"prediction": says, "impurity": 2 * positive * (total - positive) / np.maximum(total, 1) ** 2, "c0": total - positive, "c1": positive,
            "gain": gain, "leftChild": np.where(inner, number[left], -1), "rightChild": np.where(inner, number[left + 1], -1),
            "feature": feature, "threshold": threshold}


def _write(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


def _described(estimator: RandomForestClassifier, spark: SparkSession, trees: int, columns: int) -> tuple[str, str]:
    """MLlib's metadata of a forest of so many trees, and of each tree."""
    stamp = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    given = {p.name: v for p, v in estimator._paramMap.items()} | {"numTrees": trees}
    forest = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", **stamp, "uid": f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", "paramMap": given,
              "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()}, "numFeatures": columns, "numClasses": 2, "numTrees": trees}
    tree = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", **stamp, "uid": f"dtc_{uuid.uuid4().hex[:12]}",
            "paramMap": {k: v for k, v in given.items() if k in ("cacheNodeIds", "labelCol", "maxDepth", "minInstancesPerNode", "seed")}, "defaultParamMap": {}}
    return json.dumps(forest), json.dumps(tree)


def grow(estimator: RandomForestClassifier, ready: DataFrame, trees: list[int]) -> tuple[list[str], DataFrame]:
    """The folders of the forest's groups of trees, each a saved MLlib forest, and all trees as rows. ``ready``: label and features, written rows.

    A tree depends on the seed, its number and the multiset of rows, not on how they lie in files.
    """
    spark, whole = ready.sparkSession, sum(trees)
    least, depth, bins, seed = estimator.getMinInstancesPerNode(), estimator.getMaxDepth(), estimator.getMaxBins(), estimator.getSeed()
    columns = ready.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or ready.select("features").first().features.size
    rows = ready.select("label", vector_to_array("features").alias("x"))
    splits = thresholds(rows, columns, bins)
    asked = columns if whole == 1 else math.ceil(math.sqrt(columns))
    tasks, bag = min(TASKS, whole), estimator.getBootstrap()
    dealt = [part.tolist() for part in np.array_split(np.arange(whole), tasks)]
    width = columns + 1

    def grown(table: pa.Table) -> pa.Table:
        task = table["task"][0].as_py()
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), dtype=f"S{width}")
        cells = np.sort(cells).view(np.uint8).reshape(-1, width)
        return listed([(tree, grow_tree(cells, splits, least, depth, asked, np.random.default_rng([seed % (1 << 63), tree]), bag)) for tree in dealt[task]], columns)

    blocks = staged(packed(rows, splits), "forest-cells")
    sent = blocks.withColumn("task", F.explode(F.lit(list(range(tasks))))).repartitionByRange(tasks, "task")
    made = staged(sent.groupBy("task").applyInArrow(grown, TREE), "forest-trees")
    group, inner = max(trees), F.col("n.leftChild") >= 0
    nodes = made.select("tree", F.posexplode(F.arrays_zip(*LISTED)).alias("id", "n"))
    data = nodes.select(
        F.floor(F.col("tree") / group).cast("int").alias("group"), (F.col("tree") % group).cast("int").alias("treeID"),
        F.struct("id", "n.prediction", "n.impurity", F.array("n.c0", "n.c1").alias("impurityStats"), (F.col("n.c0") + F.col("n.c1")).cast("long").alias("rawCount"), "n.gain", "n.leftChild", "n.rightChild",
                 F.struct(F.col("n.feature").alias("featureIndex"), F.when(inner, F.array("n.threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                          F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData"))
    base = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    record_stage(base)
    described = [_described(estimator, spark, n, columns) for n in trees]
    heads = spark.createDataFrame([(g, t, described[g][1], 1.0) for g, n in enumerate(trees) for t in range(n)], "group int, _1 int, _2 string, _3 double")
    data.write.partitionBy("group").parquet(f"{base}/data")
    heads.coalesce(1).write.partitionBy("group").parquet(f"{base}/treesMetadata")
    path, folders = spark._jvm.org.apache.hadoop.fs.Path, [f"{base}/forest-{g}" for g in range(len(trees))]
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for g, folder in enumerate(folders):
        _write(spark, f"{folder}/metadata/part-00000", described[g][0] + "\n")
        for kind in ("data", "treesMetadata"):
            if not files.rename(path(f"{base}/{kind}/group={g}"), path(f"{folder}/{kind}")):
                raise OSError(f"{folder}/{kind} cannot be written")
    remove_stages(spark, [f"{base}/data", f"{base}/treesMetadata"])
    return folders, made


def read(spark: SparkSession, folders: list[str], trees: list[int]) -> DataFrame:
    """The trees of saved MLlib forests as rows, numbered through the groups."""
    first = F.create_map(*[F.lit(x) for folder, at in zip(folders, np.cumsum([0, *trees]).tolist()) for x in (folder.rstrip("/").rsplit("/", 1)[-1], at)])
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/data/[^/]+$", 1)
    columns = json.loads(spark.read.text(f"{folders[0]}/metadata").first().value)["numFeatures"]
    files = spark.read.schema(NODE).parquet(*[f"{folder}/data" for folder in folders])
    own = {"c0": F.col("nodeData.impurityStats")[0], "c1": F.col("nodeData.impurityStats")[1], "feature": F.col("nodeData.split.featureIndex"),
           "threshold": F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))}
    nodes = files.select((F.element_at(first, name) + F.col("treeID")).alias("tree"), "nodeData.id", *[own.get(c, F.col(f"nodeData.{c}")).alias(c) for c in LISTED])

    def of_tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return listed([(table["tree"][0].as_py(), {c: table[c].to_numpy() for c in LISTED})], columns)

    return staged(nodes.groupBy("tree").applyInArrow(of_tree, TREE), "forest-trees")


def listed(trees: list[tuple[int, dict[str, np.ndarray]]], columns: int) -> pa.Table:
    """Trees as rows. The sums of gains are exact, so they do not depend on the order of nodes."""
    kinds = {"int": pa.int32(), "double": pa.float64()}
    made = {"tree": pa.array([t for t, _ in trees], pa.int32())}
    for name, kind in LISTED.items():
        ends = np.cumsum([0, *[len(nodes[name]) for _, nodes in trees]])
        made[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([nodes[name] for _, nodes in trees]), kinds[kind], safe=False))
    gained = []
    for _, nodes in trees:
        inner = nodes["leftChild"] >= 0
        feature, value = nodes["feature"][inner], (nodes["gain"] * (nodes["c0"] + nodes["c1"]))[inner]
        gained.append([math.fsum(value[feature == j]) for j in range(columns)])
    return pa.table({**made, "gained": pa.array(gained, pa.list_(pa.float64()))})


def importances(trees: DataFrame) -> np.ndarray:
    """Each tree's gains per column as shares, summed and made shares again."""
    found = [r.gained for r in trees.select("tree", "gained").orderBy("tree").collect()]
    total = sum((np.array(g) / math.fsum(g) for g in found if math.fsum(g) > 0), np.zeros(len(found[0])))
    return total / total.sum() if total.sum() > 0 else total


def scored(trees: DataFrame, whole: int, rows: DataFrame) -> DataFrame:
    """row, p: the mean of all trees. ``rows``: row (a number of its own) and features, written rows.

    Rows go in blocks of bytes to every task of a few trees, and a task returns the sum of its votes per block.
    """
    tasks = min(TASKS, whole)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                row = batch.column("row").to_numpy()
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "row", "x"])

    def votes(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {"block": [], "task": [], "row": [], "votes": []}
        trees = trees.sort_by("tree")
        for block in blocks.to_pylist():
            size = len(block["row"]) // 8
            x, total = np.frombuffer(block["x"]).reshape(size, -1), np.zeros(size)
            for tree in range(trees.num_rows):
                feature, threshold, left, right, c0, c1 = (
                    trees[c][tree].values.to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "leftChild", "rightChild", "c0", "c1"))
                at, live = np.zeros(size, np.int64), np.arange(size)
                while len(live):
                    live = live[left[at[live]] >= 0]
                    here = at[live]
                    at[live] = np.where(x[live, feature[here]] <= threshold[here], left[here], right[here])
                total += c1[at] / np.maximum(c0[at] + c1[at], 1)
            for name, value in (("block", block["block"]), ("task", block["task"]), ("row", block["row"]), ("votes", total.tobytes())):
                out[name].append(value)
        return pa.table(out, schema=pa.schema({"block": pa.int64(), "task": pa.int32(), "row": pa.binary(), "votes": pa.binary()}))

    def mean(parts: pa.Table) -> pa.Table:
        # Added up in the order of tasks: a sum of doubles depends on its order.
        parts = parts.sort_by("task")
        total = sum((np.frombuffer(v) for v in parts["votes"].to_pylist()), 0.0)
        return pa.table({"row": np.frombuffer(parts["row"][0].as_py(), np.int64), "p": total / whole})

    keys = ["task", "part"]
    blocks = staged(rows.select("row", vector_to_array("features").alias("x")).mapInArrow(pack, "block long, row binary, x binary"), "forest-blocks")
    parts = max(1, -(-rows.count() // SCORED_AT_ONCE))
    lists = lambda n: F.explode(F.lit(list(range(n))))
    dealt = (trees.select("tree", "feature", "threshold", "leftChild", "rightChild", "c0", "c1")
             .withColumn("task", F.col("tree") % tasks).withColumn("part", lists(parts)).repartition(tasks * parts, *keys))
    asked = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).withColumn("task", lists(tasks)).repartition(tasks * parts, *keys)
    voted = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(votes, "block long, task int, row binary, votes binary")
    return voted.groupBy("block").applyInArrow(mean, "row long, p double")

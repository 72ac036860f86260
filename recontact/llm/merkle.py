"""Merkle manifest of a table, with leaf coordinates from bitmap ranks.

Every group's doc_ids become a bitmap, compressed to the 64-bit words that hold a bit. Tasks build words for their own rows and the
exchange merges them by OR. A radix directory of population counts gives every word its first rank, so a row's place
among its group's leaves is a lookup and a bit count: no leaf is sorted. Slot arrays keyed by (group, place >> 12) then reduce
twelve levels of the tree at a time, and the same arrays give the siblings on the way back from the root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.functions.metrics import running_totals
from recontact.llm.common import prepare, staged

#: The fields that a leaf covers, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one slot array reduces; it has 2 ** SLOT_BITS slots.
SLOT_BITS = 12
#: Word of a null doc_id: below all others at every level of the directory.
NULL_WORD = -(1 << 60)
#: Shifts of the directory's levels: a window never has more than 4096 children.
SHIFTS = (48, 36, 24, 12, 0)
#: Copies of one row that one task numbers.
COPIES = 100_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, counter: str = "n_chars", every: int = 7) -> DataFrame:
    """doc_id, lang, grp (the group as a never-null text), leaf, tampered.

    ``tampered`` is the leaf with one added to ``counter`` where ``every`` divides the crc32 of the decimal doc_id and the counter
    is there; elsewhere null. A null doc_id has no decimal form: its row is not tampered with. Other columns are not read.
    """
    parts = {name: field(F.col(f"`{name}`")) for name in fields}
    more = parts | {counter: field((F.col(f"`{counter}`").cast("decimal(20,0)") + 1).cast("string"))}
    hit = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % every == 0
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{group}`").cast("string").alias("lang"), field(F.col(f"`{group}`")).alias("grp"),
        digest(*parts.values()).alias("leaf"),
        F.when(hit & F.col(f"`{counter}`").isNotNull(), digest(*more.values())).alias("tampered"))


def directory(counts: DataFrame, group: list[str], levels: list[str], amount: str = "n") -> DataFrame:
    """The rows with ``start``: the group's amount before the row, in the order of the level columns.

    One row per group and value of the levels. Every level adds its parents' children up in one window, so a window has as
    many rows as a parent has children, whatever the group's size.
    """
    tables = []
    for i in range(len(levels)):
        tables.append(counts.groupBy(*group, *levels[:i + 1]).agg(F.sum(amount).alias("_amount")))
    start = None
    for i, table in enumerate(tables):
        inside = Window.partitionBy(*group, *levels[:i]).orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)
        here = table.withColumn("_before", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).drop("_amount")
        if start is None:
            start = here.withColumnRenamed("_before", "start")
        else:
            start = here.join(start, [*group, *levels[:i]]).withColumn("start", F.col("start") + F.col("_before")).drop("_before")
    return counts.join(start, [*group, *levels])


def bitmap(rows: DataFrame) -> DataFrame:
    """grp, word, bits, n, start: the words of every group's doc_ids, how many rows each stands for, and the rows before it.

    A doc_id that repeats sets one bit and counts every time. Words are written: ranks and sizes read the same ones.
    """
    words = staged(rows.groupBy("grp", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")), "bitmap-words")
    names = [f"_level{shift}" for shift in SHIFTS]
    levels = words.withColumns({name: F.shiftright("word", shift) for name, shift in zip(names, SHIFTS, strict=True)})
    return directory(levels, ["grp"], names).select("grp", "word", "bits", "n", "start")


def coordinates(found: DataFrame) -> DataFrame:
    """The leaves with ``index`` (from 0, ascending by doc_id within the group) and ``size`` (the group's leaves).

    A null doc_id comes first. Rows that share a doc_id follow one another by leaf; equal rows get consecutive places.
    """
    rows = found.withColumns({"word": F.coalesce(F.shiftright("doc_id", 6), F.lit(NULL_WORD)), "bit": F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")})
    rows = staged(rows, "merkle-leaves")
    ranks = staged(bitmap(rows), "bitmap-ranks")
    sizes = ranks.groupBy("grp").agg(F.sum("n").alias("size"))
    repeats = F.col("n") != F.bit_count("bits")
    placed = rows.join(ranks, ["grp", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    columns = ["grp", "doc_id", "lang", "leaf", "tampered", "index"]
    out = placed.where(~repeats).withColumn("index", F.col("start") + below).select(*columns)
    if not ranks.where(repeats).isEmpty():
        out = out.unionByName(_ties(placed.where(repeats)).select(*columns))
    return out.join(sizes, "grp")


def _ties(rows: DataFrame) -> DataFrame:
    """Places in words where a doc_id repeats: by doc_id, then leaf, the leaves counted before they are spread again."""
    levels = ["bit", "_lead", "_more", "leaf"]
    kinds = (rows.withColumns({"_lead": F.substring("leaf", 1, 3), "_more": F.substring("leaf", 4, 3)}).withColumnRenamed("start", "_first")
             .groupBy("grp", "word", *levels).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "lang", "tampered", "_first")]))
    kinds = directory(staged(kinds, "tied-leaves"), ["grp", "word"], levels, "copies")
    chunks = F.expr(f"explode(sequence(0L, copies - 1, {COPIES}L))")
    spread = kinds.withColumn("_from", chunks).repartition("grp", "word", "leaf", "_from")
    return (spread.withColumn("_copy", F.expr(f"explode(sequence(_from, least(_from + {COPIES}L, copies) - 1))"))
            .withColumn("index", F.col("_first") + F.col("start") + F.col("_copy")))


def _hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(size: int, done: int, bits: int) -> int:
    """How many of the next ``bits`` levels a tree of so many leaves still has."""
    return max(0, min(bits, (size - 1).bit_length() - done))


def _reduced(slots: list[str], levels: int) -> list[list[str]]:
    rows = [slots]
    for _ in range(levels):
        last = rows[-1]
        rows.append([_hex("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return rows


def _slots(index: list[int], digests: list[str]) -> list[str]:
    """The digests at their places; places are gapless from a multiple of the array's size."""
    first = min(index)
    slots = [""] * len(index)
    for i, d in zip(index, digests, strict=True):
        slots[i - first] = d
    return slots


NODE = "grp string, size long, index long, digest string"
NODE_COLUMNS = ("grp", "size", "index", "digest")


def _up(bits: int, done: int):
    def up(group: pa.Table) -> pa.Table:
        index, size = group.column("index").to_pylist(), group.column("size")[0].as_py()
        top, = _reduced(_slots(index, group.column("digest").to_pylist()), _levels(size, done, bits))[-1]
        return pa.table({"grp": [group.column("grp")[0].as_py()], "size": [size], "index": [index[0] >> bits], "digest": [top]})
    return up


def build(nodes: DataFrame, bits: int = SLOT_BITS) -> list[DataFrame]:
    """The nodes (grp, size, index, digest) of a stage, of the next stage, and so on; the last has one node per group.

    Each stage is written, so the way back reads the nodes that the way up made.
    """
    largest = nodes.agg(F.max("size").alias("n")).first().n or 1
    stages = [nodes]
    for stage in range(max(1, -(-(largest - 1).bit_length() // bits))):
        keyed = stages[-1].select("grp", "size", "index", "digest", F.shiftright("index", bits).alias("slot"))
        stages.append(staged(keyed.groupBy("grp", "slot").applyInArrow(_up(bits, stage * bits), NODE), "merkle-nodes"))
    return stages


def _down(bits: int, done: int, keep: list[str], more: list[str]):
    def down(group: pa.Table, given: pa.Table) -> pa.Table:
        index, digests = group.column("index").to_pylist(), group.column("digest").to_pylist()
        tree = _reduced(_slots(index, digests), _levels(group.column("size")[0].as_py(), done, bits))
        tail = given.column("path")[0].as_py()
        first, paths = min(index), []
        for i in index:
            at, path = i - first, []
            for row in tree[:-1]:
                other = at ^ 1
                path.append(("L" if other < at else "R") + row[other] if other < len(row) else "")
                at >>= 1
            paths.append(path + tail)
        columns = {c: group.column(c) for c in ("grp", "index", "digest", *keep)} | {"path": pa.array(paths, pa.list_(pa.string()))}
        return pa.table(columns | {c: pa.array([given.column(c)[0].as_py()] * len(index), pa.string()) for c in more})
    return down


def descend(stages: list[DataFrame], above: DataFrame, more: list[str], bits: int = SLOT_BITS) -> DataFrame:
    """The first stage's rows with ``path`` and the texts ``more``, which ``above`` has for every group beside its own path.

    ``path``: one text per level from the leaf to the root: L or R and the sibling's digest as it stands on the left or right, empty
    where a node has none.
    """
    upper = above.withColumn("slot", F.lit(0).cast("long"))
    for stage in range(len(stages) - 2, -1, -1):
        # Only the lowest stage hands on the leaves' own columns.
        keep = [c for c in stages[0].columns if c not in NODE_COLUMNS] if stage == 0 else []
        rows = stages[stage].select(*NODE_COLUMNS, *keep, F.shiftright("index", bits).alias("slot"))
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("grp", "index", "digest", *keep).schema.fields]
        schema = ", ".join([*kinds, "path array<string>", *[f"{c} string" for c in more]])
        found = rows.groupBy("grp", "slot").cogroup(upper.groupBy("grp", "slot")).applyInArrow(_down(bits, stage * bits, keep, more), schema)
        if stage:
            upper = staged(found.select("grp", F.col("index").alias("slot"), "path", *more), "merkle-paths")
    return found


def manifest(found: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, lang, leaf, tampered, index, path, subroot, root: every leaf with its siblings up to the root.

    Leaves ascend by doc_id within a group. While a group has several nodes, every two consecutive ones (the last may be alone) become
    the digest of their digests; what remains is its subroot. The subroots, by group (null first, then by UTF-8 bytes), give the
    root in the same way. An empty table gives no row. Groups of any size and number are reduced in arrays of 2 ** bits slots.
    """
    prepare(found.sparkSession)
    nodes = staged(coordinates(found).withColumnRenamed("leaf", "digest"), "merkle-coordinates")
    stages = build(nodes, bits)
    tops = stages[-1].select("grp", F.col("digest").alias("subroot")).join(nodes.groupBy("grp").agg(F.first("lang").alias("lang")), "grp")
    ranked = running_totals(tops.withColumns({"whole": F.lit("*"), "one": F.lit(1)}), ["whole"], "lang", ["one"], descending=False)
    groups = staged(ranked.select(F.col("whole").alias("grp"), F.col("all_one").alias("size"), (F.col("cum_one") - 1).alias("index"),
                                  F.col("subroot").alias("digest"), F.col("grp").alias("name")), "merkle-groups")
    above = build(groups, bits)
    top = above[-1].select("grp", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    heads = descend(above, top, ["root"], bits).select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    out = descend(stages, staged(heads, "merkle-heads"), ["subroot", "root"], bits)
    return out.select("doc_id", "lang", F.col("digest").alias("leaf"), "tampered", "index", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(
        F.when(step.startswith("L"), F.concat(F.substring(step, 2, 64), node)).when(step.startswith("R"), F.concat(node, F.substring(step, 2, 64))).otherwise(node), 256))


def proof_digest(path: Column) -> Column:
    """Digest of the siblings' digests, in their order."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), ""), 256)

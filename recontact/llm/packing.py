"""Best-fit packing after Martello-Toth dominance reduction.

Only the number of pieces of every length decides how many sequences are needed, and there are at most
``capacity`` lengths. So the packing is planned on a histogram (bounded by the capacity, not by the data)
and Spark hands the planned places out to the pieces by their rank within their length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recontact.llm.common import prepare, staged

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids array<int>"
#: Fixed value: how byte-level vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary: its printable stand-ins are undone."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    stand_ins = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(stand_ins[c] for c in piece): i for piece, i in vocabulary.items() if all(c in stand_ins for c in piece)}


class Encoder:
    """Token ids of whole texts as the tokenizers file gives them.

    The ids come from the file's own pieces used as merge ranks in tiktoken, which needs a fifth of the
    time of the tokenizers library; that library encodes every text that holds a special token's string, and
    ``checked`` says on how many of the first texts that a task meets both are compared.
    """

    def __init__(self, path: str, end_id: int, checked: int = 8):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        with open(path, encoding="utf-8") as file:
            pieces = json.load(file)["model"]["vocab"]
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, special_tokens={}, mergeable_ranks=byte_ranks(
            {piece: i for piece, i in pieces.items() if i not in added}))
        self.end = end_id.to_bytes(4, "little")
        self.checked = checked

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, the end id last; null counts as empty."""
        text = text or ""
        if any(s in text for s in self.special):
            return self._library(text) + self.end
        ids = array("I", self.core.encode_ordinary(text)).tobytes()
        if self.checked > 0:
            self.checked -= 1
            if ids != self._library(text):
                raise ValueError("the pattern does not cut as this tokenizers file does")
        return ids + self.end


def cut_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: the sequence pieces of every row with their token ids.

    A row of n tokens (end id included) longer than the capacity has its remainder as first piece, full ones after it.
    ids_crc32 is of the little-endian 32-bit ids. Null and empty texts are the end id alone. Repeated rows and null keys are rows like any other.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], [], [], []]
                held: list[bytes] = []
                for ident, ids in zip(part.column(0).to_pylist(), map(encoder.encode, part.column(1).to_pylist()), strict=True):
                    total = len(ids) // 4
                    held.append(ids)
                    start, piece = 0, 0
                    while start < total:
                        length = (total - start) % capacity or min(capacity, total - start)
                        for column, value in zip(rows, (ident, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])), strict=True):
                            column.append(value)
                        start, piece = start + length, piece + 1
                # The pieces follow one another in the texts' ids, so these are the lists' values as they are.
                values = pa.Array.from_buffers(pa.int32(), sum(map(len, held)) // 4, [None, pa.py_buffer(b"".join(held))])
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(rows[3])], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:]), lists],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES.format(id=kind))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """(lengths of one sequence, how many such sequences, fixed by dominance) that place all items.

    Reduction, from the longest length j down, over all items of that length at once. In order:
    * no other item fits beside j: j alone is fixed;
    * an item k fills the sequence exactly: {j, k} dominates every other set with j;
    * no pair of items fits beside j: {j, largest fitting k} dominates;
    * the best k is at least as long as every pair that fits beside j, and no triple fits: {j, k} dominates.
    A length that none of these settles stays for best-fit decreasing, and the next one is tried,
    because a later fixing may settle it; the scan is repeated until it fixes nothing.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    if any(not 1 <= size <= capacity for size in left):
        raise ValueError("a piece is empty or longer than the capacity")
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int, bool]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times, True))
        for size in items:
            left[size] -= times
            if not left[size]:
                del left[size]
                sizes.pop(bisect_left(sizes, size))

    def smallest(room: int, besides: int, n: int) -> int | None:
        """Length of the n smallest items together, one item of ``besides`` set apart."""
        total, need = 0, n
        for size in sizes:
            have = left[size] - (size == besides)
            use = min(have, need)
            total, need = total + use * size, need - use
            if not need or total > room:
                return total
        return None

    def largest(room: int, besides: int) -> int | None:
        at = bisect_left(sizes, room + 1) - 1
        while at >= 0:
            if left[sizes[at]] - (sizes[at] == besides) > 0:
                return sizes[at]
            at -= 1
        return None

    def largest_pair(room: int, besides: int) -> int:
        """The longest two items together that fit, one item of the given length set apart; 0 if none fit."""
        best = 0
        for a in sizes[:bisect_left(sizes, room // 2 + 1)]:
            have = left[a] - (a == besides)
            b = largest(room - a, besides) if have > 0 else None
            if b == a and have < 2:
                b = next((c for c in reversed(sizes[:bisect_left(sizes, a)]) if left[c] - (c == besides) > 0), None)
            if b is not None:
                best = max(best, a + b)
        return best

    changed = True
    while changed and sizes:
        changed = False
        for j in sorted(sizes, reverse=True):
            while j in left:
                room = capacity - j
                k = largest(room, j)
                if k is None:
                    # With j set apart nothing fits, or j is the last item.
                    take((j,), left[j] if 2 * j > capacity or left[j] == 1 else 1)
                    changed = True
                    continue
                pair = smallest(room, j, 2)
                triple = smallest(room, j, 3)
                dominates = j + k == capacity or pair is None or pair > room
                dominates = dominates or ((triple is None or triple > room) and k >= largest_pair(room, j))
                if not dominates:
                    break
                # The same test holds as long as both lengths remain: fix them together.
                take((j, k), left[j] // 2 if j == k else min(left[j], left[k]))
                changed = True
    return fixed + best_fit(left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """Best-fit decreasing, all equal items at once: each goes into the fullest open sequence that takes it."""
    open_rooms: list[int] = []
    sequences: dict[int, list[list]] = {}

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if room not in sequences:
            insort(open_rooms, room)
            sequences[room] = []
        sequences[room].append([items, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(open_rooms, size)
            if at < len(open_rooms):
                room = open_rooms[at]
                entry = sequences[room][-1]
                many = min(room // size, n)
                if n < entry[1] * many:
                    # The last items go on filling single sequences one by one.
                    many = many if n >= many else n
                    times = max(n // many, 1)
                else:
                    times = entry[1]
                entry[1] -= times
                items = entry[0]
                if not entry[1]:
                    sequences[room].pop()
                    if not sequences[room]:
                        del sequences[room]
                        open_rooms.pop(at)
                put(room - many * size, items + (size,) * many, times)
            else:
                many = min(capacity // size, n)
                times = max(n // many, 1)
                put(capacity - many * size, (size,) * many, times)
            n -= times * many
    return [(items, times, False) for room in open_rooms for items, times in sequences[room]]


def slots(patterns: list[tuple[tuple[int, ...], int, bool]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): which ranks of a length go to which place."""
    out, next_rank, sequence = [], {}, 0
    for items, times, _ in patterns:
        offset = 0
        for size in items:
            rank = next_rank.get(size, 0)
            out.append((size, rank, times, sequence, offset))
            next_rank[size] = rank + times
            offset += size
        sequence += times
    return out


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, 0.. within each length, without gathering a length in one task.

    Rows are dealt into chunks by a hash of the row, ranked within (length, chunk) and shifted by the
    counts of the earlier chunks. A length gets chunks in proportion to its rows.
    """
    chunks = max(1, -(-max(counts.values(), default=1) // 20_000))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "row"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").count()
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "row")
    return (dealt.withColumn("k", F.row_number().over(within) - 1).join(starts, ["length", "chunk"])
            .withColumn("rank", F.col("first") + F.col("k")).drop("chunk", "k", "first"))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with sequence_id, offset and ``fixed`` (placed by dominance); no piece is lost.

    Pieces without length or with a length beyond the capacity are refused. The result is a function of the set of
    rows: equal rows get the places in any order. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    prepare(spark)
    # Written with a row number, so that the ranks below are the same whenever a task is repeated.
    numbered = staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    bad = numbered.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).limit(1).count()
    if bad:
        raise ValueError("a piece is empty or longer than the capacity")
    counts = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan(counts, capacity)
    fixed_until = sum(times for _, times, fixed in patterns if fixed)
    places = slots(patterns)
    schema = "length long, first_rank long, ranks long, first_sequence long, offset long"
    # Grouped by length: a row of pieces looks its rank up in its length's sorted list.
    plan_table = (spark.createDataFrame(places, schema).groupBy("length")
                  .agg(F.sort_array(F.collect_list(F.struct("first_rank", "ranks", "first_sequence", "offset"))).alias("slots")))
    # At most ``capacity`` rows whose lists hold one entry per planned pattern place: bounded by the capacity.
    found = F.filter("slots", lambda s: (F.col("rank") >= s.first_rank) & (F.col("rank") < s.first_rank + s.ranks))[0]
    placed = ranked(numbered, counts).join(F.broadcast(plan_table), "length").withColumn("slot", found)
    return placed.select(*[c for c in pieces.columns],
                         (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"),
                         F.col("slot.offset").alias("offset"),
                         (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank") < fixed_until).alias("fixed"))

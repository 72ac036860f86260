"""Phrase collocations by best-first branch and bound over the tree of word prefixes.

A phrase's score is bounded by counts of its prefixes: what follows a prefix occurs at most as often as the prefix and as the most
frequent pair that begins with its last word. Prefixes are expanded from the best bound downwards, every round as many as its score
threshold asks for, until each language's last wanted place is settled, ties included. All counts are exact: the
fixed-size bitmaps that go to the tasks only say which phrases may be left out, and let none through that is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from recontact.llm.common import prepare, staged
from recontact.llm.windows import mixed

#: What ends a piece, and what separates words in it. Only A-Z are lower-cased.
ENDS = b".,;:!?\n\x0b\x0c\r"
TOKENS = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
END = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Bytes of a text that are cut into words at once, and words that a task holds before it counts them.
SLICE, HELD = 4 << 20, 1 << 20
#: Text bytes that a task is handed at once, and counted rows that it hands back at once: both stand in the memory of Python and of the JVM.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 15
#: Address bits of the bitmaps: 8 MB each, whatever the corpus holds. A fuller bitmap leaves out less and is as right.
ADDRESS = 26
LEAST, TOP, MILLION = 10, 2000, 1_000_000
FIRST, SECOND = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x9E6C63D0876A9A47)

Held = tuple[list[bytes], np.ndarray, np.ndarray]


class _Words(dict):
    """Numbers from 1 for words as they come; everything that ends a piece is 0."""

    def __init__(self):
        super().__init__()
        self.named = [b""]

    def __missing__(self, token: bytes) -> int:
        number = 0
        if token[0] not in ENDS:
            number = len(self.named)
            self.named.append(token)
        self[token] = number
        return number


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes that end where a piece ends."""
    at = 0
    while at < len(data):
        cut = END.search(data, at + SLICE)
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def _handed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, BATCH_ROWS):
        yield rows.slice(at, BATCH_ROWS)


def _pair_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(hashes[a] * FIRST + hashes[b] * SECOND)


def _count(texts: DataFrame, rows_of: Callable[[str, Held], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``rows_of`` makes of every portion of words that a task gathered for a language.

    It is given the language, the words by number, the text as numbers with 0 between pieces, and a hash per number. Phrases
    never cross a piece, so portions can be cut after any text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, arrays in parts.items():
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words[lang].named], np.uint64)
                numbers = np.concatenate(arrays)
                arrays.clear()
                yield from _handed(rows_of(lang, (words[lang].named, numbers, hashes)))
            words.clear()
            parts.clear()
            # What the columns took goes back, or it stands beside the next portion's words.
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    known = words.setdefault(lang, _Words())
                    for piece in _slices(text.encode().lower()):
                        tokens = TOKENS.findall(piece)
                        # The place behind the last word stays 0.
                        numbers = np.zeros(len(tokens) + 1, np.int64)
                        numbers[:-1] = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                        parts.setdefault(lang, []).append(numbers)
                        held += len(numbers)
                    if held >= HELD:
                        yield from counted()
                        held = 0
        yield from counted()

    return texts.mapInArrow(run, schema)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _pairs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = numbers[:-1], numbers[1:]
    both = (a > 0) & (b > 0)
    return a[both], b[both]


def pair_bitmap(keyed: DataFrame) -> np.ndarray:
    """A bit for every address that a key of the rows has: at most 2 ** (ADDRESS - 6) rows reach the driver."""
    address = F.shiftrightunsigned("key", 64 - ADDRESS)
    words = (keyed.select(F.shiftright(address, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - ADDRESS}) & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (ADDRESS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    address = keys >> np.uint64(64 - ADDRESS)
    return (bits[(address >> np.uint64(6)).astype(np.int64)] >> (address & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the word pairs that occur at least so often, of hashes counted over all texts; never misses one."""
    def rows(lang: str, held: Held) -> pa.RecordBatch:
        _, numbers, hashes = held
        keys, counts = np.unique(_pair_keys(hashes, *_pairs(numbers)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], names=["key", "n"])

    counted = _count(texts, rows, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    return pair_bitmap(counted.where(F.col("n") >= least))


def word_and_pair_counts(texts: DataFrame, pairs: np.ndarray, least: int) -> DataFrame:
    """lang, w1, w2, n, key: pairs of the bitmap, words (w2 null) and the number of all words (both null); exact, from ``least`` on."""
    given = texts.sparkSession.sparkContext.broadcast(pairs)

    def rows(lang: str, held: Held) -> pa.RecordBatch:
        named, numbers, hashes = held
        a, b = _pairs(numbers)
        keys = _pair_keys(hashes, a, b)
        hit = _inside(given.value, keys)
        both, first, counts = np.unique(a[hit] << 32 | b[hit], return_index=True, return_counts=True)
        words = np.bincount(numbers, minlength=len(named))
        single = len(named) - 1
        lefts = [named[i] for i in (both >> 32).tolist()] + named[1:] + [None]
        rights = [named[i] for i in (both & 0xFFFFFFFF).tolist()] + [None] * (single + 1)
        n = np.concatenate([counts, words[1:], [words[1:].sum()]])
        marks = np.concatenate([keys[hit][first].view(np.int64), np.zeros(single + 1, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), _strings(lefts), _strings(rights), pa.array(n), pa.array(marks)],
                                          names=["lang", "w1", "w2", "n", "key"])

    counted = _count(texts, rows, "lang string, w1 string, w2 string, n long, key long")
    summed = counted.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
    return staged(summed.where((F.col("n") >= least) | F.col("w1").isNull()), "phrase-counts")


def triple_counts(texts: DataFrame, prefixes: np.ndarray, pairs: np.ndarray, least: int) -> DataFrame:
    """lang, w1, w2, w3, a: what follows the prefixes of the bitmap, exact, from ``least`` on."""
    given = texts.sparkSession.sparkContext.broadcast((prefixes, pairs))

    def rows(lang: str, held: Held) -> pa.RecordBatch:
        named, numbers, hashes = held
        wanted, frequent = given.value
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        at = at[_inside(wanted, _pair_keys(hashes, a[at], b[at]))]
        at = at[_inside(frequent, _pair_keys(hashes, b[at], c[at]))]
        _, pair = np.unique(a[at] << 32 | b[at], return_inverse=True)
        _, first, counts = np.unique(pair << 32 | c[at], return_index=True, return_counts=True)
        at = at[first]
        columns = [_strings([named[i] for i in w[at].tolist()]) for w in (a, b, c)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *columns, pa.array(counts.astype(np.int64))], names=["lang", "w1", "w2", "w3", "n"])

    counted = _count(texts, rows, "lang string, w1 string, w2 string, w3 string, n long")
    summed = counted.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a"))
    return staged(summed.where(F.col("a") >= least), "triple-counts")


def ratio(a: Column | str, left: Column | str, right: Column | str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10 ** 16; at most a million, as a is at most either part."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    top, below = wide(a) * wide(a) * F.lit(MILLION).cast("decimal(7,0)"), wide(left) * wide(right)
    # The rest is taken off first, so the division is a whole one; a quotient of decimals would be rounded.
    return ((top - top % F.nullif(below, F.lit(0))) / F.nullif(below, F.lit(0))).cast("long")


def scored_pairs(counts: DataFrame) -> DataFrame:
    """lang, w1, w2, a, key, l, r, score, bound, reach of all candidate pairs.

    ``reach`` is the most that any three words beginning with the pair can occur, ``bound`` the most that they can score: cut
    after the first word, the rest occurs at least as often as the whole, so the score is at most a million times reach / l.
    """
    words = counts.where(F.col("w1").isNotNull() & F.col("w2").isNull())
    pairs = counts.where(F.col("w2").isNotNull()).withColumnRenamed("n", "a")
    most = pairs.groupBy("lang", F.col("w1").alias("w2")).agg(F.max("a").alias("most"))
    out = (pairs.join(words.select("lang", "w1", F.col("n").alias("l")), ["lang", "w1"])
           .join(words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r")), ["lang", "w2"])
           .join(most, ["lang", "w2"], "left"))
    out = out.withColumns({"score": ratio("a", "l", "r"), "reach": F.least("a", F.coalesce("most", F.lit(0)))})
    bound = ratio("reach", "l", "reach")
    return staged(out.withColumn("bound", F.when(F.col("reach") > 0, bound).otherwise(F.lit(0))).drop("most"), "pair-scores")


def scored_triples(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, w1, w2, w3, a, l, r, score: the lower of the two cuts' scores, the first cut where they are equal."""
    words = counts.where(F.col("w1").isNotNull() & F.col("w2").isNull())
    pairs = counts.where(F.col("w2").isNotNull())
    out = (triples.join(words.select("lang", "w1", F.col("n").alias("f1")), ["lang", "w1"])
           .join(words.select("lang", F.col("w1").alias("w3"), F.col("n").alias("f3")), ["lang", "w3"])
           .join(pairs.select("lang", "w1", "w2", F.col("n").alias("f12")), ["lang", "w1", "w2"])
           .join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("f23")), ["lang", "w2", "w3"]))
    out = out.withColumns({"early": ratio("a", "f1", "f23"), "late": ratio("a", "f12", "f3")})
    first = F.col("early") <= F.col("late")
    return out.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                      F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"))


def frontier(pairs: DataFrame, floors: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, key of the prefixes that a language's score floor asks to be expanded.

    Those whose continuations may score as much, and those whose continuations may hold a pair that does, from the left or the right.
    """
    here = pairs.join(floors, "lang")
    wanted = here.where(F.col("score") >= F.col("floor"))
    # A pair's drop needs a longer phrase with half of its count, so its left neighbour occurs as often at least.
    need = wanted.groupBy("lang", F.col("w1").alias("w2")).agg(F.min(F.greatest(F.lit(least), F.ceil(F.col("a") / 2))).alias("need"))
    asked = here.join(need, ["lang", "w2"], "left")
    use = (F.col("bound") >= F.col("floor")) | (F.col("score") >= F.col("floor")) | (F.col("a") >= F.col("need"))
    return asked.where((F.col("reach") >= least) & use).select("lang", "w1", "w2", "key")


def survivors(pairs: DataFrame, triples: DataFrame, floors: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score, floor of all candidates from the language's floor on that no longer candidate takes in."""
    longer = (triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer")))
    short = (pairs.join(floors, "lang").where(F.col("score") >= F.col("floor")).join(longer, ["lang", "w1", "w2"], "left")
             .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50)))
    long = triples.join(floors, "lang").where(F.col("score") >= F.col("floor"))
    columns = ["a", "l", "r", "score", "floor"]
    return short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), *columns).unionByName(
        long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), *columns))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` collocations of every language.

    A-Z are lower-cased; texts fall into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs. Candidates are
    two or three words that occur at least ``least`` times inside pieces of a language's texts (a null language is ``und``, a null
    or empty text holds nothing, repeated rows count every time, other columns are not read). Of a candidate's cuts into two parts
    with counts l and r the one with the lowest score floor(1000000 a a / (l r)) counts. Pairs inside a longer candidate with at
    least half of their count are dropped. Order: score, then a, descending, then the phrase by UTF-8 bytes. ``n``: all words of the language.
    A text is cut at ends of pieces, so only a single piece has to fit in memory.
    """
    prepare(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    frequent = frequent_pairs(texts, least)
    counts = word_and_pair_counts(texts, frequent, least)
    pairs = scored_pairs(counts)
    totals = counts.where(F.col("w1").isNull()).select("lang", "n")
    ordered = Window.partitionBy("lang").orderBy(F.col("score").desc(), "w1", "w2")
    # The first floor is a guess from the pairs alone; each next round goes four times as deep, the last one to the ground.
    open_langs, settled, triples, expanded, depth = totals.select("lang"), None, None, None, 2 * top
    while True:
        last = pairs.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= depth).where(F.col("place") == depth)
        floors = staged(open_langs.join(last.select("lang", F.col("score").alias("floor")), "lang", "left").fillna(0, ["floor"]), "floors")
        asked = frontier(pairs, floors, least)
        if expanded is not None:
            asked = asked.join(expanded, ["lang", "w1", "w2"], "left_anti")
        asked = staged(asked, "frontier")
        found = scored_triples(triple_counts(texts, pair_bitmap(asked), frequent, least), counts)
        # A bitmap may have let an expanded prefix through again, with the same exact counts.
        triples = staged(found if triples is None else triples.unionByName(found).distinct(), "triple-scores")
        expanded = asked if expanded is None else staged(expanded.unionByName(asked), "expanded")
        alive = staged(survivors(pairs, triples, floors), "survivors")
        done = alive.groupBy("lang").agg(F.count("*").alias("alive"))
        state = staged(floors.join(done, "lang", "left").withColumn("settled", (F.col("floor") == 0) | (F.coalesce("alive", F.lit(0)) >= top)), "settled")
        ready = alive.join(state.where("settled").select("lang"), "lang")
        settled = ready if settled is None else settled.unionByName(ready)
        open_langs = state.where(~F.col("settled")).select("lang")
        if open_langs.isEmpty():
            break
        depth *= 4
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = settled.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

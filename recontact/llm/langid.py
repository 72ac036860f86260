"""Word-first language identification with character n-gram backoff.

Training counts words per language over all labelled texts; n-grams are counted over those words with their
counts as weights. A known word is scored by its log frequency in each language. An unseen one by the
longest n-grams of it that the model knows, from five characters down to one.

Every counted word is known, whatever the corpus holds: tasks score the most frequent ones from a table of bounded size, the others
are looked up by joining the texts' rare words with the written counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from recontact.llm.common import prepare, staged


def _class_of(kinds: str, first: int, last: int) -> str:
    """A character class of all characters whose Unicode category begins with one of the letters."""
    inside = (c for c in range(first, last + 1) if unicodedata.category(chr(c))[0] in kinds)
    runs = [[c for _, c in run] for _, run in groupby(enumerate(inside), lambda pair: pair[1] - pair[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


def _word_pattern(last: int) -> re.Pattern:
    return re.compile(f"[{_class_of('L', 0, last)}][{_class_of('LM', 0, last)}]{{0,63}}")


#: A word is a letter and the letters and combining marks behind it; runs beyond 64 are several words, so no text grows a long key.
#: The shorter class does for texts without characters beyond the basic plane.
BASIC, WORD = _word_pattern(0xFFFF), _word_pattern(sys.maxunicode)
UNDETERMINED = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Sizes of what every task holds: the most frequent words and n-grams (per order) of each language. Words beyond them are joined.
MAX_WORDS, MAX_GRAMS = 40_000, 10_000
#: Languages are a code set; more are refused.
MAX_LANGS = 500
#: Distinct entries that a counting task holds before it hands them on, and unseen words a scoring task remembers.
HELD = 80_000
#: Sums of joined words are whole numbers of this part of a log unit, so they do not depend on the order of rows.
UNIT = 1e-9
#: Bytes of the batches that pass between Spark and its Python workers, which hold several of them at a time.
BATCH_BYTES = 4 << 20


def _prepare(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words_in(text: str) -> list[str]:
    low = text.lower()
    return (BASIC if low.isascii() or len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low) else WORD).findall(low)


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; single characters without the marks."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies, one row per known word or n-gram and one column per language."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: word, n0, n1, ...: the counts of all words, and the denominators of their frequencies.
    counts: DataFrame | None = None
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.memory: dict[str, np.ndarray | None] = {}

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean log frequency of the word's known n-grams of the longest order that has any; None if no order has."""
        if word not in self.memory:
            if len(self.memory) >= HELD:
                self.memory.clear()
            found = None
            for n in ORDERS:
                rows = [r for gram in grams_of(word, n) if (r := self.grams.get(gram)) is not None]
                if rows:
                    found = self.gram_scores[rows].mean(axis=0)
                    break
            self.memory[word] = found
        return self.memory[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior among the learned ones, by the words and n-grams in memory alone (all, for a small corpus).

        ``und`` and 0.0 where the text is null or has no letter, or nothing was learned. A text whose letters are
        all unknown gives every language the same score; ties go to the first name in order.
        """
        counts = Counter(words_in(text or ""))
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        rows, times, total = [], [], np.zeros(len(self.langs))
        for word, n in counts.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                times.append(n)
            else:
                found = self.unseen(word)
                if found is not None:
                    total += n * found
        if rows:
            total += np.asarray(times, dtype=float) @ self.word_scores[rows]
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.langs[best], float(share[best] / share.sum())


def count_words(labelled: DataFrame) -> DataFrame:
    """lang, word, n over all texts; tasks hand on partial counts of at most ``HELD`` entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def handed() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items()]
            held.clear()
            langs, words, counts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(words_in(text))
                if sum(map(len, held.values())) >= HELD:
                    yield handed()
        yield handed()

    counted = labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, gram, n: character n-grams of the marked words, weighted by the words' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}

        def handed() -> pa.RecordBatch:
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()
            return out

        for batch in batches:
            for lang, word, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n in ORDERS:
                    for gram in grams_of(word, n):
                        held[lang, gram] = held.get((lang, gram), 0) + times
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _below(totals: dict, order: int, langs: list[str]) -> np.ndarray:
    """Denominators of the smoothed frequencies of an order: all counts and half of one more than the most distinct entries of a language."""
    n = np.array([totals.get((lang, order), (0, 0))[0] for lang in langs], dtype=float)
    kinds = max((totals.get((lang, order), (0, 0))[1] for lang in langs), default=1)
    return n + 0.5 * (kinds + 1)


def _frequencies(found: pa.Table, totals: dict, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Places of the items, and the log of their smoothed relative frequency; ``totals``: (lang, order) -> all counts and distinct entries."""
    places = {item: place for place, item in enumerate(found.column("item").to_pylist())}
    orders = found.column("size").to_numpy()
    counts = np.column_stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))]).astype(float)
    out = np.zeros_like(counts)
    for order in set(orders.tolist()):
        at = orders == order
        out[at] = np.log((counts[at] + 0.5) / _below(totals, order, langs))
    return places, out


def _wide(counted: DataFrame, langs: list[str], *keys: str) -> DataFrame:
    """The keys, n0, n1, ...: an item's counts in every language."""
    return counted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)])


def _most_frequent(counted: DataFrame, size, bound: int, langs: list[str]) -> tuple[pa.Table, dict]:
    """item, size, n0, n1, ... (its counts in every language) of about ``bound`` most frequent items per language and order; totals over all items.

    Counts are cut at whole sixteenths of an octave; of the step that crosses the bound the items with the lowest hashes fill what is
    left. Nothing is sorted, no task gets a language's items whole, and what the driver gets does not grow with the corpus.
    """
    sized = counted.withColumn("size", size)
    totals = {(r.lang, r.size): (r.n, r.kinds) for r in sized.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    step = F.floor(F.log2("n") * 16).cast("int")
    room, edges = dict.fromkeys(totals, bound), {}
    for r in sorted(sized.groupBy("lang", "size", step.alias("step")).agg(F.count("*").alias("items")).collect(), key=lambda r: -r.step):
        left = room[r.lang, r.size]
        if left > 0:
            edges[r.lang, r.size] = (r.step, min(1.0, left / r.items))
        room[r.lang, r.size] = left - r.items
    # One row per language and order.
    cuts = F.broadcast(counted.sparkSession.createDataFrame([(*k, *v) for k, v in edges.items()], "lang string, size int, edge int, share double"))
    low = F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    chosen = sized.join(cuts, ["lang", "size"]).where((step > F.col("edge")) | ((step == F.col("edge")) & low)).select("item").distinct()
    return _wide(sized.join(chosen, "item", "left_semi"), langs, "item", "size").toArrow(), totals


def train(labelled: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on the columns lang and text; rows with null in either teach nothing.

    All texts and all words are counted and every counted word is known. ``max_words`` only divides words into those that tasks hold and
    those that are joined; of the n-grams the most frequent ``max_grams`` per order and language serve, as a documented bound. An empty
    table gives a model that answers ``und``. Repeated rows count every time, other columns are not read.
    """
    _prepare(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    words = staged(count_words(usable), "lang-words")
    langs = sorted(r.lang for r in usable.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang are no set of languages")
    model = Model(langs)
    if langs:
        grams = staged(count_grams(words), "lang-grams")
        found, totals = _most_frequent(words.select("lang", F.col("word").alias("item"), "n"), F.lit(0), max_words, langs)
        model.words, model.word_scores = _frequencies(found, totals, langs)
        model.grams, model.gram_scores = _frequencies(*_most_frequent(grams.select("lang", F.col("gram").alias("item"), "n"), F.length("item"), max_grams, langs), langs)
        model.counts, model.below = words, _below(totals, 0, langs)
    return model


class _Places(dict):
    """Rows of the common words' scores; other words get numbers behind them as they come."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.common, self.rare = len(words), []

    def __missing__(self, word: str) -> int:
        self[word] = place = self.common + len(self.rare)
        self.rare.append(word)
        return place

    def forget(self) -> None:
        for word in self.rare:
            del self[word]
        self.rare = []


def _common_scores(places: _Places, scores: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, list[int], list[str], np.ndarray, np.ndarray]:
    """Per text the sum over its common words, and the number of its words; the rare words of each (flat, with counts and ends)."""
    parts = []
    for text in texts:
        words = words_in(text or "")
        parts.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
    sizes = [len(p) for p in parts]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    known = flat < places.common
    sums = np.column_stack([np.bincount(of[known], weights=column[flat[known]], minlength=len(texts)).astype(float) for column in scores.T]) if scores.size else np.zeros((len(texts), scores.shape[1]))
    pairs, counts = np.unique(of[~known] << 32 | (flat[~known] - places.common), return_counts=True)
    ends = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1))
    return sums, sizes, [places.rare[i] for i in (pairs & 0xFFFFFFFF).tolist()], counts, ends


def predict(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The rows, with the columns ``keep`` (all if None), the predicted language and its score (0 to 1).

    Columns of the input that are called like the two new ones are replaced. The text is the only thing looked at: a null text and one without a
    letter are ``und`` with 0; equal chances go to the first language in order. Repeated rows are rows like any other.
    """
    spark, langs = docs.sparkSession, model.langs
    _prepare(spark)
    names = [c for c in (docs.columns if keep is None else keep) if c not in into]
    if not langs:
        return docs.select(*[F.col(f"`{c}`") for c in names], F.lit(UNDETERMINED).alias(into[0]), F.lit(0.0).alias(into[1]))
    # Columns are known by place from here on, so no name clashes.
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields)
    # A text that is kept anyway goes to the tasks once.
    place, width = (names.index(text) if text in names and docs.schema[text].dataType == StringType() else len(names)), len(names)
    if place == width:
        given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("text"))
    # Bounded by max_words and max_grams.
    shared = spark.sparkContext.broadcast((list(model.words), model.word_scores))
    backoff = spark.sparkContext.broadcast((model.grams, model.gram_scores))
    below, n = model.below, len(langs)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, scores = _Places(shared.value[0]), shared.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sums, sizes, rare, counts, ends = _common_scores(places, scores, part.column(place).to_pylist())
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(counts, pa.int64())], names=["word", "times"])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], flat, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                                                 names=[*part.schema.names[:width], "base", "n_words", "rare"])
                if len(places.rare) > HELD:
                    places.forget()

    schema = f"{kinds}base array<double>, n_words long, rare array<struct<word:string,times:long>>"
    partial = staged(given.mapInArrow(common, schema).withColumn("row", F.monotonically_increasing_id()), "lang-partials")
    # What follows reads the written rows: the executors' copies of the table can go.
    shared.destroy()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Model(langs, grams=backoff.value[0], gram_scores=backoff.value[1])
        nothing = np.zeros(n)
        for batch in batches:
            seen = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            logs = np.zeros((batch.num_rows, n))
            counts = np.column_stack([batch.column(3 + i).fill_null(0).to_numpy() for i in range(n)])
            logs[seen] = np.log((counts[seen] + 0.5) / below)
            unseen = np.flatnonzero(~seen)
            words = batch.column(1).take(pa.array(unseen)).to_pylist()
            if words:
                logs[unseen] = [nothing if (found := memory.unseen(w)) is None else found for w in words]
            whole = np.rint(logs * batch.column(2).to_numpy()[:, None] / UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(whole[:, i]) for i in range(n)]], names=["row", *[f"s{i}" for i in range(n)]])

    rare = partial.select("row", F.inline("rare"))
    looked = rare.join(_wide(model.counts, langs, "word"), "word", "left").select("row", "word", "times", *[f"n{i}" for i in range(n)])
    sums = looked.mapInArrow(rest, "row long, " + ", ".join(f"s{i} long" for i in range(n))).groupBy("row").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    totals = F.array(*[F.col("base")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0)) * UNIT for i in range(n)])
    out = partial.drop("rare").join(sums, "row", "left").select(*[f"k{i}" for i in range(len(names))], "n_words", totals.alias("totals"))
    best = F.array_max("totals")
    empty = F.col("n_words") == 0
    lang = F.when(empty, F.lit(UNDETERMINED)).otherwise(F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("totals", best).cast("int")))
    score = F.when(empty, F.lit(0.0)).otherwise(1 / F.aggregate("totals", F.lit(0.0), lambda a, t: a + F.exp(t - best)))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], lang.alias(into[0]), score.alias(into[1]))

"""Secret scans with column functions: fixed patterns, and two character Markov models.

Spans are found with positions although SQL's regular expressions return strings only: the pieces between the matches
(``split``) and the matches themselves (``regexp_extract_all``) come from the same scan, so their running
lengths are the matches' places in code points.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from recontact.llm.common import prepare

#: Kind -> (pattern, group whose length counts, least length). All matches are taken, then short ones dropped.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A run that can only match from its start on gives the same matches with the length in the pattern.
SCANS = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
#: Runs that the models judge: letters, digits and the signs of the usual encodings, long enough to carry a key.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = (*BASE, "random")
#: Symbols of the Markov models: the characters' classes in the order of this alphabet, all others last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Mean log-likelihood ratio (base e, per character pair) from which a run counts as random.
THRESHOLD = 0.35
#: Labelled strings of each class that the models are fitted on: a bound of the fit, not of the search.
SAMPLE = 20_000
#: Different texts that the ordinary strings of the fit are taken from.
SAMPLE_TEXTS = 500


SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, found: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end>> (code points, end exclusive) of the leftmost non-overlapping matches ``found``
    of the pattern in the text; those whose group is shorter than ``least`` are left out."""
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(F.zip_with(gaps, found, lambda g, f: F.struct(F.length(g).alias("gap"), F.length(f).alias("size"))), kept,
                       lambda r, k: F.struct(r["gap"].alias("gap"), r["size"].alias("size"), F.length(k).alias("counted")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        span = F.struct(begin.alias("start"), (begin + row["size"]).alias("end"))
        return F.struct((begin + row["size"]).alias("at"),
                        F.when(row["counted"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    # Most texts hold no match: only the others are cut into pieces.
    return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["spans"]).otherwise(F.array().cast(SPANS))


def codes_of(text: Column) -> Column:
    """Symbols (0..SIZE-1) of the characters of a string column."""
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE)) - 1)


def pairs_of(codes: str) -> str:
    """SQL for the array of neighbouring symbols, one number a pair, of an array column; empty below two."""
    return (f"if(size({codes}) >= 2, transform(sequence(1, greatest(size({codes}) - 1, 1)), "
            f"i -> element_at({codes}, i) * {SIZE} + element_at({codes}, i + 1)), array())")


def labelled_sample(docs: DataFrame, text: str = "text", size: int = SAMPLE, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """sample, random (boolean): at most ``size`` strings of each class, those with the smallest hash.

    Ordinary identifiers are the letter runs of at most ``texts`` documents and their snake and camel joins;
    random strings are digests of the numbers from 0 to ``size`` in the usual alphabets, random by construction. Which documents
    serve is decided by a hash of the text, so the sample does not depend on order or partitions. Copies of a text count
    once, and texts without a run of four letters (null and empty ones among them) never take a place.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    runs = F.array_distinct(F.regexp_extract_all("t", F.lit(r"[A-Za-z]{4,40}"), F.lit(0)))
    named = docs.select(value.alias("t")).where(F.col("t").rlike("[A-Za-z]{4}")).withColumn("h", F.xxhash64("t"))
    # The hashes are chosen alone; only the chosen texts, one of each, are exchanged.
    chosen = named.select("h").distinct().orderBy("h").limit(texts)
    few = named.join(chosen, "h", "left_semi").dropDuplicates(["h"]).select("t")
    words = few.select(runs.alias("words")).select(F.posexplode("words").alias("k", "word"), "words")
    partner = F.element_at("words", F.pmod(F.col("k") * 7 + 3, F.size("words")) + 1)
    joined = (F.when(F.col("k") % 4 == 0, F.concat_ws("_", "word", partner)).when(F.col("k") % 4 == 1, F.concat("word", F.initcap(partner)))
              .when(F.col("k") % 4 == 2, F.concat_ws("-", "word", partner)).otherwise(F.col("word")))
    ordinary = words.select(joined.alias("sample")).distinct().orderBy(F.xxhash64("sample")).limit(size).withColumn("random", F.lit(False))
    digest = F.sha2(F.col("id").cast("string"), 256)
    shown = (F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.base64(F.unhex(digest)))
             .otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")))
    made = spark.range(size).select(shown.alias("sample"), F.lit(True).alias("random"))
    return ordinary.unionByName(made)


def fit(sample: DataFrame) -> list[float]:
    """Log-likelihood ratio of every neighbouring pair (random against ordinary), SIZE * SIZE numbers.

    Each model is a first-order chain: P(b | a) with add-one smoothing over the SIZE symbols. With no sample
    at all every ratio is 0 and nothing is called random.
    """
    coded = sample.select("random", codes_of(F.col("sample")).alias("codes"))
    pairs = coded.select("random", F.explode(F.expr(pairs_of("codes"))).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {True: [[1.0] * SIZE for _ in range(SIZE)], False: [[1.0] * SIZE for _ in range(SIZE)]}
    for r in pairs:  # at most 2 * SIZE * SIZE rows
        counts[r.random][r.pair // SIZE][r.pair % SIZE] += r["count"]
    sums = {k: [sum(row) for row in rows] for k, rows in counts.items()}
    return [log(counts[True][a][b] / sums[True][a]) - log(counts[False][a][b] / sums[False][a]) for a in range(SIZE) for b in range(SIZE)]


def train(docs: DataFrame, text: str = "text") -> list[float]:
    prepare(docs.sparkSession)
    return fit(labelled_sample(docs, text))


def scan(docs: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD, into: str = "found") -> DataFrame:
    """The rows with ``into``: array<struct<start, rank, end>> of all spans, by start and then kind (place in ``KINDS``).

    The base patterns' spans always stay. The models judge runs of at least 20 characters that hold a digit; a run
    is added as ``random`` where its mean ratio a pair reaches the threshold and no base span covers part of it.
    Null texts have no span. One output row per input row, repeated rows included; all columns pass
    (one called like ``into`` is replaced). Write the result before filtering on it: a pushed-down filter would scan again.
    """
    names = docs.drop(into).columns
    if any(n.startswith("_s_") for n in names):
        raise ValueError("column names with _s_ are used inside")
    out = docs.drop(into).withColumn("_s_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumns({f"_s_{kind}": F.regexp_extract_all("_s_text", F.lit(pattern), F.lit(0)) for kind, pattern in SCANS.items()}
                          | {"_s_runs": F.regexp_extract_all("_s_text", F.lit(CANDIDATE), F.lit(0))})
    value = F.col("_s_text")
    out = out.withColumns({f"_s_{kind}": spans_of(value, F.col(f"_s_{kind}"), SCANS[kind], group, least) for kind, (_, group, least) in BASE.items()}
                          | {"_s_runs": spans_of(value, F.col("_s_runs"), CANDIDATE)})
    free = F.expr("filter(_s_runs, r -> NOT exists(concat(_s_assign, _s_access, _s_hex), b -> b.start < r.end AND r.start < b.end))")
    out = out.withColumn("_s_runs", free)
    string = lambda r: F.substring(value, r["start"] + 1, r["end"] - r["start"])
    out = out.withColumn("_s_runs", F.transform(F.filter("_s_runs", lambda r: string(r).rlike("[0-9]")), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), codes_of(string(r)).alias("codes"))))
    values = "array(" + ",".join(f"{v:.5f}D" for v in table) + ")"
    out = out.withColumn("_s_random", F.expr(
        f"filter(_s_runs, r -> aggregate({pairs_of('r.codes')}, 0D, (a, p) -> a + element_at({values}, p + 1)) >= {threshold}D * (size(r.codes) - 1))"))
    ranked = [F.transform(f"_s_{kind}", _with_rank(rank)) for rank, kind in enumerate(KINDS)]
    return out.select(*[F.col(f"`{n}`") for n in names], F.sort_array(F.concat(*ranked)).alias(into))


def _with_rank(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))


def of_kinds(found: Column, ranks: range) -> Column:
    return F.filter(found, lambda s: s["rank"].isin(*ranks))


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, piece).otherwise(state["out"]).alias("out"))

    walked = F.aggregate(found, start, step)
    whole = F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, whole).otherwise(text)

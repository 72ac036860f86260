"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are versions of masks over those bits, so a new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recontact.llm.common import blank_free, staged, words_of

#: The symbols that count as noise.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; null counts as passed


#: A rule's place in the tuple is its bit. New rules go to the end, so stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_cased >= 20 AND 2 * n_upper > n_cased"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
BASE = ("few_words", "repeated_words")
#: Policy versions: the rules a document must not fail.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "shouting", "long_words", "few_letters"),
}


def mask(names: tuple[str, ...]) -> int:
    places = {rule.name: i for i, rule in enumerate(RULES)}
    return reduce(lambda bits, name: bits | 1 << places[name], names, 0)


def windows_of(words: str) -> Column:
    """(hash, place) of every 3-word window of an array column; windows are compared by a 64-bit hash of their words."""
    return F.expr(f"""transform(sequence(1, greatest(size({words}) - 2, 1)),
        i -> named_struct('h', xxhash64(element_at({words}, i), try_element_at({words}, i + 1), try_element_at({words}, i + 2)), 'i', i))""")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``measures``: a struct of counts (long) per text. Null counts as empty text: all counts 0.

    Other columns pass unchanged (one called ``measures`` is replaced; names that begin with ``_q_`` are refused).
    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words inside 3-word windows
    that occur twice or more, the first included. Very long texts are one row each: work is n log n in the words.
    """
    names = docs.columns
    if any(n.startswith("_q_") for n in names):
        raise ValueError("column names with _q_ are used inside")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # One plain column per step: a struct would be taken apart by the optimizer and its parts evaluated per element.
    cut = docs.withColumn("_q_text", value).withColumns({
        "_q_words": words_of(F.col("_q_text")), "_q_lines": F.filter(F.split("_q_text", "\n"), lambda line: F.length(blank_free(line)) > 0)})
    cut = cut.withColumns({"_q_windows": F.when(F.size("_q_words") >= 3, F.sort_array(windows_of("_q_words"))).otherwise(F.array()),
                           "_q_body": F.array_join("_q_words", "")})
    # Equal windows are neighbours in the sorted array.
    twice = F.expr("""sort_array(transform(filter(_q_windows, (w, k) ->
        (k > 0 AND _q_windows[greatest(k - 1, 0)].h = w.h) OR (k < size(_q_windows) - 1 AND _q_windows[least(k + 1, size(_q_windows) - 1)].h = w.h)),
        w -> w.i))""")
    cut = cut.withColumns({"_q_twice": twice, "_q_letters": F.regexp_replace("_q_body", r"[^\p{L}]+", "")})
    covered = F.expr("""aggregate(_q_twice, named_struct('n', 0L, 'upto', 0),
        (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.upto), 'upto', p + 3)).n""")
    upper = F.length(F.regexp_replace("_q_letters", r"\P{Lu}+", ""))
    lower = F.length(F.regexp_replace("_q_letters", r"\P{Ll}+", ""))
    counts = {
        "n_words": F.size("_q_words"), "word_chars": F.length("_q_body"),
        "n_symbols": F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, "")),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")), "n_lines": F.size("_q_lines"),
        "n_repeat_words": covered, "n_letters": F.length("_q_letters"), "n_upper": upper, "n_cased": upper + lower}
    measures = F.struct(*[value.cast("long").alias(name) for name, value in counts.items()]).alias("measures")
    return cut.select(*[F.col(f"`{n}`") for n in names if n != "measures"], measures)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "n_upper", "n_cased")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed`` (long): bit i is set where rule i fails.

    One row per input row: repeated rows and null keys stay, an empty table gives an empty ledger. The ledger is
    written to the shared folder: policies and filters read the stored bits, never the texts.
    """
    measured = measure(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    flat = measured.select("doc_id", *[F.col(f"measures.{m}").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES)]
    return staged(flat.withColumn("failed", reduce(Column.bitwiseOR, bits)), "ledger")


def apply_policy(entries: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: no bit of the policy's mask is set."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return entries.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit((*BASE, *POLICIES[version])))


def ablations(entries: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_only, n_kept, n_kept_without: what each rule of each policy decides.

    One aggregation over the distinct bit patterns (at most 2 ** rules): ``n_only`` documents fail the rule and no
    other of the policy, so ``n_kept_without`` would be kept were it dropped.
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [(version, name, mask(names), mask((name,))) for version, names in POLICIES.items() for name in names]
    rules = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("all"),
                                         F.lit(b).cast("long").alias("bit")) for v, r, m, b in rows])).alias("r")
    seen = patterns.select("n", "failed", rules).withColumn("inside", F.col("failed").bitwiseAND(F.col("r.all")))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    inside, bit = F.col("inside"), F.col("r.bit")
    return (seen.groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule"))
            .agg(total(inside.bitwiseAND(bit) != 0).alias("n_failed"), total(inside == bit).alias("n_only"),
                 total(inside == 0).alias("n_kept"), total((inside == 0) | (inside == bit)).alias("n_kept_without")))

"""Personal data: fixed patterns, and spans that boosted trees choose among candidates.

The base patterns' spans always stay. High-recall generators propose more, overlapping ones: the same digits as a card, a phone number or
an address. Gradient-boosted trees judge every proposal by its format and its neighbourhood; their margin is
calibrated on labelled strings that the trees have not seen, and each kind has the threshold that reaches the wanted precision there.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from recontact.llm.common import prepare, staged

#: The base kinds in their order and their patterns. Possessive runs match as greedy ones do here, in linear time.
BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Added kinds, behind the base ones, and what proposes them. Every run is bounded, so a long text takes linear time.
ADDED = ("near_email", "near_ip", "near_card", "near_phone")
KINDS = (*BASE, *ADDED)
AT = re.compile(r"(?i)(?:[(\[{]\x20?at\x20?[)\]}]|\x20at\x20|\x20?@\x20?)")
GENERATORS = {
    "near_email": re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
                             r"[a-z0-9-]{1,63}(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}){1,4}"),
    "near_ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\.)[0-9]{1,3}){3}(?![0-9])"),
    "near_card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){12,18}(?![0-9])"),
    "near_phone": re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])"),
}
#: Words in the neighbourhood that speak for a kind, and words that speak for a plain number.
CUES = {
    "near_email": ("mail", "contact", "write", "reach"), "near_ip": ("ip", "host", "server", "address"),
    "near_card": ("card", "visa", "credit", "pay"), "near_phone": ("call", "tel", "phone", "fax", "mobile"),
}
PLAIN = ("version", "order", "invoice", "isbn", "section", "ref", "total", "date", "release", "page")
#: Characters on either side that the features see.
AROUND = 40
#: Bounds of the fit: labelled strings, and documents whose words surround them. The search reads every text.
SAMPLE, CONTEXTS = 6_000, 1_000
TREES, DEPTH, PRECISION, HOLDOUT = 20, 4, 0.99, 4
SPANS = "array<struct<rank:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part ends at its @, so each @ has one leftmost start: the run before it, not before the last match."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        # Without a match the run before this @ is not looked at again: the next one begins behind it.
        free = at = found.end() if found else at + 1
        if found:
            yield start, free


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind, start, end) of the base patterns' matches that hold, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind, start, end) of all proposals; proposals of different kinds overlap."""
    out = []
    for rank, (kind, pattern) in enumerate(GENERATORS.items(), len(BASE)):
        if AT.search(text) if kind == "near_email" else DIGIT.search(text):
            out += [(rank, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, rank: int, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - AROUND):start].lower(), text[end:end + AROUND].lower()
    digits = NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    labels = re.split(r"(?i)[\x20.(){}\[\]]+(?:dot[\x20.(){}\[\]]+)?", span)
    edge = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    kind = KINDS[rank]
    seen = [re.findall(r"[a-z]+", before), re.findall(r"[a-z]+", after)]
    has = lambda cues, side: float(any(w.startswith(c) for w in seen[side] for c in cues))
    return [
        *[float(rank == r) for r in range(len(BASE), len(KINDS))],
        float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(set(digits))), float(bool(digits) and luhn(digits)), float(bool(groups) and len(set(groups)) == 1),
        float(len({c for c in span if not c.isalnum()})), float(sum(not c.isalnum() for c in span)),
        float(span[:1] == "0"), float(span[:1] == "("), float(span[:2] in ("19", "20")),
        float(bool(groups) and max(int(g) for g in re.findall(r"[0-9]+", span)) <= 255),
        float(len(labels)), float(2 <= len(labels[-1]) <= 6 and labels[-1].isalpha()),
        float(bool(re.search(r"(?i)[(\[{]\x20?(?:at|dot)|\[\.\]|\(\.\)", span))), float(" at " in span.lower()), float(" dot " in span.lower()), float("@" in span),
        edge(before[-1:]), edge(after[:1]), has(CUES[kind], 0), has(CUES[kind], 1), has(PLAIN, 0), has(PLAIN, 1),
        float(before[-1:] in ("v", "#", "$", ".", "-", "/", "=")), float(bool(re.match(r"[.,/-][0-9]", after))),
    ]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, n: int, right: bool) -> str:
    head = r.choice("3456") + _digits(r, n - 2)
    good = next(d for d in "0123456789" if luhn(head + d))
    return head + (good if right else r.choice([d for d in "0123456789" if d != good]))


def _cut(digits: str, sizes: list[int], sign: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at:at + n])
        at += n
    return sign.join(parts)


def labelled_string(number: int, words: list[str]) -> tuple[str, str, str, bool]:
    """(cue, string, kind, personal): a made string whose class is known from how it was made; the number decides all."""
    r = random.Random(number)
    kind, personal = ADDED[number % 4], bool(number // 4 % 2)
    cue = r.choice(CUES[kind]) if r.random() < (0.6 if personal else 0.15) else r.choice(PLAIN) if r.random() < (0.05 if personal else 0.6) else ""
    name, host = r.choice(words).lower(), r.choice(words).lower()
    end = r.choice(["com", "org", "net", "de", "fr", "es", "io"])
    if kind == "near_email":
        name += r.choice(["", _digits(r, 2), "." + r.choice(words).lower()])
        string = r.choice([f"{name} (at) {host} (dot) {end}", f"{name}[at]{host}.{end}", f"{name} at {host} dot {end}", f"{name} @ {host}.{end}", f"{name}(at){host}(dot){end}"]) \
            if personal else r.choice([f"{name} at {host}.{r.choice(words).capitalize()}", f"{name} at {host}.{_digits(r, 2)}", f"{name} @ {_digits(r, 2)}.{_digits(r, 2)}"])
    elif kind == "near_ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        string = r.choice(["[.]", "(.)", " . "]).join(parts) if personal else r.choice([
            ".".join([str(r.randint(256, 999)), *parts[1:]]), ".".join(parts[:3] + [str(r.randint(256, 999))]), " . ".join([str(r.randint(256, 999)) for _ in range(4)])])
    elif kind == "near_card":
        string = r.choice([_cut(_card(r, 16, True), [4] * 4, r.choice([".", "  ", " - "])), _cut(_card(r, 15, True), [4, 6, 5], r.choice([" ", "-", "."]))]) if personal else r.choice([
            _card(r, 16, False), _cut(_card(r, 16, False), [4] * 4, r.choice([" ", ".", "-"])), _digits(r, r.randint(13, 19)), _cut(_digits(r, 13), [3, 1, 2, 6, 1], "-")])
    else:
        area, line = _digits(r, 3), _digits(r, 4)
        string = r.choice([f"({area}) {_digits(r, 3)}-{line}", f"{area}-{_digits(r, 3)}-{line}", f"0{area} {_digits(r, 3)} {line}", f"00{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 7)}",
                           f"{area}.{_digits(r, 3)}.{line}"]) if personal else r.choice([
            f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", _digits(r, r.randint(7, 15)), f"{r.randint(1, 9)}.{_digits(r, 3)}.{_digits(r, 3)}",
            f"{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)}", f"{_digits(r, 4)} {_digits(r, 4)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2099)}"])
    return cue, string, kind, personal


def labelled_sample(docs: DataFrame, text: str = "text", size: int = SAMPLE, contexts: int = CONTEXTS) -> DataFrame:
    """number, held (boolean), personal (boolean), rank, features: the proposals that the generators make in made sentences.

    ``size`` strings are made by rule, so their class is known. Words around them come from ``contexts`` distinct texts,
    those with the smallest hash. Every fourth string is held out for calibration. Both numbers bound the fit only.
    """
    spark = docs.sparkSession
    value = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where(F.length(F.trim("t")) > 0).withColumn("h", F.xxhash64("t"))
    # At most ``contexts`` numbers.
    few = F.broadcast(value.select("h").distinct().orderBy("h").limit(contexts))
    words = value.join(few, "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")).select("h", F.slice(F.regexp_extract_all("t", F.lit(r"[\p{L}.,;]{2,30}"), F.lit(0)), 1, 400).alias("words"))
    pool = [r.words for r in words.orderBy("h").collect() if r.words] or [["and"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number in batch.column(0).to_pylist():
                r, near = random.Random(-1 - number), pool[number % len(pool)]
                plain = [w for w in ("".join(c for c in w if "a" <= c.lower() <= "z") for w in near) if w] or ["and"]
                cue, string, kind, personal = labelled_string(number, plain)
                left = [r.choice(near) for _ in range(6)] + ([cue + r.choice(["", ":", " is"])] if cue else [])
                head = " ".join(left) + " "
                line = head + string + r.choice([" ", ". ", ", ", "\n", ") "]) + " ".join(r.choice(near) for _ in range(6))
                span = (KINDS.index(kind), len(head), len(head) + len(string))
                rows += [(number, number // 8 % HOLDOUT == 0, personal and c == span, c[0], features(line, *c)) for c in candidates(line)
                         if c[1] < span[2] and span[1] < c[2]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["number", "held", "personal", "rank", "features"])

    made = spark.range(0, size, 1, 4).mapInArrow(run, "number long, held boolean, personal boolean, rank int, features array<double>")
    return staged(made, "labelled-proposals")


@dataclass
class Model:
    """Trees as arrays, one row per tree: feature (-1 at a leaf), threshold, children, value; calibration; a threshold per added kind."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    least: tuple[float, ...] = (1.1,) * len(ADDED)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                low = rows[np.arange(len(rows)), np.maximum(f, 0)] <= self.threshold[t, at]
                at = np.where(f < 0, at, np.where(low, self.left[t, at], self.right[t, at]))
            out += weight * self.value[t, at]
        return out

    def chances(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.offset, -50, 50)))


def _trees(text: str) -> list[list[list]]:
    """Nodes (feature, threshold, left, right, value) of every tree in a fitted model's printed form."""
    trees: list[list[list]] = []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("Tree "):
            trees.append([])
            # Places that wait for a node: (parent, which child).
            waiting: list[tuple[int, int]] = []
        elif trees and line.startswith(("If (", "Predict:")):
            nodes = trees[-1]
            if waiting:
                parent, side = waiting.pop()
                nodes[parent][side] = len(nodes)
            if line.startswith("Predict:"):
                nodes.append([-1, 0.0, 0, 0, float(line.split(":")[1])])
            else:
                feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
                waiting += [(len(nodes), 3), (len(nodes), 2)]
                nodes.append([int(feature), float(bound), 0, 0, 0.0])
    return trees


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out margins, by Newton steps with a small ridge."""
    beta, x = np.zeros(2), np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(sample: DataFrame) -> Model:
    """Boosted trees on the sample's rows that are not held out; calibration and thresholds on the others.

    A kind's threshold is the lowest calibrated chance, at least a half, from which held-out proposals are personal with
    ``PRECISION``; a kind that never reaches it adds nothing.
    """
    # The bounded sample, in one order, so the fit does not depend on partitions.
    rows = (sample.orderBy("number", "rank", "features").coalesce(1)
            .select("held", "rank", F.col("personal").cast("double").alias("label"), "features", array_to_vector("features").alias("vector")))
    rows = staged(rows, "proposal-vectors")
    booster = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=5, cacheNodeIds=False)
    found = booster.fit(rows.where("NOT held").coalesce(1))
    trees = _trees(found.toDebugString)
    most = max(len(t) for t in trees)
    table = np.zeros((len(trees), most, 5))
    for t, nodes in enumerate(trees):
        table[t, :len(nodes)] = nodes
    model = Model(table[..., 0].astype(np.int64), table[..., 1], table[..., 2].astype(np.int64), table[..., 3].astype(np.int64), table[..., 4], np.array(found.treeWeights))
    held = rows.where("held").select("rank", "label", "features").toArrow()
    given = np.array(held.column("features").to_pylist(), float).reshape(held.num_rows, -1)
    labels, ranks = held.column("label").to_numpy(), held.column("rank").to_numpy()
    if not held.num_rows:
        return model
    model.slope, model.offset = _platt(model.margins(given), labels)
    chances, least = model.chances(given), []
    for rank in range(len(BASE), len(KINDS)):
        mine = np.flatnonzero(ranks == rank)
        mine = mine[np.argsort(-chances[mine], kind="stable")]
        right = np.cumsum(labels[mine]) / np.arange(1, len(mine) + 1)
        # Equal chances go in together.
        ends = np.append(np.diff(chances[mine]) != 0, True)[:len(mine)]
        good = np.flatnonzero((right >= PRECISION) & ends & (chances[mine] >= 0.5))
        least.append(float(chances[mine[good[-1]]]) if len(good) else 1.1)
    model.least = tuple(least)
    return model


def train(docs: DataFrame, text: str = "text") -> Model:
    prepare(docs.sparkSession)
    return fit(labelled_sample(docs, text))


def all_spans(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int]]]:
    """Base spans of every text and the added ones, by kind and start.

    An added span shares no character with a base span or with an added one of a better chance (ties: the earlier, then the kind first listed).
    """
    found, asked, rows = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        found.append(base)
        for c in candidates(text):
            if not any(a < c[2] and c[1] < b for _, a, b in base):
                asked.append((i, c))
                rows.append(features(text, *c))
    if rows:
        chances = model.chances(np.array(rows))
        order = sorted((i, -chances[k], c[1], c[0], c[2], c) for k, (i, c) in enumerate(asked) if chances[k] >= model.least[c[0] - len(BASE)])
        for i, *_, c in order:
            if not any(r >= len(BASE) and a < c[2] and c[1] < b for r, a, b in found[i]):
                found[i].append(c)
    return [sorted(spans) for spans in found]


def scan(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, into: str = "found") -> DataFrame:
    """The columns ``keep`` (all if None) with ``into``: array<struct<rank, start, end>> of all spans, places in code points.

    Rank is the kind's place in ``KINDS``; spans go by kind, then start. One output row per input row, repeated rows and null keys
    included; null and empty texts have no span. A column called like ``into`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != into]
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_p_text"))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = [[dict(zip(("rank", "start", "end"), s, strict=True)) for s in row] for row in all_spans(part.column(part.num_columns - 1).to_pylist(), model)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spans, struct)], names=[*part.schema.names[:-1], into])

    return given.mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{into}` {SPANS}")


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(found: Column, ranks: range) -> Column:
    return F.filter(found, lambda s: s["rank"].isin(*ranks))


def redacted(text: Column, found: Column) -> Column:
    """The text with every run of overlapping spans replaced by the name of its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.removeprefix('near_')}]") for k in KINDS])
    by_start = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.element_at(names, span["rank"] + 1))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["start"] >= state["at"], piece).otherwise(state["out"]).alias("out"))

    walked = F.aggregate(by_start, begin, step)
    return F.when(F.size(found) > 0, F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))).otherwise(text)

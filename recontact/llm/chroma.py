"""Chroma fingerprints of audio columns, and their alignment.

Sound becomes frames of twelve pitch classes; rectangle filters over the frames, taken from an integral image, give sixteen
2-bit values, packed into one 32-bit integer per frame. Two recordings are aligned by the offset at which most of
their integers agree, and compared by the bits that differ there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recontact.llm.common import prepare, staged

RATE = 4000
FRAME, HOP = 1024, 256
CLASSES = 12
#: Lowest and highest pitch that counts, in Hz.
LOW, HIGH = 110.0, 1760.0
#: Sixteen filters: shape, first pitch class, number of classes, number of frames. Shapes compare sums of energy:
#: 0 upper and lower half, 1 left and right half, 2 crossed quarters, 3 middle band and rest, 4 middle frames and rest.
FILTERS = tuple((k % 5, (5 * k) % (CLASSES - height + 1), height, width) for k, (height, width) in enumerate(
    (h, w) for w in (4, 8, 12, 16) for h in (3, 6, 9, 12)))
SPAN = max(f[3] for f in FILTERS)
#: Bounds of the four levels of a filter's log ratio, and their Gray codes: neighbouring levels differ in one bit.
LEVELS, GRAY = np.array([-0.4, 0.0, 0.4]), np.array([0, 1, 3, 2], dtype=np.uint32)
#: Two recordings match with at least so many common frames and at most such a share of different bits.
OVERLAP, BIT_ERRORS = 48, 0.15


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the twelve pitch classes per frame, each frame scaled to sum 1; sound shorter than a frame is padded."""
    if not len(samples):
        return np.zeros((0, CLASSES))
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    frequency = np.fft.rfftfreq(FRAME, 1 / rate)
    inside = (frequency >= LOW) & (frequency <= HIGH)
    pitch = np.round(CLASSES * np.log2(frequency[inside] / 440.0)).astype(int) % CLASSES
    energy = power[:, inside] @ np.eye(CLASSES)[pitch]
    total = energy.sum(axis=1, keepdims=True)
    return np.divide(energy, total, out=np.full_like(energy, 1 / CLASSES), where=total > 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer per run of SPAN frames; empty for fewer frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for shape, pitch, height, width in FILTERS:
        top, half, third_p, third_t = pitch + height, width // 2, max(1, height // 3), max(1, width // 3)
        middle = pitch + height // 2
        if shape == 0:
            a, b = area(0, width, pitch, middle), area(0, width, middle, top)
        elif shape == 1:
            a, b = area(0, half, pitch, top), area(half, width, pitch, top)
        elif shape == 2:
            a = area(0, half, pitch, middle) + area(half, width, middle, top)
            b = area(0, half, middle, top) + area(half, width, pitch, middle)
        elif shape == 3:
            a = area(0, width, pitch + third_p, top - third_p)
            b = area(0, width, pitch, top) - a
        else:
            a = area(third_t, width - third_t, pitch, top)
            b = area(0, width, pitch, top) - a
        level = np.searchsorted(LEVELS, np.log((a + 0.01) / (b + 0.01)))
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """(offset, votes): a[i + offset] equals b[i] most often at this offset; the smallest of equals; None without a vote."""
    order = np.argsort(b, kind="stable")
    first, last = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    n = last - first
    if not n.sum():
        return None
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    votes = np.bincount(i - j + len(b))
    return int(np.argmax(votes)) - len(b), int(votes.max())


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(common frames, differing bits) of a[i + offset] and b[i]."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 0, 0
    return hi - lo, int(np.bitwise_count(a[lo + offset:hi + offset] ^ b[lo:hi]).sum())


def render(values: list[float | None] | None, seconds: float = 0.125, rate: int = RATE) -> bytes:
    """16-bit sound of a row of numbers: one note each, the number's sign and size choosing among two octaves.

    Null and non-finite numbers are silent; a null row is no sound.
    """
    numbers = np.array([np.nan if v is None else v for v in values or []], dtype=float)
    if not len(numbers):
        return b""
    finite = numbers[np.isfinite(numbers)]
    scale = np.sqrt((finite ** 2).mean()) if len(finite) else 1.0
    place = np.arctan(np.nan_to_num(numbers, nan=0.0, posinf=0.0, neginf=0.0) / (scale or 1.0)) / np.pi + 0.5
    note = np.minimum((place * 2 * CLASSES).astype(int), 2 * CLASSES - 1)
    t = np.arange(int(seconds * rate)) / rate
    tones = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(2 * CLASSES) / CLASSES))[:, None] * t) * np.hanning(len(t)) ** 0.25
    sound = tones[note] * np.isfinite(numbers)[:, None]
    return (12000 * sound).astype("<i2").tobytes()


def render_vectors(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """rec_id, samples (binary, 16-bit mono at RATE): a media column made of a table's vectors."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(v) for v in part.column(1).to_pylist()], pa.binary())], names=["rec_id", "samples"])

    return vectors.select(F.col(key).alias("rec_id"), F.col(values).cast("array<double>").alias("v")).mapInArrow(run, f"rec_id {kind}, samples binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """row, rec_id, print (binary, little-endian 32-bit integers; empty for null, empty or too short sound)."""
    kind = recordings.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [fingerprint(chroma(np.frombuffer(s or b"", "<i2"))).astype("<u4").tobytes() for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["rec_id", "print"])

    return recordings.select("rec_id", "samples").mapInArrow(run, f"rec_id {kind}, print binary")


def postings(classes: DataFrame) -> DataFrame:
    """class, value, place: one row per integer of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = [np.frombuffer(b, "<u4") for b in part.column(1).to_pylist()]
                sizes = [len(p) for p in prints]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.concatenate(prints).view(np.int32)),
                                                  pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))], names=["class", "value", "place"])

    return classes.where(F.octet_length("print") > 0).select("class", "print").mapInArrow(run, "class long, value int, place int")


def search(recordings: DataFrame, every: int = 100) -> DataFrame:
    """kind, rec_id, class_id, offset, votes, overlap, bit_errors, bit_error_rate.

    ``kind`` "member": one row per recording with its class, the recordings with the same fingerprint (class_id: their smallest rec_id;
    a null rec_id is larger than all). ``kind`` "match": rec_id is a class that holds a query (rec_id divisible by ``every``), class_id
    another class that matches it: at the offset on which most integers agree (the smallest of equals) the overlap is at
    least OVERLAP and the share of differing bits at most BIT_ERRORS. Recordings without an integer are members of a
    class of their own kind and match nothing.
    """
    prepare(recordings.sparkSession)
    prints = staged(fingerprints(recordings), "prints")
    # A print that a third of the recordings share is one partial row per task.
    classes = staged(prints.groupBy("print").agg(F.min("rec_id").alias("class_id"), F.max(F.coalesce(F.col("rec_id") % every == 0, F.lit(False))).alias("asks"))
                     .withColumn("class", F.monotonically_increasing_id()), "print-classes")
    index = staged(postings(classes), "postings")
    asked = index.join(classes.where("asks").select("class"), "class", "left_semi")
    asking = asked.select(F.col("class").alias("query"), "value", F.col("place").alias("query_place"))
    hits = asking.join(index, "value").where("query <> class")
    votes = hits.groupBy("query", "class", (F.col("query_place") - F.col("place")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("query", "class").agg(F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("top"))
    pairs = best.select("query", "class", F.col("top.votes").alias("votes"), (-F.col("top.back")).alias("offset"))
    sides = lambda place, name: classes.select(F.col("class").alias(place), F.col("print").alias(name), F.col("class_id").alias(f"{name}_id"))
    both = pairs.join(sides("query", "asking"), "query").join(sides("class", "found"), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u4") for x in batch.column(c).to_pylist()] for c in ("asking", "found"))
            found = [bit_errors(x, y, o) for x, y, o in zip(a, b, batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("asking_id"), batch.column("found_id"), batch.column("offset").cast(pa.int64()), batch.column("votes"),
                                              pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                             names=["rec_id", "class_id", "offset", "votes", "overlap", "bit_errors"])

    kind = recordings.schema["rec_id"].dataType.simpleString()
    compared = both.mapInArrow(compare, f"rec_id {kind}, class_id {kind}, offset long, votes long, overlap long, bit_errors long")
    rate = F.col("bit_errors") / (32 * F.col("overlap"))
    matches = compared.where(F.col("overlap") >= OVERLAP).withColumn("bit_error_rate", rate).where(F.col("bit_error_rate") <= BIT_ERRORS)
    members = prints.join(classes.select("print", "class_id"), "print").select("rec_id", "class_id")
    columns = ["kind", "rec_id", "class_id", "offset", "votes", "overlap", "bit_errors", "bit_error_rate"]
    return (members.withColumn("kind", F.lit("member")).unionByName(matches.withColumn("kind", F.lit("match")), allowMissingColumns=True).select(*columns))

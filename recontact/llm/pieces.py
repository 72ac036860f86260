"""SentencePiece models on the tokenizers library.

The model's protobuf gives the pieces, their scores, the normaliser and the byte fallback. From them a tokenizers
pipeline is rebuilt for both kinds of models: unigram scores are taken as they are, BPE merges follow from the scores.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recontact.llm.common import prepare, staged

#: Fixed values of the format: the marker that stands for a blank, kinds of models and of pieces.
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of units and ids that a task remembers in each of two generations, runs whose text it remembers, texts and new units that are
#: encoded together, units in a line of them, threads of the library in a task, rows that travel at once.
REMEMBERED, RUNS, BATCH, UNITS_AT_ONCE, LINE, THREADS, ROWS = 24 << 20, 20_000, 256, 4_000, 100, 2, 2_000
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def merges_of(scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, the best result first; ties by the parts' scores."""
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in scores and right in scores:
                found.append((-score, -scores[left], -scores[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


#: Units in which one piece may overlap itself: there the model takes equal scores from the left, which ranked merges cannot say.
PERIODIC = re.compile(r"(.{1,3}?)\1\1", re.DOTALL)


def merged(unit: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a unit: the neighbours whose join scores best are joined, the leftmost of equals, until none scores."""
    parts: list[str | None] = list(unit)
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    queue: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (score := scores.get(joined := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(queue, (-score, i, joined))

    for i in range(len(parts)):
        offer(i)
    while queue:
        _, i, joined = heapq.heappop(queue)
        if parts[i] is None or after[i] < 0 or parts[i] + parts[after[i]] != joined:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = joined, None, after[gone]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Backend:
    """A tokenizers pipeline that encodes and decodes as the SentencePiece model does.

    ``encodes`` and ``reads`` false leave out what only encoding needs, and the texts that ``both`` decodes.
    """

    def __init__(self, model: bytes, encodes: bool = True, reads: bool = True):
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

        parsed = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, trained = parsed.normalizer_spec, parsed.trainer_spec
        self.pieces = [p.piece for p in parsed.pieces]
        ids = {piece: i for i, piece in enumerate(self.pieces)}
        self.scores: dict[str, float] = {}
        self.ids, self.fallback = ids, trained.byte_fallback
        self.unknown = unknown = next(i for i, p in enumerate(parsed.pieces) if p.type == UNKNOWN)
        if trained.model_type == UNIGRAM:
            kind = models.Unigram([(p.piece, p.score) for p in parsed.pieces], unk_id=unknown, byte_fallback=trained.byte_fallback)
        elif trained.model_type == BPE:
            self.scores = {p.piece: p.score for p in parsed.pieces if p.type in (NORMAL, USER)}
            kind = models.BPE(ids, merges_of(self.scores) if encodes else [], unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=trained.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        #: Encodes normalised text.
        self.core = Tokenizer(kind)
        user = [AddedToken(p.piece, normalized=False) for p in parsed.pieces if p.type == USER]
        if user:
            self.core.add_tokens(user)
        steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
        if spec.remove_extra_whitespaces:
            from tokenizers import Regex
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.prefix = spec.add_dummy_prefix
        if spec.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if spec.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        #: No merge and no best path crosses from another sign to the marker if no piece holds that pair.
        self.cuts = not user and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.plain = spec.escape_whitespaces and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        joined = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.core.decoder = decoders.Sequence(joined)
        #: Unit -> ids, as units came since the last turn and as they came before it; how many bytes the first take; units the library reads otherwise.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.differs: set[str] = set()
        self.texts = reads
        #: The library itself, where units are to be compared with it.
        self.library = None
        #: Pieces as they read, which of them need no decoder, which are silent, and decoded runs of the others.
        self.shown = np.array([p.replace(MARK, " ") for p in self.pieces], dtype=object)
        self.reads = np.array([p.type in (NORMAL, UNUSED) for p in parsed.pieces])
        self.silent = np.array([self._silent(i) for i in range(len(self.pieces))])
        self.runs: dict[bytes, str] = {}
        #: Characters that a piece stands for; the first byte of a sign counts for the sign.
        self.widths = np.array([(int(p.piece[3:5], 16) & 0xC0 != 0x80) if p.type == BYTE else len(p.piece) for p in parsed.pieces], dtype=np.int64)
        #: Merges in a line of units are those of its units, and every sign has an id, so the line's ids can be dealt out again.
        self.lines = bool(self.scores) and self.cuts and self.fallback and sum(p.type == BYTE for p in parsed.pieces) == 256

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text)
        marked = text.replace(" ", MARK)
        return MARK + marked if self.prefix and text else marked

    def _learn(self, units: list[str]) -> None:
        """Ids of new units, in batches that the tokenizers library spreads over its threads; where the library is given, compared with it."""
        joined = [u for u in units if self.lines and u[0] == MARK and u[-1] != MARK]
        for group, line in ((joined, LINE), ([u for u in units if not self.lines or u[0] != MARK or u[-1] == MARK], 1)):
            for at in range(0, len(group), UNITS_AT_ONCE):
                self._learn_lines([group[i:i + line] for i in range(at, min(at + UNITS_AT_ONCE, len(group)), line)])

    def _learn_lines(self, lines: list[list[str]]) -> None:
        encoded = self.core.encode_batch_fast(["".join(line) for line in lines], add_special_tokens=False)
        for line, encoding in zip(lines, encoded, strict=True):
            ids = np.array(encoding.ids, dtype="<u4")
            raw, ends = ids.tobytes(), [len(ids)]
            if len(line) > 1:
                # A unit starts with a piece that stands for signs: the last of those ids that start at its place.
                starts = np.cumsum(self.widths[ids]) - self.widths[ids]
                ends = [*(np.searchsorted(starts, list(accumulate(map(len, line[:-1]))), "right") - 1).tolist(), len(ids)]
            first = 0
            for unit, end in zip(line, ends, strict=True):
                # Three equal runs leave at least two signs fewer than places.
                periodic = self.scores and len(unit) - len(set(unit)) >= 2 and PERIODIC.search(unit)
                self.known[unit] = found = array("I", self._periodic(unit)).tobytes() if periodic else raw[4 * first:4 * end]
                self.held += 250 + 3 * len(unit) + len(found)
                first = end
            if self.library is not None:
                self._compare(line)

    def _compare(self, line: list[str]) -> None:
        """Remember the units whose ids the library gives otherwise; a line that it gives otherwise is compared unit by unit."""
        own = np.array(self.library.encode(self._plain("".join(line))), dtype="<u4").tobytes()
        if own == b"".join([self.known[u] for u in line]):
            return
        self.differs.update(u for u in line if np.array(self._own(u), dtype="<u4").tobytes() != self.known[u])

    def _own(self, unit: str) -> list[int]:
        """The library's ids of a unit. Markers alone never are a whole text to it, so they are read behind a sign and its ids taken off."""
        if unit.strip(MARK):
            return self.library.encode(self._plain(unit))
        return self.library.encode("x" + unit.replace(MARK, " "))[len(self.library.encode("x")):]

    def _plain(self, unit: str) -> str:
        """The text that the model's own normaliser turns into the unit."""
        return (unit.removeprefix(MARK) if self.prefix else unit).replace(MARK, " ")

    def _periodic(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in merged(unit, self.scores):
            if piece in self.scores:
                out.append(self.ids[piece])
            elif self.fallback:
                out += [self.ids[f"<0x{b:02X}>"] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def both(self, texts: list[str | None]) -> list[tuple[bytes, str, bool]]:
        """(little-endian unsigned 32-bit ids, text decoded from them, whether the library agrees on every unit) of every text; null counts as empty."""
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        rows = []
        for text in texts:
            normal = self.normalise(text or "")
            rows.append(UNITS.findall(normal) if self.cuts else [normal] if normal else [])
        missing = []
        for unit in set().union(*rows):
            if unit in self.known:
                continue
            if (found := self.older.get(unit)) is None:
                missing.append(unit)
            else:
                self.known[unit] = found
                self.held += 250 + 3 * len(unit) + len(found)
        self._learn(missing)
        out = []
        for units in rows:
            raw = b"".join([self.known[unit] for unit in units])
            out.append((raw, self.decoded(np.frombuffer(raw, "<u4")) if self.texts else "", self.differs.isdisjoint(units)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.both([text])[0][0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; control pieces are silent and one leading blank (the dummy prefix) goes."""
        text = self.core.decode([i for i in ids if not self._silent(i)], skip_special_tokens=False)
        return text[1:] if self.prefix and text[:1] == " " else text

    def _silent(self, i: int) -> bool:
        return self.pieces[i] in ("<s>", "</s>", "<pad>")

    def decoded(self, ids: np.ndarray) -> str:
        """As ``decode``; runs of pieces that need the decoder (bytes, unknown signs, user pieces) are decoded once a task."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.pieces):
            raise ValueError("an id is not in the model")
        ids = ids[~self.silent[ids]]
        special = np.flatnonzero(~self.reads[ids])
        out, at = [], 0
        for run in np.split(special, np.flatnonzero(np.diff(special) > 1) + 1) if len(special) else []:
            out += self.shown[ids[at:run[0]]].tolist()
            at = run[-1] + 1
            values = ids[run[0]:at]
            name = values.tobytes()
            if name not in self.runs:
                if len(self.runs) > RUNS:
                    self.runs.clear()
                self.runs[name] = self.core.decode(values.tolist(), skip_special_tokens=False)
            out.append(self.runs[name])
        text = "".join(out + self.shown[ids[at:]].tolist())
        return text[1:] if self.prefix and text[:1] == " " else text


def _lists(values: bytes, lengths: list[int]) -> pa.ListArray:
    flat = pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(lengths)], pa.int32()), flat)


def _model(path: str) -> bytes:
    """The model file, read on the driver; it travels with the job."""
    with open(path, "rb") as file:
        return file.read()


def _few_rows(spark: SparkSession) -> None:
    """Long texts travel in small batches, whose buffers both sides of a worker hold."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, the columns ``keep``, ids, parity: one row per input row; null text counts as empty, a null key stays null, keys are of any type.

    ``parity``: whether the sentencepiece library gives the same ids. Every text is answered for: every distinct unit is compared when a
    task learns it (no piece crosses units), and texts of models that are not cut into units are compared whole.
    """
    _few_rows(docs.sparkSession)
    model = _model(path)
    given = docs.select(F.col(f"`{key}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        # Read when the library starts its threads: a task has its share of the executor's cores, not all of the machine's.
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        backend = Backend(model, reads=False)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Units can be given to the library only where its normaliser leaves them as they are.
        cut = backend.plain and backend.cuts
        backend.library = library if cut else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(len(names)).to_pylist()]
                found, same = [], []
                for value, (raw, _, agrees) in zip(texts, backend.both(texts), strict=True):
                    if not cut:
                        agrees = np.frombuffer(raw, "<u4").tolist() == library.encode(value)
                    found.append(raw)
                    same.append(agrees)
                ids = _lists(b"".join(found), [len(raw) // 4 for raw in found])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(same, pa.bool_())], names=[*names, "ids", "parity"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, ids array<int>, parity boolean")


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that a column of ids stands for; null ids give null, an id beyond the model is refused."""
    _few_rows(rows.sparkSession)
    model = _model(path)
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = Backend(model, encodes=False)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                column = part.column(place)
                values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = [backend.decoded(values[a:b]) if there else None
                         for a, b, there in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return rows.mapInArrow(run, rows.withColumn(into, F.lit(None).cast("string")).schema)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of what ``encode`` and ``decode`` give: doc_id, n_ids, ids_crc32, n_bytes (byte-fallback ids), decoded_crc32, round_trip, parity.

    ids_crc32 and decoded_crc32 are of the little-endian 32-bit ids and of the decoded UTF-8 text. ``round_trip``: decoding gives
    the text back (false where the normaliser changes it).
    """
    byte_ids = np.array([bool(re.fullmatch(r"<0x[0-9A-F]{2}>", p)) for p in Backend(_model(path)).pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, ends = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            crcs = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in spans], pa.int64())
            n_bytes = pa.array([int(byte_ids[values[a:b]].sum()) for a, b in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), crcs, n_bytes, *batch.columns[2:]],
                                             names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_crc32", "round_trip", "parity"])

    kind = docs.schema[key].dataType.simpleString()
    # Written between the two, so that no executor holds the workers of both; the text is compared by its SHA-256.
    given = F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256).alias("given")
    hashed = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), given)
    encoded = staged(encode(hashed, path, "doc_id", "text", ("given",)), "piece-ids")
    light = decode(encoded, path).select("doc_id", "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                                         (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("given")).alias("round_trip"), "parity")
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, n_bytes long, decoded_crc32 long, round_trip boolean, parity boolean"
    return light.mapInArrow(run, schema)

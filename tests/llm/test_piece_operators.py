import random

import numpy as np
import pytest
import sentencepiece

from conftest_paths import tokenizer
from recontact.llm import pieces

PATH = tokenizer("piece_bpe_32k.model")


def test_ids_and_decoded_texts_are_given_out(documents, odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for docs in (documents, odd):
        rows = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
        assert len(rows) == docs.count()
        assert all(list(r.ids) == library.encode(r.text or "") and r.decoded == (r.text or "") for r in rows)
    assert pieces.decode(pieces.encode(nothing, PATH), PATH).collect() == []


def test_any_ids_decode_as_the_library_does(spark):
    backend = pieces.Backend(open(PATH, "rb").read())
    draw = random.Random(3)
    some = [[draw.randrange(300) if draw.random() < 0.4 else draw.randrange(len(backend.pieces)) for _ in range(draw.randint(0, 30))] for _ in range(500)]
    assert [backend.decoded(np.array(ids, np.int64)) for ids in some] == [backend.decode(ids) for ids in some]
    rows = spark.createDataFrame([(k, ids) for k, ids in enumerate(some)] + [(-1, None)], "k long, ids array<int>")
    found = {r.k: r.decoded for r in pieces.decode(rows, PATH).collect()}
    assert found == {k: backend.decode(ids) for k, ids in enumerate(some)} | {-1: None}


def test_ids_beyond_the_model_are_refused():
    backend = pieces.Backend(open(PATH, "rb").read())
    for bad in (-1, len(backend.pieces)):
        with pytest.raises(ValueError):
            backend.decoded(np.array([5, bad]))


def test_string_keys_and_every_unit_is_compared(spark, documents, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    monkeypatch.setattr(pieces, "UNITS_AT_ONCE", 7)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = documents.selectExpr("concat('k', doc_id) as doc_id", "text")
    rows = pieces.encode(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.parity and list(r.ids) == library.encode(r.text) for r in rows)
    assert all(r.round_trip and r.parity for r in pieces.encode_documents(docs, PATH).collect())


def test_units_in_lines_have_the_ids_they_have_alone(monkeypatch):
    backend, library = pieces.Backend(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert backend.lines
    backend.library = library
    draw = random.Random(8)
    signs = [*"abelnrst.,1é中😀²", "▁", " ", "  ", "ing", "the", "\n", "\x00", "aaa"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    monkeypatch.setattr(pieces, "LINE", 9)
    monkeypatch.setattr(pieces, "REMEMBERED", 5_000)
    for at in range(0, len(texts), 50):
        part = texts[at:at + 50]
        for text, (raw, read, same) in zip(part, backend.both(part), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text) and read == library.decode(library.encode(text)) and same, text


def test_a_wrong_unit_is_reported():
    backend = pieces.Backend(open(PATH, "rb").read())
    backend.library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert all(same for *_, same in backend.both(["the text  here", " é ▁ 😀", ""]))
    backend.library = type("Other", (), {"encode": staticmethod(lambda given, num_threads=1: [1] if isinstance(given, str) else [[1] for _ in given])})
    assert [same for *_, same in backend.both(["quite another sentence", ""])] == [False, True]

import random
import zlib
from array import array

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from conftest_paths import tokenizer
from recontact.llm import pieces


@pytest.fixture(scope="module")
def model():
    with open(tokenizer("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def odd_texts(n, seed=4):
    draw = random.Random(seed)
    signs = [*" \n\tabelnrst.,1▁é中😀²", "  ", "   ", "ing ", "the ", "<s>", "<0x41>", " ▁ "]
    return ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_bpe_parity_and_decoding(model, texts):
    backend, library = pieces.Backend(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [*odd_texts(4000), *list(texts.values())[:60], "", " ", "x" * 3000]:
        ids = backend.encode(text)
        assert ids == library.encode(text), text
        assert backend.decode(ids) == library.decode(ids), text


def test_unigram_parity_with_byte_fallback():
    # Pieces with scores written out as a model file; nothing is trained.
    made = proto.ModelProto()
    entries = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    entries += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    entries += [(p, -float(k) / 3 - 1, pieces.NORMAL) for k, p in enumerate(["▁", "▁the", "ing", "in", "n", "t", "h", "e", "▁t", "he", "a", "an", "g", "i", "▁a", "b", "ab", "▁▁"])]
    for piece, score, kind in entries:
        made.pieces.add(piece=piece, score=score, type=kind)
    made.trainer_spec.model_type, made.trainer_spec.byte_fallback, made.trainer_spec.vocab_size = pieces.UNIGRAM, True, len(entries)
    made.normalizer_spec.name, made.normalizer_spec.add_dummy_prefix = "identity", True
    made.normalizer_spec.remove_extra_whitespaces, made.normalizer_spec.escape_whitespaces = False, True
    raw = made.SerializeToString()
    backend, library = pieces.Backend(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ["the ab ing", "an  angé", "", "zzz the", "théing 😀"]:
        assert backend.decode(backend.encode(text)) == text
        assert backend.decode(backend.encode(text)) == library.decode(library.encode(text))
        assert backend.encode(text) == library.encode(text), text


def test_documents(documents, odd, nothing, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for docs in (documents, odd):
        source = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        rows = sorted(pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model")).collect(), key=lambda r: str(r.doc_id))
        expected = sorted(((k, len(i := library.encode(t or "")), zlib.crc32(array("I", i).tobytes()), zlib.crc32((t or "").encode())) for k, t in source), key=str)
        assert sorted([(r.doc_id, r.n_ids, r.ids_crc32, r.decoded_crc32) for r in rows], key=str) == expected
        assert all(r.round_trip and r.parity for r in rows)
    assert pieces.encode_documents(nothing, tokenizer("piece_bpe_32k.model")).collect() == []

import zlib
from array import array

from tokenizers import Tokenizer

import corpus_pipeline
from conftest_paths import tokenizer
from recontact.llm import packing, queries


def test_pieces_keep_their_ids(documents, odd):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for docs, capacity in ((documents, 1024), (odd, 16)):
        rows = packing.pack(packing.cut_pieces(docs, tokenizer("byte_bpe_50k.json"), capacity), capacity).collect()
        assert all(len(r.ids) == r.length and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32 for r in rows)
        starts = [r for r in rows if r.start == 0]
        ends = {(r.doc_id, r.start + r.length, r.ids[-1]) for r in rows}
        texts = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()]
        assert len(starts) == len(texts) and all((k, len(ids), 2) in ends for k, ids in texts)
        assert sorted(i for r in rows for i in r.ids) == sorted(i for _, ids in texts for i in ids)


def test_pipeline_returns_the_ids_and_only_the_query_is_a_digest(spark, documents):
    packed = corpus_pipeline.pack_sequences(spark, documents, "")
    assert dict(packed.dtypes)["ids"] == "array<int>"
    assert "ids" not in queries.op7_best_fit_packing(spark, "/root/testdata/sf0.001").columns

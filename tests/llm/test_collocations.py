import re
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from recontact.llm import collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        held = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    held[part] = max(held[part], a)
        for p, a in f.items():
            if len(p) < 2 or a < least or 100 * held[p] >= 50 * a and held[p]:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(docs, **more):
    return sorted(tuple(r) for r in collocations.mine(docs, **more).collect())


def test_documents_against_brute_force(documents):
    rows = [(r.lang, r.text) for r in documents.collect()]
    for top in (2000, 40):
        expected = brute(rows, top=top)
        assert found(documents, top=top) == expected and expected


def test_further_rounds_settle_what_drops_leave_open(spark):
    """Every pair is inside a longer phrase, so the first floors keep too few."""
    rows = [("a", f"x{i} y{i} z{i}. q{i % 3} r{i}") for i in range(60) for _ in range(10 + i % 5)] + [("b", "one two, one two")] * 9 + [(None, "One TWO. é É")] * 12
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for top in (3, 10, 25, 300):
        assert found(docs, top=top) == brute(rows, top=top)


def test_portions_do_not_matter(documents, monkeypatch):
    expected = brute([(r.lang, r.text) for r in documents.collect()], top=50)
    monkeypatch.setattr(collocations, "HELD", 1000)
    monkeypatch.setattr(collocations, "SLICE", 50)
    assert found(documents, top=50) == expected


def test_a_full_bitmap_leaves_out_nothing(documents, monkeypatch):
    monkeypatch.setattr(collocations, "ADDRESS", 7)
    assert found(documents, top=50) == brute([(r.lang, r.text) for r in documents.collect()], top=50)


def test_odd_rows(odd, nothing):
    docs = odd.withColumns({"w1": F.lit(1), "n": F.lit("x"), "score": F.lit(None).cast("int")})
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert found(docs, least=2) == brute(rows, least=2)
    assert found(nothing) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["a", None]), st.text(alphabet="abA .\t\n\x0b\x85 é", max_size=60)), max_size=40))
def test_any_text(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=2, top=5) == brute(rows, least=2, top=5)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(9_999_999_999, 9_999_999_999, 9_999_999_998 + 2), (3, 7, 9), (10**15, 10**15, 10**15), (123456789012, 223456789013, 323456789017)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations.ratio("a", "l", "r")).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_counted_rows_are_handed_back_in_bounded_batches(spark, monkeypatch):
    # r03: a portion's counts left the task as one batch, which stood whole in Python and in the JVM.
    rows = pa.RecordBatch.from_pydict({"n": list(range(2 * collocations.BATCH_ROWS + 5))})
    handed = list(collocations._handed(rows))
    assert max(b.num_rows for b in handed) <= collocations.BATCH_ROWS
    assert [n for b in handed for n in b.column(0).to_pylist()] == rows.column(0).to_pylist()
    monkeypatch.setattr(collocations, "HELD", 40)
    monkeypatch.setattr(collocations, "BATCH_ROWS", 3)
    texts = [("en", "a b c. a b d, a b c " * (1 + i % 3)) for i in range(30)] + [(None, "x y z x y")] * 12
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert found(docs) == brute(texts)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == collocations.BATCH_BYTES

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recontact.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(rank, m.start(), m.end()) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(kind, m.group())]


@pytest.fixture(scope="module")
def model(documents):
    return pii.train(documents)


def test_base_spans_of_documents(documents, odd, model):
    for docs in (documents, odd):
        rows = pii.scan(docs, model).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert [tuple(s) for s in r.found if s.rank < 4] == brute(r.text)
        assert set(docs.columns) < set(rows[0].asDict())


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+1 0425%9()é,", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_hard_places():
    for text in ("a@b.c@d.e", "x@@y.z", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "4111  1111", "+1 (487) 555-7209", "+1+2 345678",
                 "é😀 a@b.co.", "+" * 50 + "1" * 40, "1-" * 40 + "1"):
        assert pii.base_spans(text) == brute(text), text
    long = "a" * 300_000 + "@" + "1." * 100_000 + "+" + "1 " * 100_000
    assert pii.base_spans(long)[0][0] == 0 and isinstance(pii.candidates(long), list)


def test_held_out_strings_are_found(documents, model):
    rows = pii.labelled_sample(documents).where("held").collect()
    chances = model.chances(np.array([r.features for r in rows]))
    chosen = np.array([c >= model.least[r["rank"] - 4] for c, r in zip(chances, rows, strict=True)])
    personal = np.array([r.personal for r in rows])
    assert (personal & chosen).sum() >= 0.9 * personal.sum() and (personal & chosen).sum() >= 0.98 * chosen.sum()
    # The calibrated chances say how often they are right.
    for low in (0.0, 0.5):
        part = (chances >= low) & (chances < low + 0.5)
        assert abs(chances[part].mean() - personal[part].mean()) < 0.05


def test_trees_give_what_the_fitted_model_gives(documents):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    rows = pii.labelled_sample(documents, size=800).select("features", array_to_vector("features").alias("v"), F.col("personal").cast("double").alias("label"))
    fitted = GBTClassifier(featuresCol="v", labelCol="label", maxIter=5, maxDepth=pii.DEPTH, seed=1).fit(rows)
    table = np.zeros((5, 31, 5))
    for t, nodes in enumerate(pii._trees(fitted.toDebugString)):
        table[t, :len(nodes)] = nodes
    ours = pii.Model(*(table[..., i].astype(np.int64) if i in (0, 2, 3) else table[..., i] for i in range(5)), np.array(fitted.treeWeights))
    out = fitted.transform(rows).collect()
    margins = ours.margins(np.array([r.features for r in out]))
    assert np.allclose(margins, [r.rawPrediction[1] / 2 for r in out]) or np.allclose(margins, [r.rawPrediction[1] for r in out])


def test_added_spans_and_redaction(spark, model):
    texts = ["please write to jane.doe (at) example (dot) org today", "call (499) 555-6503 now", "pay with card 4111.1111.1111.1111 here", "host 188[.]54[.]39[.]104 is down",
             "order 9807915762804491 came on 2024-01-31", "mail 19@mail5.example.com or +1 (487) 555-7209", "nothing here", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = pii.scan(docs, model).withColumns({"clean": pii.redacted(F.col("text"), F.col("found")), "listed": pii.listed(F.col("found"))}).orderBy("doc_id").collect()
    clean = [r.clean for r in rows]
    assert clean[0] == "please write to [email] today" and clean[1] == "call [phone] now" and clean[2] == "pay with card [card] here" and clean[3] == "host [ip] is down"
    assert clean[4] == texts[4] and clean[5] == "mail [email] or [phone]" and clean[6] == texts[6] and clean[7] is None
    assert rows[5].listed == "email:5:25,phone:29:46" and rows[7].listed == ""


def test_spans_do_not_overlap_added_ones(documents, model):
    for r in pii.scan(documents, model).collect():
        added = sorted((s.start, s.end) for s in r.found if s.rank >= 4)
        base = [(s.start, s.end) for s in r.found if s.rank < 4]
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:], strict=False))
        assert not any(a < d and c < b for a, b in added for c, d in base)


def test_nothing_to_learn_from_or_scan(spark, nothing, odd, model):
    bare = pii.train(nothing)
    assert pii.scan(nothing, bare).collect() == []
    clash = odd.withColumns({"found": F.lit("x"), "rank": F.lit(1), "start": F.lit(None).cast("int"), "features": F.lit(2)})
    rows = pii.scan(clash, model, keep=["doc_id", "rank"]).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {"doc_id", "rank", "found"}
    assert pii.train(odd).least

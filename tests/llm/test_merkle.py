import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from recontact.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    return H(*(shown(row[f] + more if f == "n_chars" and row[f] is not None else row[f]) for f in merkle.FIELDS))


def climb(nodes):
    """Root and, for every node, its siblings with their side."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append(("L" if other < i else "R") + nodes[other] if other < len(nodes) else "")
            at[k] = i // 2
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        roots[g] = climb([leaf_of(r) for r in groups[g]])
    root, above = climb([roots[g][0] for g in order])
    out = []
    for g, tail in zip(order, above, strict=True):
        for i, (r, path) in enumerate(zip(groups[g], roots[g][1], strict=True)):
            ident = r["doc_id"]
            hit = ident is not None and zlib.crc32(str(ident).encode()) % 7 == 0 and r["n_chars"] is not None
            out.append((ident, g, leaf_of(r), leaf_of(r, 1) if hit else None, i, tuple(path + tail), roots[g][0], root))
    return sorted(out, key=repr)


def found(docs, bits):
    return sorted(((r.doc_id, r.lang, r.leaf, r.tampered, r["index"], tuple(r.path), r.subroot, r.root) for r in merkle.manifest(merkle.leaves(docs), bits).collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_documents_against_brute_force(documents, bits):
    assert found(documents, bits) == brute([r.asDict() for r in documents.collect()])


def test_odd_rows(spark, odd, nothing):
    docs = odd.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.when(F.col("n_words") != 3, F.col("n_words")), "word": F.lit(1), "index": F.lit("x"),
                            "grp": F.lit(2), "leaf": F.lit("z")})
    for bits in (2, 12):
        assert found(docs, bits) == brute([r.asDict() for r in docs.collect()])
    assert found(docs.limit(0), 12) == []


def test_repeated_extreme_and_single_ids(spark):
    rows = [(i % 5, "s", "en", i % 3, f"text {i % 4}") for i in range(70)]
    rows += [(i, None, None, i, None) for i in (-(1 << 63), -65, -64, -1, 0, 63, 64, 4096, (1 << 63) - 1)] + [(9, "s", "", None, ""), (None, "s", "é", 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for bits in (2, 12):
        assert found(docs, bits) == brute([r.asDict() for r in docs.collect()])
    one = docs.where("lang = ''")
    (row,) = found(one, 12)
    assert row[5] == () and row[6] == row[7] == row[2]


def test_tampering_is_found(documents):
    rows = merkle.manifest(merkle.leaves(documents))
    out = rows.select("tampered", "root", "leaf", "path", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("again"),
                      merkle.proof_digest(F.col("path")).alias("proof")).collect()
    assert {r.again == r.root for r in out if r.tampered is None} == {True}
    assert {r.again == r.root for r in out if r.tampered is not None} == {False}
    assert all(r.proof == H(*(step[1:] for step in r.path)) for r in out)


def test_one_id_with_many_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 7)
    rows = [(1, "s", "en", 2, "same")] * 40 + [(1, "s", "en", 3, "other")] * 9 + [(2, "s", "en", 3, "x"), (0, "s", "en", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs, 3) == brute([r.asDict() for r in docs.collect()])

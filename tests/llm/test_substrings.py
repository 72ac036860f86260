import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from recontact.llm import substrings
from recontact.llm.windows import WordHasher


def brute(texts, window):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for words in rows:
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                covered[i:i + window] = [True] * window
        kept = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out.append((len(words), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(docs, **options):
    rows = substrings.remove_repeats(docs, **options).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    source = docs.collect()
    expected = [(r.doc_id, *b) for r, b in zip(source, brute([r.text for r in source], options.get("window", 35)), strict=True)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows], key=key) == sorted(expected, key=key)
    return rows


def test_equals_brute_force(documents):
    rows = same(documents)
    assert sum(r.n_removed for r in rows) > 0
    assert all(r.kept_text == r.text for r in rows if not r.n_removed)


@pytest.mark.parametrize("window", [1, 2, 7])
def test_many_blocks_and_short_windows(documents, window):
    same(documents.select("doc_id", "text"), window=window, block_bytes=20_000)


def test_odd_rows(odd, nothing):
    rows = same(odd)
    assert {r.failed for r in rows} == {str(i) for i in (1, 2, None, 3, 4, 5, 6, 7)}
    assert substrings.remove_repeats(nothing).collect() == []


def test_same_document_overlaps_and_hot_passages(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"own{i} text {passage} end{i}") for i in range(60)] + [(100, "a b " * 40), (101, " ".join(["x"] * 36)), (102, passage.upper())]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_bytes=2000)


def test_sketch_never_estimates_too_low():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 1 << 63, 5000).astype(np.uint64)
    keys.sort()
    parts = [keys[p] for _, p in substrings._sliced(keys, 8)]
    assert (np.concatenate(parts) == keys).all()
    for row in range(substrings.ROWS):
        cells = substrings.cells_of(parts[1], row, 1 << 12, 8)
        assert cells.max() < 1 << 12
        sorted_cells, back = substrings.distinct_cells(parts[1], row, 1 << 12, 8)
        assert (sorted_cells == np.unique(cells)).all() and (sorted_cells[back] == cells).all()
        wide = int(np.diff(sorted_cells, prepend=np.uint64(0)).max()) >= 1 << 16
        assert (substrings.unpacked(substrings.packed(sorted_cells), len(sorted_cells), wide) == sorted_cells.astype(np.int64)).all()


def test_window_hashes_depend_on_words_and_order_alone():
    hasher = WordHasher(3)
    words = b"a b c a b c b a".split()
    a, b = hasher.hashes(words)
    assert a[0] == a[3] and b[0] == b[3]
    assert len({*a.tolist()}) == len({tuple(words[i:i + 3]) for i in range(6)})
    other = WordHasher(3).hashes([b"zz", *words])
    assert (other[0][1:] == a).all() and (other[1][1:] == b).all()


def test_candidate_places_come_from_one_sort(monkeypatch):
    # r03: np.unique without counts and a search of every window among all took most of the CPU seconds.
    monkeypatch.setattr(np, "searchsorted", None)
    first = np.array([5, 1, 5, 9, 1, 5], np.uint64)
    second = np.array([7, 2, 6, 3, 2, 7], np.uint64)
    heads, order, a, b = substrings.pair_heads(first, second, np.argsort(first)[:-1])
    assert list(zip(a.tolist(), b.tolist())) == [(1, 2), (1, 2), (5, 6), (5, 7), (5, 7)]
    assert heads.tolist() == [0, 2, 3] and (first[order] == a).all() and (second[order] == b).all()
    # No two windows share the first hash only: the order given stands.
    heads, order, _, _ = substrings.pair_heads(first, first, np.array([4, 1, 0, 2, 5]))
    assert heads.tolist() == [0, 2] and order.tolist() == [4, 1, 0, 2, 5]
    assert substrings.run_heads(np.zeros(0, np.uint64)).tolist() == []


def test_a_word_is_looked_up_once():
    hasher = WordHasher(1)
    hasher.hashes(b"a b a".split())
    assert set(hasher.known) == {b"a", b"b"} and hasher.known[b"c"] == hasher.known.get(b"c")

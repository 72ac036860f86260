import random
import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from conftest_paths import tokenizer
from recontact.llm import packing


def least(items, capacity):
    """The optimum by branch and bound."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k, used in enumerate(bins):
            if used + items[i] <= capacity and used not in bins[:k]:
                place(i + 1, bins[:k] + [used + items[i]] + bins[k + 1:])
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def counted(items):
    return {s: items.count(s) for s in set(items)}


@pytest.mark.parametrize("seed", range(150))
def test_fixed_sets_leave_an_optimal_rest(seed):
    draw = random.Random(seed)
    capacity = draw.randint(5, 30)
    items = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
    patterns = packing.plan(counted(items), capacity)
    assert counted([s for p, n, _ in patterns for s in p * n]) == counted(items)
    assert all(sum(p) <= capacity for p, _, _ in patterns)
    rest = [s for p, n, fixed in patterns if not fixed for s in p * n]
    assert sum(n for _, n, fixed in patterns if fixed) + (least(rest, capacity) if rest else 0) == least(items, capacity)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_equals_item_by_item(seed):
    draw = random.Random(seed)
    capacity = draw.choice([20, 100])
    counts = {draw.randint(1, capacity): draw.randint(1, 40) for _ in range(12)}
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [r for r in rooms if r >= size]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            rooms.append(room - size)
    patterns = packing.best_fit(counts, capacity)
    assert sum(n for _, n, _ in patterns) == len(rooms)
    assert sorted(capacity - sum(p) for p, n, _ in patterns for _ in range(n)) == sorted(rooms)


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_encoder_equals_the_library():
    draw = random.Random(1)
    signs = [*" \n\t ab's'll 1,é中² ́\r", "<|endoftext|>", "  ", "abc"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    encoder, library = packing.Encoder(tokenizer("byte_bpe_50k.json"), 2), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == array("I", [*found.ids, 2]).tobytes()


def check(spark, docs, capacity):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = packing.cut_pieces(docs, tokenizer("byte_bpe_50k.json"), capacity)
    rows = packing.pack(pieces, capacity).collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        expected += [(r.doc_id, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    by = lambda t: tuple((v is not None, v) for v in t)
    assert sorted([tuple(r)[:5] for r in rows], key=by) == sorted(expected, key=by)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def test_whole_documents(spark, documents):
    sequences = check(spark, documents, 1024)
    total = sum(n for places in sequences.values() for _, n in places)
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_odd_rows(spark, odd, nothing):
    check(spark, odd, 16)
    assert packing.pack(packing.cut_pieces(nothing, tokenizer("byte_bpe_50k.json"), 16), 16).collect() == []

import random
from collections import Counter, defaultdict

import numpy as np

from recontact.llm import chosenpath


def brute(rows, threshold=0.8, shingle=5):
    """doc_id -> (copy_id, class_id, n_links) from all pairs of sets."""
    sets = defaultdict(list)
    out = {}
    for key, text in rows:
        words = (text or "").encode().split()
        k = min(shingle, len(words))
        if words:
            sets[frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))].append(key)
        else:
            out[key] = (key, key, 0)
    reps, parent, links = list(sets), list(range(len(sets))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(reps):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(reps):
        for j, n in Counter(j for x in s for j in holders[x] if j != i).items():
            if n >= threshold * (len(s) + len(reps[j]) - n) - 1e-9:
                links[i] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, s in enumerate(reps):
        groups[root(i)] += sets[s]
    for i, s in enumerate(reps):
        for key in sets[s]:
            out[key] = (min(sets[s]), min(groups[root(i)]), links[i])
    return out


def found(docs):
    return {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in chosenpath.with_keys(chosenpath.join(docs)).collect()}


def test_documents(documents):
    assert found(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_near_copies_common_passages_and_large_groups(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(100_000)}"
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join([*(word() for _ in range(100)), passage])) for i in range(250)]
    base = [word() for _ in range(200)]
    for i in range(300, 900):  # more than one tile, and buckets that no split makes small
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(200)] = word()
        rows.append((i, " ".join(copy)))
    for i in range(1000, 1060, 2):  # pairs around the threshold
        text = [word() for _ in range(120)]
        other = list(text)
        for place in range(0, draw.randrange(1, 4)):
            other[10 + 30 * place] = word()
        rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
    rows += [(2000, "one two"), (2001, "one two"), (2002, "one two three"), (2003, ""), (2004, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    ours, expected = found(docs), brute(rows)
    missed = [k for k in expected if ours[k] != expected[k]]
    assert len(missed) <= 1, missed


def test_odd_rows(spark, odd, nothing):
    rows = chosenpath.join(odd).collect()
    assert len(rows) == odd.count()
    five = [r for r in rows if r.doc_id in (5, 6)]
    assert len(five) == 3 and len({r.group_row for r in five}) == 1 and all(r.n_links == 0 for r in rows)
    assert chosenpath.with_keys(chosenpath.join(nothing)).collect() == []


def test_runs_reach_the_target():
    draw = np.random.default_rng(0)
    runs = chosenpath.runs_needed()
    # Pairs at the threshold, their shared tokens chosen level by level, as the recursion does.
    lost = 0
    for _ in range(4000):
        met = False
        for _ in range(runs):
            alive = 1
            for _ in range(chosenpath.DEPTH):
                alive = draw.binomial(round(0.8 * chosenpath.TOKENS), 1 / (0.8 * chosenpath.TOKENS), alive).sum()
            met = met or alive > 0
        lost += not met
    assert lost / 4000 < 0.004


def test_min_hash_estimates_similarity():
    draw = np.random.default_rng(1)
    common, rest = draw.integers(0, 1 << 63, 800).astype(np.uint64), draw.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.concatenate([common, rest[:200]]), np.concatenate([common, rest[200:]])
    share = (chosenpath.min_hashes(np.unique(a)) == chosenpath.min_hashes(np.unique(b))).mean()
    assert abs(share - 800 / 1200) < 0.15

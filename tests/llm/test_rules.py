import re

from recontact.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    starts = {}
    for i in range(len(words) - 2):
        starts.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for places in starts.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(lines), len(covered)


def same(docs):
    found = rules.ledger(docs).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    ours = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) for r in found], key=key)
    assert ours == sorted([(r.doc_id, *brute(r.text)) for r in docs.collect()], key=key)


def test_measurements_equal_brute_force(documents, odd):
    same(documents)
    same(odd)


def test_policies_and_base(documents, nothing):
    entries = rules.ledger(documents)
    for version in rules.POLICIES:
        for r in rules.apply_policy(entries, version).collect():
            base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == base
            assert r.kept == (r.failed & rules.mask(rules.POLICIES[version]) == 0)
    assert rules.apply_policy(rules.ledger(nothing)).collect() == []


def test_clean_documents_stay(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = rules.apply_policy(rules.ledger(documents)).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_ablations_equal_counting(documents):
    entries = rules.ledger(documents).cache()
    bits = [r.failed for r in entries.collect()]
    found = {(r.policy, r.rule): r for r in rules.ablations(entries).collect()}
    assert len(found) == sum(map(len, rules.POLICIES.values()))
    for (version, name), r in found.items():
        whole, one = rules.mask(rules.POLICIES[version]), rules.mask((name,))
        assert r.n_failed == sum(b & one != 0 for b in bits)
        assert r.n_only == sum(b & whole == one for b in bits)
        assert r.n_kept == sum(b & whole == 0 for b in bits)
        assert r.n_kept_without == sum(b & whole & ~one == 0 for b in bits)
    entries.unpersist()


def test_no_python_in_the_plan(documents):
    plan = rules.measure(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

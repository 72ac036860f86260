import numpy as np

from recontact.llm import chroma


def melody(seed, n=64):
    return np.random.default_rng(seed).normal(0, 1, n).tolist()


def sound(values):
    return np.frombuffer(chroma.render(values), "<i2")


def printed(samples):
    return chroma.fingerprint(chroma.chroma(samples))


def test_pitch_classes_of_tones():
    t = np.arange(chroma.RATE) / chroma.RATE
    for k in range(12):
        frames = chroma.chroma((9000 * np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t)).astype(np.int16))
        assert (frames.argmax(axis=1) == k).all() and np.allclose(frames.sum(axis=1), 1)


def test_integral_image_equals_sums():
    frames = np.random.default_rng(0).random((40, 12))
    out = chroma.fingerprint(frames)
    assert len(out) == 40 - chroma.SPAN + 1
    for i in (0, 7, len(out) - 1):
        bits = 0
        for shape, p, h, w in chroma.FILTERS:
            f = frames[i:i + w, p:p + h]
            m, hw, tp, tw = h // 2, w // 2, max(1, h // 3), max(1, w // 3)
            a = {0: f[:, :m], 1: f[:hw], 2: None, 3: f[:, tp:h - tp], 4: f[tw:w - tw]}[shape]
            first = f[:hw, :m].sum() + f[hw:, m:].sum() if shape == 2 else a.sum()
            ratio = np.log((first + 0.01) / (f.sum() - first + 0.01))
            bits = bits << 2 | int(chroma.GRAY[np.searchsorted(chroma.LEVELS, ratio)])
        assert out[i] == bits


def test_alignment_of_a_cut_and_noisy_recording():
    whole = sound(melody(1))
    cut = whole[20 * chroma.HOP:]
    noisy = (cut + np.random.default_rng(2).normal(0, 300, len(cut))).astype(np.int16)
    a, b = printed(whole), printed(noisy)
    offset, votes = chroma.align(a, b)
    overlap, bits = chroma.bit_errors(a, b, offset)
    assert offset == 20 and votes > 5 and overlap == len(b) and bits / (32 * overlap) < chroma.BIT_ERRORS
    assert chroma.align(a, np.zeros(0, np.uint32)) is None


def planted(spark):
    """Recordings: queries (multiples of 100) with cuts, noisy versions and copies, among unrelated ones."""
    rows, draw = [], np.random.default_rng(9)
    for i in range(0, 500, 100):
        whole = sound(melody(i))
        rows += [(i, whole), (i + 1, whole), (i + 2, whole[(8 + i // 50) * chroma.HOP:]),
                 (i + 3, (whole + draw.normal(0, 200, len(whole))).astype(np.int16)), (i + 4, (0.4 * whole).astype(np.int16))]
    rows += [(1001 + k, sound(melody(5000 + k))) for k in range(60)]
    extra = [(None, None), (7001, None), (7002, b""), (7003, b"\0" * 100), (None, rows[0][1].tobytes())]
    return spark.createDataFrame([(k, s.tobytes(), 1) for k, s in rows] + [(k, s, 2) for k, s in extra], "rec_id long, samples binary, votes int")


def test_search_reaches_brute_force(spark):
    recordings = planted(spark)
    found = chroma.search(recordings).collect()
    prints = {r.rec_id: printed(np.frombuffer(r.samples or b"", "<i2")) for r in recordings.collect() if r.rec_id is not None}
    members = [r for r in found if r.kind == "member"]
    assert len(members) == recordings.count()
    of = {r.rec_id: r.class_id for r in members if r.rec_id is not None}
    for k, p in prints.items():
        assert of[k] == min(j for j, q in prints.items() if p.tobytes() == q.tobytes())
    expected = set()
    for a in {of[k] for k in prints if k % 100 == 0}:
        for b in {*of.values()} - {a}:
            rates = [(e / (32 * n)) for o in range(-len(prints[b]), len(prints[a])) for n, e in [chroma.bit_errors(prints[a], prints[b], o)] if n >= chroma.OVERLAP]
            if rates and min(rates) <= chroma.BIT_ERRORS:
                expected.add((a, b))
    ours = {(r.rec_id, r.class_id) for r in found if r.kind == "match"}
    assert len(expected) >= 10 and len(ours & expected) >= 0.9 * len(expected) and ours <= expected


def test_vectors_and_odd_rows(spark, nothing):
    vectors = spark.createDataFrame([(0, [0.1, None, float("nan"), 2.0] * 16, "x"), (1, None, "x"), (2, [], None), (None, [1.0] * 64, "y"), (None, None, None)],
                                    "vec_id long, embedding array<float>, samples string")
    found = chroma.search(chroma.render_vectors(vectors)).collect()
    assert sum(r.kind == "member" for r in found) == 5 and not any(r.kind == "match" for r in found)
    assert chroma.search(chroma.render_vectors(vectors.limit(0))).collect() == []

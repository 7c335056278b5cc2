import random

import numpy as np

from quire.llm import minhash
from quire.llm.components import connected_components
from tests.llm.corpus import edges, frame, sentence


def brute(rows, threshold=75):
    """Union-find over all pairs of full sets."""
    sets = [minhash.shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                u, v = find(rows[i][0]), find(rows[j][0])
                parent[max(u, v)] = min(u, v)
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets)}


def check(spark, texts):
    out = minhash.near_duplicates(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == brute(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_edges(spark):
    check(spark, edges())


def test_chain_and_hot_group(spark):
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(60)]
    base = sentence(rng, 60).split()
    for i in range(120):  # near copies of one text, and a chain that drifts away from it
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(9)}"
        texts.append(" ".join(w))
    for i in range(20):
        base = base[2:] + [f"c{i}", f"d{i}"]
        texts.append(" ".join(base))
    rng.shuffle(texts)
    check(spark, texts)


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(6)
    base = sentence(rng, 50).split()
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(50)] = f"q{i}"
        texts.append(" ".join(w))
    check(spark, texts)
    # A large group of copies beside strays that share a band with it, near and far.
    copies = []
    for i in range(40):
        w = list(base)
        w[49] = f"end{i}"
        copies.append(" ".join(w))
    strays = [" ".join(base[:k] + sentence(rng, 50 - k, "z").split()) for k in (20, 30, 35, 40, 43, 45, 46, 47) for _ in range(3)]
    check(spark, copies + strays)
    check(spark, strays + copies + texts)


def test_empty_null_ids_and_repeated_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (9, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True), (9, 3, False)]


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.75, 0.9):
        n = 2000
        both = rng.integers(0, 2**63, int(n * j), dtype=np.uint64)
        rest = rng.integers(0, 2**63, n - len(both), dtype=np.uint64)
        half = len(rest) // 2
        a, b = np.concatenate([both, rest[:half]]), np.concatenate([both, rest[half:]])
        sig = [np.frombuffer(minhash.pack(minhash.minima(x)), np.uint64) for x in (a, b)]
        assert abs(minhash.estimate(sig[0], sig[1][None, :])[0] - j) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    out = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.node, r.component) for r in out} == {(i, 0) for i in range(31)} | {(i, 100) for i in (100, 101, 102)}

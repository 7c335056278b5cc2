import random
import re
from collections import Counter

import numpy as np

from quire.llm import quality
from tests.llm.corpus import SCHEMA, edges, frame, sentence


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return [
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(inside),
    ]


def test_statistics_against_brute_force(spark):
    rng = random.Random(2)
    texts = edges() + ["a # b ** c\n\n a # b ** c\n \n\x0b\n\x1c\nx\x85y  z", "<p>|&%$</p>", "é\x0cé\r\né"]
    texts += ["for you and half", "\x0cabc def", "abc\x0c", "ff\nff\nabc", "f", "\x0c", "\x0b\x0cff\x0b", "f\nf\n\x0c\nf\x0c", "uf 000b", "\\f \\n"]
    for _ in range(40):
        block = sentence(rng, rng.randrange(5, 12), rng.choice("ab"))
        texts.append(" ".join(rng.choice([block, sentence(rng, rng.randrange(1, 9)), "x", "x\n" + block + "\n"]) for _ in range(rng.randrange(1, 12))))
    out = {r.doc_id: r for r in quality.quality(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r, want = out[i], statistics(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality(frame(spark, [])).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        junk = i % 10 == 0
        words = sentence(rng, rng.randrange(30, 300), "word").split()
        text = " | ".join(words) if junk else " ".join(words)
        rows.append((i, text, "en" if i % 2 else None, None if i % 3 == 0 else "hot", 1, "x", "k", "n", "s", "p", 7, 8))
    out = quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out if not r.kept} == {i for i in range(400) if i % 10 == 0}


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.quality(docs).where("NOT base_failed AND distance2 IS NOT NULL").join(labels, "doc_id")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.998 * good.count()
    assert bad.where("NOT kept").count() >= 0.95 * bad.count()


def test_estimate_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 6)) * np.array([3, 2, 1, 1, 1, 1]) + np.array([5, 4, 0, 0, 0, 1])
    x[:, 1] += 0.5 * x[:, 0]
    x[: n // 8] += 40  # far cluster that a plain covariance would take in
    rows = [("g", *map(float, r)) for r in x]
    est = quality.covariance_estimates(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double, x5 double, x6 double")).first()
    clean = x[n // 8 :]
    assert np.allclose([est[f"m_x{i}"] for i in range(1, 7)], clean.mean(axis=0), atol=0.3)
    low = np.array([[est[f"l_x{i}_x{j}"] if j <= i else 0.0 for j in range(1, 7)] for i in range(1, 7)])
    ratio = np.linalg.det(low @ low.T) / np.linalg.det(np.cov(clean.T))
    assert 0.3 < ratio < 3


def test_determinant_is_no_larger_than_by_brute_force(spark):
    """From 60 random starts the same steps in numpy find no core with a much smaller determinant."""
    rng = np.random.default_rng(8)
    n = 400
    x = np.abs(rng.normal(size=(n, 6))) + np.array([5, 4, 0, 0, 0, 0])
    x[:150] = np.abs(rng.normal(size=(150, 6))) * 0.3 + np.array([9, 9, 3, 3, 3, 3])
    est = quality.covariance_estimates(spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x1 double, x2 double, x3 double, x4 double, x5 double, x6 double")).first()
    h, least, best = int(n * quality.CORE), np.diag([v**2 for v in quality.FEATURES.values()]), np.inf
    for _ in range(60):
        core = x[rng.choice(n, 7, replace=False)]
        for _ in range(30):
            cov = quality.CONSISTENCY * np.cov(core.T, bias=True) + least
            e = x - core.mean(axis=0)
            core = x[np.argsort((e @ np.linalg.inv(cov) * e).sum(axis=1))[:h]]
        best = min(best, np.linalg.slogdet(quality.CONSISTENCY * np.cov(core.T, bias=True) + least)[1])
    assert est.logdet <= best + 0.05


def test_limit_is_the_chi_square_quantile():
    for tail, want in ((0.025, 14.4494), (0.25, 7.8408), (0.5, 5.3481), (1e-12, 68.1047)):
        assert abs(quality.chi2_reach(tail) - want) < 1e-3


def test_quantiles_in_bins(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, rng.random(), rng.expovariate(0.01), 3.0])) for g in "aab" for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.25, 0.5, 0.75, 1.0):
        got = {r.g: r.q for r in quality._quantile(df, ["g"], "v", share, "q").collect()}
        for g in "ab":
            v = sorted(x for k, x in rows if k == g)
            want = v[max(0, int(np.ceil(share * len(v))) - 1)]
            assert want <= got[g] <= (want + 0.001) * 2 ** (1 / quality.BINS)


def test_small_groups_are_judged(spark):
    """Junk in groups of any size goes, clean texts stay, and every document has a distance."""
    rng = random.Random(6)
    sizes = {("en", f"big{k}"): 120 for k in range(3)} | {("en", f"s{k}"): k for k in (1, 2, 3, 5, 8, 20, 49, 50, 51)} | {("xx", "t"): 1, ("yy", "t"): 2, (None, None): 3}
    rows, junk = [], set()
    for (lang, source), n in sizes.items():
        for j in range(n):
            i = len(rows)
            words = sentence(rng, rng.randrange(30, 300), "word").split()
            if j % 10 == n - 1 or (n == 3 and j == 2):
                junk.add(i)
            text = " *** ".join(words) if i in junk else " ".join(words)
            rows.append((i, text, lang, source, 1, "x", "k", "n", "s", "p", 7, 8))
    out = quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out if not r.kept} == junk and len(junk) > 5
    assert all(r.distance2 is not None for r in out)

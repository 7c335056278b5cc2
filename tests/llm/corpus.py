"""Small inputs for the corpus operators: nulls, empty, long and repeated texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, n string, s string, p string, rep long, band long"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "x", "k", "n", "s", "p", 7, 8) for i, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def sentence(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


def edges(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 80)
    words = base.split()
    near = " ".join(words[:70] + ["other"] * 3 + words[73:])
    far = " ".join(words[:40] + sentence(rng, 40, "z").split())
    return [None, "", " \n\t", "one", "one", "One  two\nthree", base, base, near, far, base.upper(), sentence(rng, 30_000), "é ß 語  x 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "a" * 5000]

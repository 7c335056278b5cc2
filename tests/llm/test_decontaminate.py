import random

from quire.llm import decontaminate as dec
from tests.llm.corpus import edges, frame, sentence


def distance(window, text):
    """Fewest edits of the window against any part of the text (full table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def brute(docs, items):
    out = set()
    for i, t in docs:
        text = dec.normal(t).encode()
        for k, x in items:
            for _, w in dec.windows(dec.normal(x).encode()):
                if distance(w, text) <= dec.budget(len(w)):
                    out.add((i, k))
    return out


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        p = rng.randrange(len(text))
        how = rng.randrange(3)
        text[p : p + (how != 0)] = ["x"] if how < 2 else []
    return "".join(text)


def test_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.randrange(6, 40))) for k in range(8)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for i in range(90):
        t = sentence(rng, rng.randrange(0, 40))
        if i % 3:
            passage = items[rng.randrange(8)][1]
            passage = edited(rng, passage, rng.randrange(0, 14))
            t = t + " " + (passage.upper() if i % 2 else passage.replace(" ", "\n ")) + " " + sentence(rng, 10)
        docs.append((i, t))
    got = spark.createDataFrame(docs, "doc_id long, text string")
    got = dec.find_passages(got, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert 20 < len(want)
    for r in got:
        assert 0 <= r.start < r.end <= len(docs[r.doc_id][1])


def test_place_of_an_exact_passage(spark):
    rng = random.Random(9)
    item = sentence(rng, 30)
    text = "É before \t it\n" + item.replace(" ", "  ") + "\n and after"
    r = dec.find_passages(frame(spark, [text]), spark.createDataFrame([(4, item)], "item_id long, text string")).first()
    assert text[r.start : r.end].split() == item.split() and r.edits == 0


def test_edges_blocks_and_cleaning(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, sentence(rng, 25, f"v{k}")) for k in range(6)]
    texts = edges() + [x for _, x in items] * 3 + [sentence(rng, 3000) + " " + items[2][1] + " end"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in dec.find_passages(frame(spark, texts), bench).collect()}
    n = len(edges())
    assert one == {(n + i, i % 6) for i in range(18)} | {(n + 18, 2)}
    monkeypatch.setattr(dec, "BLOCK_BYTES", 200 * dec.INDEX_BYTES)
    assert {(r.doc_id, r.item_id) for r in dec.find_passages(frame(spark, texts), bench).collect()} == one
    kept = dec.clean(frame(spark, texts), bench)
    assert kept.columns == frame(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == set(range(n))
    assert dec.find_passages(frame(spark, []), bench).count() == 0
    assert dec.find_passages(frame(spark, texts), bench.limit(0)).count() == 0
    assert dec.contaminated(frame(spark, texts), bench).where("kept OR NOT contaminated").count() == 0


def test_alignment_against_full_table():
    rng = random.Random(12)
    for _ in range(150):
        w = bytes(rng.choices(b"abcd", k=40))
        region = bytes(rng.choices(b"abcd", k=rng.randrange(0, 12))) + edited(rng, w.decode(), rng.randrange(0, 6)).encode() + bytes(rng.choices(b"abcd", k=10))
        want, got = distance(w, region), dec.align(w, region, 5, 20)
        assert (got is None) == (want > 5)
        if got:
            assert got[2] == want and distance(w, region[got[0] : got[1]]) == want


def test_every_passage_of_an_item_at_any_offset():
    """Quotes are cut from the item here, not taken from the operator's windows."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyzäßéñ語"
    item = " ".join("".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(60))[:300].strip()
    index = dec.build_index([(7, item), (8, sentence(rng, 60))])
    other = lambda: "".join(rng.choices(letters, k=150))
    for size in (128, 160):
        quotes = [item[s : s + size] for s in range(len(item) - size + 1)]
        docs = [f"{other()}{q.strip()}{other()}" for q in quotes]
        long = [i for i, q in enumerate(quotes) if len(q.strip()) >= 128]
        got = {(i, k) for i, k, *_ in dec.search(index, list(range(len(docs))), docs)}
        assert {(i, 7) for i in long} <= got and len(long) > 60
        assert all(k == 7 for _, k in got)
    # Ten replaced characters, eight in a hundred, spread or not, at any offset.
    docs, want = [], set()
    for i in range(120):
        s, edits = rng.randrange(len(item) - 127), rng.choice((7, 10, 10, 10, 11, 16, 30))
        q = list(item[s : s + 128])
        for p in rng.sample(range(128), edits):
            q[p] = "#"
        docs.append(other() + "".join(q) + other())
        t = dec.normal(docs[-1])
        if any(distance(item[a : a + 128], t[100:330]) <= 10 for a in range(max(0, s - 6), min(s + 7, len(item) - 127), 3)) or distance(item[s : s + 128], t) <= 10:
            want.add(i)
    got = {i for i, *_ in dec.search(index, list(range(len(docs))), docs)}
    assert want <= got and len(want) > 40
    assert all(distance_of_any(item, docs[i]) for i in sorted(got - want)[:3])


def distance_of_any(item, doc):
    return any(distance(item[a : a + 128], dec.normal(doc)) <= 10 for a in range(len(item) - 127))


def test_repetitive_texts_in_slices(monkeypatch):
    """Few hits at once and shortened runs change nothing but the number of places."""
    rng = random.Random(14)
    line = "-" * 60
    items = ["-" * 400, "=-" * 150, ("| ab " * 60), (line + " ") * 6, sentence(rng, 40), "".join(rng.choices("ab", k=300))]
    docs = ["-" * 700, "x" + "=-" * 400 + "y", "| ab " * 200 + items[4] + "| ab " * 30, (line + "\n") * 13, "".join(rng.choices("ab", k=400)) + items[5][90:250], "", "-" * 127, items[4] + "-" * 700 + items[4], "\n" * 2000]
    brief = lambda: sorted(x[:5] for x in dec.search(dec.build_index(list(enumerate(items))), list(range(len(docs))), docs))
    now = brief()
    assert {(0, 0), (1, 1), (2, 2), (2, 4), (3, 3), (4, 5), (7, 0), (7, 4)} <= {x[:2] for x in now}
    assert (0, 0, 0, 700, 0) in now and (1, 1, 0, 802, 0) in now
    monkeypatch.setattr(dec, "HITS", 40_000)
    assert brief() == now
    monkeypatch.setattr(dec, "_PERIOD", 0)
    assert brief() == now


def test_long_run_takes_little_memory():
    import tracemalloc

    index = dec.build_index([(1, "-" * 600)])
    for text in ("-" * 80_000, "".join(random.Random(3).choices(["-" * 40, "- " * 20, "x"], k=150))):
        tracemalloc.start()
        assert [x[:2] for x in dec.search(index, [5], [text])] == [(5, 1)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300_000_000


def test_short_items_rows_without_id_and_item_without_id(spark):
    items = [(1, "Yes, it is"), (2, "no"), (3, "seventeen characters"), (None, "a passage without an item_id of its own")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["well, YES,  it is so", "nothing else", "17 seventeen chbracters", "x a passage without an item_id of its own y", None, ""]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in dec.find_passages(docs, bench, least=1).collect()}
    assert set(out) == {(0, 1), (1, 2), (2, 3), (None, 0)}
    assert texts[0][out[0, 1].start : out[0, 1].end] == "YES,  it is" and out[2, 3].edits == 1
    assert {(r.doc_id, r.item_id) for r in dec.find_passages(docs, bench).collect()} == {(None, 0)}
    assert [r.doc_id for r in dec.clean(docs, bench).collect()] == [0, 1, 2, 4, 5]
    assert [r.doc_id for r in dec.clean(docs, bench, least=1).collect()] == [4, 5]

"""Set-based plans against literal folds on random inputs."""

import math
import random

from quire.operators import markdown, pages, toc, tree

RNG = random.Random(17)


def test_islands(spark):
    rows, want = [], set()
    for doc in range(120):
        answers = RNG.choices(["yes", "no", "maybe"], k=RNG.randrange(0, 14))
        rows += [(doc, i, a) for i, a in enumerate(answers)]
        inside, i, start = False, 0, 1
        i = start
        while i < len(answers):  # scan page by page
            if i >= 5 and not inside:
                break
            if answers[i] == "yes":
                want.add((doc, i))
                inside = True
            elif answers[i] == "no" and inside:
                break
            i += 1
    out = toc.islands(spark.createDataFrame(rows, "doc_id int, page int, answer string"), 5, 1).collect()
    assert {(r.doc_id, r.page) for r in out} == want


def literal_chunks(tokens, budget, overlap):
    total = sum(tokens)
    if total <= budget:
        return [(0, len(tokens) - 1)]
    aim = math.ceil((total / math.ceil(total / budget) + budget) / 2)
    out, lo, n = [], 0, 0
    for i, x in enumerate(tokens):
        if n + x > aim:
            out.append((lo, i - 1))
            lo = max(i - overlap, 0)
            n = sum(tokens[lo:i])
        n += x
    return [*out, (lo, len(tokens) - 1)]


def test_chunks(spark):
    docs = {d: [RNG.randrange(0, 60) for _ in range(RNG.randrange(1, 25))] for d in range(100)}
    docs[1000] = [500, 10, 10]  # the first page alone is over the aim
    rows = [(d, i + 1, f"p{i} ", n) for d, t in docs.items() for i, n in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, text string, n_tokens int")
    for overlap in (0, 1, 2):
        got = {}
        for r in pages.chunk_spans(df, 100, overlap).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append((r.first_page - 1, r.last_page - 1))
            assert r.n_tokens == sum(docs[r.doc_id][r.first_page - 1 : r.last_page])
        assert got == {d: literal_chunks(t, 100, overlap) for d, t in docs.items()}
    first = pages.chunks(df, 100).where("doc_id = 1000 AND chunk_no = 0").first()
    assert first.text == "" and first.last_page < first.first_page


def random_sections(docs):
    rows = []
    for d in range(docs):
        for i in range(RNG.randrange(1, 20)):
            text = f"h{i}" + " w" * RNG.randrange(0, 12)
            rows.append((d, i, 10 * i + 1, RNG.randrange(1, 7), f"t{i}", text, len(text.split())))
    return rows


SECTIONS = "doc_id int, ord int, line_num int, level int, title string, text string, n_tokens int"


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_parents_runs_and_rollup(spark):
    rows = random_sections(60)
    df = spark.createDataFrame(rows, SECTIONS)
    parents = {(r.doc_id, r.ord): (r.parent_ord, r.depth) for r in markdown.with_parents(df).collect()}
    rolled = {(r.doc_id, r.ord): (r.run_end, r.subtree_tokens) for r in markdown.with_rollup(df).collect()}
    for d, secs in by_doc(rows).items():
        stack = []
        for i, s in enumerate(secs):
            while stack and secs[stack[-1]][3] >= s[3]:
                stack.pop()
            assert parents[d, i] == (stack[-1] if stack else None, len(stack))
            stack.append(i)
            end = next((j for j in range(i + 1, len(secs)) if secs[j][3] <= s[3]), len(secs))
            assert rolled[d, i] == (end, sum(x[6] for x in secs[i:end]))


def test_thinning(spark):
    rows = random_sections(80)
    got = {}
    for r in markdown.thinned(spark.createDataFrame(rows, SECTIONS), 14).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.text))
    for d, secs in by_doc(rows).items():
        ends = [next((j for j in range(i + 1, len(secs)) if secs[j][3] <= s[3]), len(secs)) for i, s in enumerate(secs)]
        size = [sum(x[6] for x in secs[i : ends[i]]) for i in range(len(secs))]
        text, gone = [s[5] for s in secs], set()
        for i in reversed(range(len(secs))):  # bottom up: a small node takes what is left below it
            if i not in gone and size[i] < 14:
                for j in range(i + 1, ends[i]):
                    if j not in gone:
                        text[i] += "\n\n" + text[j]
                        gone.add(j)
        assert got[d] == [(s[4], text[i]) for i, s in enumerate(secs) if i not in gone]


def test_thinning_below_nothing_is_the_identity(spark):
    rows = random_sections(10)
    df = spark.createDataFrame(rows, SECTIONS)
    assert sorted(map(tuple, markdown.thinned(df, 0).collect())) == sorted(rows)


def test_dotted_paths(spark):
    rows = []
    for d in range(120):
        for i in range(RNG.randrange(1, 16)):
            path = RNG.choice([None, "", "1", "2", "1.1", "1.2", "2.1", "1.1.1", "1.1.2", "2.1.1.1", ".5", "3"])
            rows.append((d, i, path, f"t{i}"))
    df = spark.createDataFrame(rows, "doc_id int, idx int, structure string, title string")
    out = {(r.doc_id, r.idx): r for r in tree.with_order(tree.with_parents(df)).collect()}
    for d, items in by_doc(rows).items():
        seen, kids, roots, up = {}, {}, [], {}
        for _, i, path, _ in items:
            seen_key = path
            parent = ".".join(path.split(".")[:-1]) if path and "." in path else None
            if parent and parent in seen:
                up[i] = seen[parent]
                kids.setdefault(seen[parent], []).append(i)
            else:
                roots.append(i)
            seen[seen_key] = i
        order = []

        def walk(i, depth):
            order.append((i, depth))
            for k in kids.get(i, []):
                walk(k, depth + 1)

        for r in roots:
            walk(r, 0)
        for n, (i, depth) in enumerate(order):
            r = out[d, i]
            assert (r.parent_idx, r.depth, r.ord, r.node_id) == (up.get(i), depth, n, f"{n:04d}")


def test_ids_of_five_digits_stay_whole(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(7,), (12345,)], "n int").select(markdown.node_id(F.col("n")).alias("i")).collect()
    assert [r.i for r in got] == ["0007", "12345"]

"""Steps whose cost must not grow faster than their input."""

from pyspark.sql import functions as F

from quire.sources import readers, sinks


def _files(path):
    return [p for p in path.rglob("part-*") if p.suffix == ".txt"]


def test_index_of_many_documents_takes_few_files(spark, tmp_path):
    nodes = spark.range(300).select(
        F.col("id").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(up).cast("int").alias("parent_ord"), F.lit(t).alias("title")) for k, up, t in ((0, None, "a\n \r\"b"), (1, 0, "c"), (2, None, None))))).alias("n")
    ).select("doc_id", "n.*")
    about = nodes.select("doc_id").distinct().withColumn("doc_description", F.lit("Covers."))
    sinks.write_index(nodes, str(tmp_path / "ix"), about, layout="lines")
    assert 0 < len(_files(tmp_path / "ix")) <= 8
    want = {(str(d), o, p, t) for d in range(300) for o, p, t in ((0, None, "a\n \r\"b"), (1, 0, "c"), (2, None, None))}
    for layout in ("lines", "files"):  # a file taken whole may hold several indexes
        back = readers.index_files(spark, str(tmp_path / "ix"), "*.txt", layout).collect()
        assert len(back) == 900 and {(r.doc_name, r.ord, r.parent_ord, r.title) for r in back} == want


def test_command_line_writes_a_line_for_each_document_of_a_table(spark, tmp_path, capsys):
    from quire import cli

    spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("Cats and dogs").alias("text")).coalesce(2).write.parquet(str(tmp_path / "pages"))
    out = tmp_path / "ix"
    assert cli.main(["index", "--pages", str(tmp_path / "pages"), "--out", str(out)], spark) == 0
    assert 0 < len(_files(out)) <= 8
    for layout in ("lines", "files"):
        assert cli.main(["show", "--index", str(out), "--layout", layout, "--style", "titles"], spark) == 0
        assert capsys.readouterr().out.count("Cats and dogs") == 50
    assert cli.main(["index", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "folders"), "--layout", "files"], spark) == 0
    assert len(_files(tmp_path / "folders")) == 50


def test_plain_pdf_lines_take_one_step_each(monkeypatch):
    from quire.sources import pdf

    calls = []
    old = pdf.value
    monkeypatch.setattr(pdf, "value", lambda data, at: calls.append(at) or old(data, at))
    text = "\n".join(f"line {i} of a page (with marks \\ )" if i % 10 == 0 else f"line {i}" for i in range(1000))
    data = pdf.written([text], "t")
    calls.clear()
    assert list(pdf.Pdf(data).pages()) == [text]
    assert len(calls) < 500


def test_search_shuffles_few_rows_for_each_question(spark):
    """The best rows against a literal fold, and no exchange of the pairs of questions and rows."""
    import random

    from quire.operators import search

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(None if d == 7 else d, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for d in range(400)]
    asked = [(q, " ".join(rng.choices(words, k=6))) for q in range(25)] + [(25, "nothing")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = search.search_texts(q, rows, F.col("text"), 4)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    want = {}
    for i, text in asked:
        scores = sorted((-len(set(text.split()) & set(x.split())), -1 if d is None else d) for d, x in docs)
        want |= {(i, n): (None if d < 0 else d, -s) for n, (s, d) in enumerate([x for x in scores if x[0]][:4], 1)}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 0 and "MapInArrow" in plan


def test_node_texts_take_each_page_once(spark):
    """Texts of gapped, repeated and crossed ranges as joined pages, in one exchange of pages."""
    from quire.operators import pages

    p = [(d, n, f"{d}.{n} ", n) for d, ns in ((1, range(1, 9)), (2, (2, 3, 7, 8)), (3, (1, 1, 2)), (4, (5, 6, 7))) for n in ns]
    ranges = [(0, 1, 3), (1, 3, 2), (2, 2, 99), (3, None, 4), (4, -3, 2), (5, 7, 7), (6, 9, 12)]
    nodes = spark.createDataFrame([(d, *r) for d in (1, 2, 3, 4, 5) for r in ranges], "doc_id long, ord int, start_index int, end_index int")
    out = pages.with_text(nodes, spark.createDataFrame(p, "doc_id long, page_no int, text string, n_tokens int"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.doc_id, r.ord): (r.text, r.n_tokens) for r in out.collect()}
    want = {(d, o): ("".join(x[2] for x in p if x[0] == d and a is not None and a <= x[1] <= b), sum(x[3] for x in p if x[0] == d and a is not None and a <= x[1] <= b)) for d in (1, 2, 3, 4, 5) for o, a, b in ranges}
    assert got == want


def test_sketches_are_not_kept_for_every_part(spark):
    from quire.queries import QUERIES
    from tests.conftest import SF

    plan = QUERIES["distinct_and_grouping_sets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sketches = [x for x in plan.split("\n") if "approx_count_distinct" in x and "Aggregate" in x]
    assert sketches and all("keys=[]" in x for x in sketches)


def test_last_mode_is_not_verified(spark, monkeypatch):
    from quire.plans import build
    from quire.plans.options import Options
    from quire.plans.reasoner import RuleReasoner

    asked = []
    old = build.verified
    monkeypatch.setattr(build, "verified", lambda *a, **k: asked.append(1) or old(*a, **k))
    p = spark.createDataFrame([(1, 1, "Cats\nx", 2), (1, 2, "Dogs and more", 3), (2, 1, "no heading here that is short enough to be one of them at all because it goes on", 9)], "doc_id long, page_no int, text string, n_tokens int")
    got = build.cascade(p, RuleReasoner(), Options()).collect()
    assert sorted((r.doc_id, r.idx, r.title, r.physical_index, r.mode) for r in got) == [(1, 0, "Cats", 1, "no_contents"), (1, 1, "Dogs and more", 2, "no_contents")]
    assert not asked


def test_splitting_moves_no_text(spark):
    """An index without texts, some nodes split: what is shuffled does not grow with the pages' texts."""
    import random

    from quire.plans import build
    from quire.plans.options import Options
    from quire.plans.reasoner import RuleReasoner

    rng = random.Random(3)
    rows = []
    for d in range(40):
        for p in range(1, 13):
            title = f"Part {p}." if p % 6 == 1 else f"One of the longer headings here {p}." if p % 2 else "and it goes on with many more words than any heading of this book."
            rows.append((d, p, title + " " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=6000)), 1000))
    size = sum(len(r[2]) for r in rows)
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, n_tokens int").repartition(3, "page_no")
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        it = store.stageList(*([None] + [getattr(store, f"stageList$default${k}")() for k in range(2, 6)])).iterator()
        out = {}
        while it.hasNext():
            x = it.next()
            out[x.stageId(), x.attemptId()] = x.shuffleWriteBytes()
        return out

    pages.persist().count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages()
        o = Options.of(max_pages_per_node=3, max_tokens_per_node=20, add_node_summary=False)
        got = build.index_documents(pages, o, RuleReasoner(heading_words=3), RuleReasoner(heading_words=12)).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        moved = sum(n for k, n in stages().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        pages.unpersist()
    assert {r.depth for r in got} == {0, 1} and len(got) == 40 * 6 and sum(r.n_tokens for r in got) == 40 * 14000  # a parent keeps the page its first child begins on
    assert 0 < moved < size / 4


def _split(nodes, texts, words, heading, top, max_pages, max_words):
    """Nodes of one document with the headings inside oversized ones below them, as a plain recursion."""
    out = []
    for structure, title, a, b in nodes:
        kids, end = [], b
        if b - a > max_pages and sum(words[p] for p in range(a, b + 1) if p in words) >= max_words:
            hits = [(p, heading(texts[p])) for p in range(a, b + 1) if p in texts and heading(texts[p])]
            if hits and hits[0][1].strip() == title.strip():
                hits = hits[1:]
            for k, (p, x) in enumerate(hits):
                after = hits[k + 1][0] if k + 1 < len(hits) else None
                kids.append((f"{structure}.{k + 1}", x, p, b if after is None else after - 1 if top(hits[k + 1][1], texts[after]) else after))
            end = kids[0][2] if kids else b
        out.append((structure, title, a, end))
        out += _split(kids, texts, words, heading, top, max_pages, max_words)
    return out


def test_nested_splits_against_a_recursion(spark):
    """Headings inside headings, for a reasoner of plain columns and for one that is asked about few pages."""
    import random

    from quire.plans import build
    from quire.plans.options import Options
    from quire.plans.reasoner import RuleReasoner

    class Marked(RuleReasoner):
        def heading(self, page):
            return F.nullif(F.regexp_extract(page, r"#(\w+)", 1), F.lit(""))

        def starts_page(self, title, page):
            return F.startswith(page, F.concat(F.lit("#"), title))

    class Asked(Marked):
        plain = False

    rng = random.Random(11)
    pages, nodes, want = [], [], []
    for d in range(60):
        n = rng.randint(1, 30)
        texts = {p: rng.choice(["", "x ", "y "]) + (f"#h{rng.randint(1, 4)}" if rng.random() < 0.6 else "plain") for p in range(1, n + 1) if rng.random() < 0.95}
        words = {p: rng.randint(0, 9) for p in texts}
        pages += [(d, p, x, words[p]) for p, x in texts.items()]
        mine = [(str(i + 1), f"h{rng.randint(1, 4)}", a, min(n, a + rng.randint(-1, 15))) for i, a in enumerate(sorted(rng.sample(range(1, n + 1), rng.randint(1, min(n, 4)))))]
        nodes += [(d, i, *x, "m", False) for i, x in enumerate(mine)]
        found = lambda x: x.split("#")[1] if "#" in x else None
        want += [(d, i, *x) for i, x in enumerate(_split(mine, texts, words, found, lambda t, x: x.startswith("#" + t), 2, 10))]
    flat = spark.createDataFrame(nodes, "doc_id long, idx int, structure string, title string, start_index int, end_index int, mode string, split boolean")
    p = spark.createDataFrame(pages, "doc_id long, page_no int, text string, n_tokens int")
    assert any(x[2].count(".") > 1 for x in want)
    for r in (Marked(), Asked()):
        out = build.split_large(flat, p, r, Options.of(max_pages_per_node=2, max_tokens_per_node=10))
        assert out.columns == flat.columns
        assert [(x.doc_id, x.idx, x.structure, x.title, x.start_index, x.end_index) for x in out.orderBy("doc_id", "idx").collect()] == want

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, markdown, pages, search, toc, tree
from quire.plans import build, evaluation
from quire.plans.options import Options
from quire.plans.reasoner import RuleReasoner, ScriptedReasoner
from quire.sources import readers, sinks

PAGES = "doc_id long, page_no int, text string, n_tokens int"
TITLES = ["First part", "Second part", "Third part", "Fourth part", "Fifth part"]
LONG = " and it goes on with many more words than any heading of this book could ever have"


def book(spark, front=None, shift=0):
    """Five titled pages, each followed by one of prose; in front perhaps a contents page."""
    texts = [front] if front else []
    texts += ["nothing here" + LONG] * shift
    for x in TITLES:
        texts += [x + ". What it says" + LONG + ".", "prose" + LONG + "."]
    return spark.createDataFrame([(1, i + 1, x, len(x.split())) for i, x in enumerate(texts)], PAGES)


def contents(first=1, step=2):
    return "\n".join(["Contents", *(f"{i + 1} {x} ........ {first + step * i}" for i, x in enumerate(TITLES))])


def test_contents_with_page_numbers(spark):
    out = build.cascade(book(spark, contents(), shift=1), RuleReasoner(), Options()).orderBy("idx").collect()
    assert [(r.title, r.physical_index) for r in out] == [(x, 3 + 2 * i) for i, x in enumerate(TITLES)]
    assert {r["mode"] for r in out} == {"with_page_numbers"}


def test_wrong_printed_pages_are_repaired_or_fall_back(spark):
    page = contents().replace("........ 5", "........ 6")
    out = build.cascade(book(spark, page), RuleReasoner(), Options()).orderBy("idx").collect()
    assert [(r.title, r.physical_index) for r in out] == [(x, 2 + 2 * i) for i, x in enumerate(TITLES)]


def test_without_contents(spark):
    out = build.index_documents(book(spark), Options.of(add_node_text=True, add_node_summary=False)).orderBy("ord").collect()
    assert [r.title for r in out] == TITLES
    assert [(r.start_index, r.end_index) for r in out] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    assert [r.node_id for r in out] == [f"{i:04d}" for i in range(5)] and all(r.text for r in out)


def test_structural_invariants(spark):
    p = readers_pages(spark)
    n = {r.doc_id: r.n_pages for r in build.sizes(p).collect()}
    rows = build.index_documents(p).collect()
    assert rows
    for d in {r.doc_id for r in rows}:
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(len(mine))) and len({r.node_id for r in mine}) == len(mine)
        assert all(r.title and 1 <= r.start_index <= n[d] and r.end_index <= n[d] for r in mine)


def readers_pages(spark):
    from quire.sources import views
    from tests.conftest import SF

    return views.page_list(spark, SF)


def test_split_of_large_nodes(spark):
    p = book(spark)
    flat = spark.createDataFrame([(1, 0, "1", "First part", 1, 10, "m", False)], "doc_id long, idx int, structure string, title string, start_index int, end_index int, mode string, split boolean")
    out = build.split_large(flat, p, RuleReasoner(), Options.of(max_pages_per_node=3, max_tokens_per_node=20)).orderBy("idx").collect()
    assert [(r.structure, r.title, r.start_index, r.end_index) for r in out] == [
        ("1", "First part", 1, 3), ("1.1", "Second part", 3, 4), ("1.2", "Third part", 5, 6), ("1.3", "Fourth part", 7, 8), ("1.4", "Fifth part", 9, 10),
    ]


def test_scripted_answers_and_rounds(spark):
    items = build.without_contents(book(spark), RuleReasoner())
    checked = build.verified(items, book(spark), ScriptedReasoner(["Second part"]))
    assert {(r.title, r.correct) for r in checked.collect()} == {(x, x != "Second part") for x in TITLES}
    assert checked.first().accuracy == pytest.approx(0.8)
    still = build.repaired(checked, book(spark), ScriptedReasoner(["Second part"]))
    assert still.where("NOT correct").count() == 1


def test_nothing_is_checked_before_the_middle(spark):
    items = build.without_contents(book(spark), RuleReasoner()).where("idx < 2")
    assert {(r.reaches_middle, r.accuracy) for r in build.verified(items, book(spark), RuleReasoner()).collect()} == {(False, 0.0)}


def test_preface_and_bounds(spark):
    schema = "doc_id int, idx int, structure string, title string, physical_index int"
    rows = [(1, 0, "1", "a", 3), (1, 1, "2", "b", 9), (2, 0, "1", "c", 1), (3, 0, "1", "d", None)]
    out = toc.with_preface(spark.createDataFrame(rows, schema)).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.idx, r.title) for r in out] == [(1, 0, "Preface"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (3, 0, "d")]
    cut = toc.within_pages(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "doc_id int, n_pages int"))
    assert [r.physical_index for r in cut.orderBy("doc_id", "idx").collect()] == [3, None, 1, None]


def test_end_before_start_gives_no_text(spark):
    nodes = spark.createDataFrame([(1, 0, 3, 2), (1, 1, 1, 2)], "doc_id long, ord int, start_index int, end_index int")
    out = pages.with_text(nodes, book(spark)).orderBy("ord").collect()
    assert out[0].text == "" and out[0].n_tokens == 0 and out[1].text.startswith("First part")
    tagged = pages.with_text(nodes, book(spark), tags=True).orderBy("ord").collect()[1].text
    assert tagged.startswith("<physical_index_1>\nFirst part") and tagged.endswith("\n<physical_index_2>\n")


MD = "intro\n# A\ntext a\n```\n# fake\n```\n## B\nb\n  ## indented\n# C\n\nlast"


def test_markdown_with_fences_and_both_numberings(spark):
    lines = markdown.lines(spark.createDataFrame([(1, MD), (2, "no headings")], "doc_id long, text string"))
    out = markdown.nodes(lines).orderBy("ord").collect()
    assert [(r.node_id, r.title, r.level, r.parent_ord, r.line_num) for r in out] == [("0000", "A", 1, None, 2), ("0001", "B", 2, 0, 7), ("0002", "C", 1, None, 10)]
    assert out[1].text == "## B\nb\n  ## indented" and out[0].text.startswith("# A\ntext a\n```")
    assert [r.node_id for r in markdown.nodes(lines, number=False).orderBy("ord").collect()] == ["1", "2", "3"]
    s = {r.title: (r.summary, r.prefix_summary) for r in markdown.summarised(markdown.nodes(lines), 200).collect()}
    assert s["A"][0] is None and s["A"][1].startswith("# A") and s["B"][1] is None


def test_index_files_round_trip(spark, tmp_path):
    lines = markdown.lines(spark.createDataFrame([(1, MD), (2, "# X\n## Y\n### Z\n## W")], "doc_id long, text string"))
    nodes = markdown.summarised(markdown.nodes(lines)).drop("text").withColumn("doc_name", F.concat(F.lit("d"), "doc_id"))
    about = build.descriptions(nodes)
    docs = {r.doc_name: json.loads(r.json) for r in sinks.index_json(nodes, about).collect()}
    x = docs["d2"]["structure"][0]
    assert docs["d2"]["doc_description"] == "Covers: X." and [c["title"] for c in x["nodes"]] == ["Y", "W"] and "nodes" not in x["nodes"][1]
    sinks.write_index(nodes, str(tmp_path / "ix"), about)
    back = readers.index_files(spark, str(tmp_path / "ix"), "*").collect()
    want = {(r.doc_name, r.ord, r.parent_ord, r.depth, r.node_id, r.title, r.line_num) for r in nodes.collect()}
    assert {(r.doc_name, r.ord, r.parent_ord, r.depth, r.node_id, r.title, r.line_num) for r in back} == want


def test_log_flushes_every_twenty(tmp_path):
    path = tmp_path / "a" / "log.json"
    with sinks.RunLog(str(path)) as log:
        for i in range(19):
            log.add(f"m{i}")
        assert not path.exists()
        log.add({"n": 1})
        assert len(json.loads(path.read_text())) == 20
        log.add("more")
        assert len(json.loads(path.read_text())) == 20
    assert json.loads(path.read_text())[-1] == {"message": "more"}


def test_readers(spark, tmp_path):
    (tmp_path / "one.txt").write_text("page one\fpage two")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two.md").write_text("# T\nx")
    p = readers.text_pages(spark, str(tmp_path / "one.txt")).orderBy("page_no").collect()
    assert [(r.doc_name, r.page_no, r.text) for r in p] == [("one", 1, "page one"), ("one", 2, "page two")]
    assert readers.markdown_files(spark, str(tmp_path)).where("doc_name = 'two'").count() == 2
    assert [x.rsplit("/", 1)[1] for x in (r.path for r in readers.file_list(spark, str(tmp_path), "*.md").collect())] == ["two.md"]
    (tmp_path / "b.json").write_text(json.dumps([{"query": "q", "expected_nodes": ["0001"], "notes": ""}, {"query": "r"}]))
    assert [r.expected for r in readers.benchmark_file(spark, str(tmp_path / "b.json")).collect()] == [["0001"], []]
    case = {"suite": "smoke", "case_id": "a", "document": "d", "question": "q?", "reference_answer": "", "required_facts": ["x"]}
    (tmp_path / "c.json").write_text(json.dumps({"cases": [case]}))
    assert readers.eval_file(spark, str(tmp_path / "c.json")).first().forbidden_claims == []
    for bad in ([], [case, case], [case | {"suite": "other"}]):
        with pytest.raises(ValueError):
            readers.eval_cases(spark, bad)
    with pytest.raises(ValueError):
        readers._PdfReader({"parser": "other"})


def test_evaluation_run(spark):
    nodes = build.index_documents(book(spark), Options.of(add_node_text=True))
    cases = spark.createDataFrame(
        [("a", 1, "What does the third part say", ["it goes on"], ["zzz"]), ("b", 1, "fifth part", ["no such fact"], []), ("c", 9, "x", [], [])],
        "case_id string, doc_id long, question string, required_facts array<string>, forbidden_claims array<string>",
    )
    out = {(r.case_id, r["mode"]): r for r in evaluation.run(cases, nodes, book(spark)).collect()}
    assert len(out) == 6
    assert out["a", evaluate.TREE].judge["pass"] and not out["b", evaluate.FULL].judge["pass"]
    assert out["c", evaluate.TREE].status == "error" and out["c", evaluate.TREE].judge is None
    assert out["a", evaluate.TREE].model_usage.input_tokens < out["a", evaluate.FULL].model_usage.input_tokens
    res = evaluation.run(cases, nodes, book(spark))
    grid = spark.createDataFrame([("rules", m) for m in (evaluate.FULL, evaluate.TREE)] + [("none", m) for m in (evaluate.FULL, evaluate.TREE)], "model string, mode string")
    m = evaluate.summary_matrix(res, grid)
    row = {(r.model, r["mode"]): r for r in m.collect()}
    assert row["rules", evaluate.TREE].errors == 1 and row["none", evaluate.FULL].cases == 0
    assert evaluate.invalid_verdicts(res).count() == 0
    text = evaluate.report(m, evaluate.delta_table(m), evaluate.recommendation(m))
    assert text.count("| rules |") == 4 and "Advice" in text


def test_advice_rules(spark):
    def row(model, mode, p, s, n):
        return (model, mode, p, s, n, 0.0, 0.0)

    f, t = evaluate.FULL, evaluate.TREE
    rows = [row("a", f, 0.5, 0.5, 9.0), row("a", t, 0.65, 0.5, 9.0), row("b", f, 0.5, 0.5, 9.0), row("b", t, 0.5, 0.35, 9.0),
            row("c", f, 0.5, 0.5, 2500.0), row("c", t, 0.5, 0.5, 900.0), row("d", f, 0.5, 0.5, 900.0), row("d", t, 0.5, 0.5, 800.0)]
    m = spark.createDataFrame(rows, "model string, mode string, pass_rate double, avg_score double, avg_model_tokens double, avg_judge_tokens double, avg_total_latency_sec double")
    assert {r.model: r.strategy for r in evaluate.recommendation(m).collect()} == {"a": t, "b": f, "c": t, "d": "either"}


def test_metrics_edges(spark):
    rows = [(1, [], [], True, 0.0, 1.0), (2, ["a"], [], False, 0.0, 0.0), (3, [], ["a"], True, 0.0, 1.0), (4, ["a", "b", "a"], ["a", "a", "c"], True, 0.5, 0.5)]
    df = spark.createDataFrame([r[:3] for r in rows], "query_id int, expected array<string>, retrieved array<string>")
    assert [tuple(r) for r in evaluate.retrieval_metrics(df).orderBy("query_id").collect()] == [(r[0], *r[3:]) for r in rows]
    empty = evaluate.benchmark_summary(evaluate.retrieval_metrics(df).limit(0)).first()
    assert (empty.cases, empty.hit_rate) == (0, 0.0)
    with pytest.raises(ValueError):
        evaluate.model_names(" , ")
    with pytest.raises(ValueError):
        evaluate.suite_filter(df, "none")


def test_search_prefers_leaves(spark):
    nodes = spark.createDataFrame([(1, 0, "0000", None, "all cats", "cats and dogs"), (1, 1, "0001", 0, "cats", "cats only"), (1, 2, "0002", 0, "dogs", "x")], "doc_id long, ord int, node_id string, parent_ord int, title string, text string")
    q = spark.createDataFrame([(7, "cats")], "query_id long, query string")
    assert [r.node_id for r in search.search_nodes(q, nodes).orderBy("rank").collect()] == ["0001", "0000"]


def test_rendering_without_optional_columns(spark):
    nodes = spark.createDataFrame([(1, 0, None, "A", 0, 1, None), (1, 1, "0001", None, 1, 2, 3)], "doc_id long, ord int, node_id string, title string, depth int, start_index int, end_index int")
    assert tree.rendered(nodes).first().tree == "[-] A (p1-?)\n  [0001] Untitled (p2-3)"

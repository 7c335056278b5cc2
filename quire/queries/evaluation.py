"""Evaluation queries, and scalar functions on synthetic replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import evaluate, search
from quire.queries.outline import COLLAPSE
from quire.queries.registry import query
from quire.sources import views as v
from quire.sources.views import sql_words, with_views

_WORD_HITS = f""", qw AS (SELECT DISTINCT item_id AS query_id, unnest({sql_words('lower(text)')}) AS word FROM benchmark), dw AS (SELECT DISTINCT doc_id, unnest({sql_words('lower(text)')}) AS word FROM documents),
 sc AS (SELECT query_id, doc_id, count(*) AS s FROM dw JOIN qw USING (word) GROUP BY ALL), top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 5),
 got AS (SELECT query_id, list(doc_id) AS got FROM top GROUP BY query_id), want AS (SELECT item_id AS query_id, list(d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL) AS want FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
 both2 AS (SELECT query_id, coalesce(want, []) AS want, coalesce(got, []) AS got FROM want LEFT JOIN got USING (query_id)),
 m AS (SELECT query_id, len(want) = 0 OR len(list_intersect(want, got)) > 0 AS hit, CASE WHEN len(want) = 0 OR len(got) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(want, got)) / len(got)::DOUBLE END AS precision, CASE WHEN len(want) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(want, got)) / len(want)::DOUBLE END AS recall FROM both2)"""


def bench(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items with the documents that hold them whole, and five retrieved by shared words."""
    q = v.questions(spark, sf)
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    got = search.search_texts(q, docs, F.col("text"), 5).groupBy("query_id").agg(F.collect_list("doc_id").alias("retrieved"))
    want = search.holding(q, docs).groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    none = F.expr("cast(array() AS array<bigint>)")
    return q.select("query_id").join(got, "query_id", "left").join(want, "query_id", "left").select("query_id", F.coalesce("expected", none).alias("expected"), F.coalesce("retrieved", none).alias("retrieved"))


@query("WITH x AS (SELECT 1)" + _WORD_HITS + " SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit, precision and recall of each benchmark item."""
    return evaluate.retrieval_metrics(bench(spark, sf))


@query("WITH x AS (SELECT 1)" + _WORD_HITS + " SELECT count(*) AS cases, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, 0.0::DOUBLE AS avg_latency FROM m")
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A10: the share of hits."""
    return evaluate.benchmark_summary(evaluate.retrieval_metrics(bench(spark, sf)))


_AGG = """, agg AS (SELECT model, mode, count(*) AS cases, count(*) FILTER (WHERE status = 'ok') AS ok, avg(CASE WHEN pass THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE status = 'ok') AS pr, avg(score) FILTER (WHERE status = 'ok') AS sc,
 avg((k * 50)::DOUBLE) FILTER (WHERE status = 'ok') AS mt, avg((k * 10)::DOUBLE) FILTER (WHERE status = 'ok') AS jt, avg(latency) FILTER (WHERE status = 'ok') AS la FROM res GROUP BY ALL),
 grid AS (SELECT * FROM (VALUES ('m0'), ('m1'), ('m2'), ('m9')) a(model), (VALUES ('full_context'), ('tree_search')) b(mode)),
 mx AS (SELECT model, mode, coalesce(cases, 0) AS cases, coalesce(ok, 0) AS successful_cases, round_even(coalesce(pr, 0), 4) AS pass_rate, round_even(coalesce(sc, 0), 4) AS avg_score, round_even(coalesce(mt, 0), 1) AS avg_model_tokens,
  round_even(coalesce(jt, 0), 1) AS avg_judge_tokens, round_even(coalesce(la, 0), 4) AS avg_total_latency_sec, coalesce(cases - ok, 0) AS errors FROM grid LEFT JOIN agg USING (model, mode)),
 dl AS (SELECT a.model, a.pass_rate - b.pass_rate AS dp, a.avg_score - b.avg_score AS ds, a.avg_model_tokens - b.avg_model_tokens AS dt, a.avg_total_latency_sec - b.avg_total_latency_sec AS dl FROM mx a JOIN mx b ON a.model = b.model AND a.mode = 'tree_search' AND b.mode = 'full_context')"""


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    models = spark.createDataFrame([(m,) for m in evaluate.model_names("m0, m1,m2,, m9")], "model string")
    grid = evaluate.run_grid(models, spark.range(1).select()).select("model", "mode")
    return evaluate.summary_matrix(v.eval_results(spark, sf), grid)


@query(with_views("res", body=f"{_AGG} SELECT * FROM mx"))
def eval_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Means for every model and mode, zeros for those without results."""
    return matrix(spark, sf)


@query(with_views("res", body=f"{_AGG} SELECT model, round_even(dp, 4) AS delta_pass_rate, round_even(ds, 4) AS delta_avg_score, round_even(dt, 1) AS delta_avg_model_tokens, round_even(dl, 4) AS delta_avg_total_latency_sec FROM dl"))
def eval_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Tree search minus full context."""
    return evaluate.delta_table(matrix(spark, sf))


@query(with_views("res", body=f"""{_AGG} SELECT model, CASE WHEN dp >= 0.15 OR ds >= 0.1 THEN 'tree_search' WHEN dp <= -0.15 OR ds <= -0.1 THEN 'full_context' WHEN dt <= -1000 THEN 'tree_search' ELSE 'either' END AS strategy,
 CASE WHEN dp >= 0.15 OR ds >= 0.1 OR dp <= -0.15 OR ds <= -0.1 THEN 'quality' WHEN dt <= -1000 THEN 'tokens' ELSE 'none' END AS reason FROM dl"""))
def eval_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    """Which mode to use for each model."""
    return evaluate.recommendation(matrix(spark, sf))


_MX = "model mode cases successful_cases pass_rate avg_score avg_model_tokens avg_judge_tokens avg_total_latency_sec errors".split()
_DL = "model delta_pass_rate delta_avg_score delta_avg_model_tokens delta_avg_total_latency_sec".split()
_SHOWN = {"pass_rate": "printf('%.1f%%', pass_rate * 100)", "avg_score": "printf('%.3f', avg_score)", "avg_total_latency_sec": "printf('%.2f', avg_total_latency_sec)"}


def _section(n: int, title: str, columns: list[str], rows: str, order: str) -> str:
    """Lines of a report's section: a heading, a Markdown table, a blank line."""
    cells = " || ' | ' || ".join(f"coalesce(cast({_SHOWN.get(c, c)} AS VARCHAR), '')" for c in columns)
    fixed = ["## " + title, "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    head = " UNION ALL ".join(f"SELECT {n} AS s, {i} AS o, '{x}' AS line" for i, x in enumerate(fixed))
    return f"{head} UNION ALL SELECT {n}, 9 + row_number() OVER (ORDER BY {order}), '| ' || {cells} || ' |' FROM ({rows}) UNION ALL SELECT {n}, 1000000, ''"


_ADVICE = """SELECT model, CASE WHEN dp >= 0.15 OR ds >= 0.1 THEN 'tree_search' WHEN dp <= -0.15 OR ds <= -0.1 THEN 'full_context' WHEN dt <= -1000 THEN 'tree_search' ELSE 'either' END AS strategy,
 CASE WHEN dp >= 0.15 OR ds >= 0.1 OR dp <= -0.15 OR ds <= -0.1 THEN 'quality' WHEN dt <= -1000 THEN 'tokens' ELSE 'none' END AS reason FROM dl"""
_DELTA = "SELECT model, round_even(dp, 4) AS delta_pass_rate, round_even(ds, 4) AS delta_avg_score, round_even(dt, 1) AS delta_avg_model_tokens, round_even(dl, 4) AS delta_avg_total_latency_sec FROM dl"


@query(with_views("res", body=f"""{_AGG}, lines AS (SELECT 0 AS s, 0 AS o, '# Summary' AS line UNION ALL SELECT 0, 1, '' UNION ALL {_section(1, 'Matrix', _MX, 'SELECT * FROM mx', 'model, mode')}
 UNION ALL {_section(2, 'Tree search minus full context', _DL, _DELTA, 'model')} UNION ALL {_section(3, 'Advice', ['model', 'strategy', 'reason'], _ADVICE, 'model')})
 SELECT cast(row_number() OVER (ORDER BY s, o) - 1 AS INTEGER) AS n, line FROM lines"""))
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a Markdown report; its tables have a row for each model and mode."""
    m = matrix(spark, sf)
    text = evaluate.report(m, evaluate.delta_table(m), evaluate.recommendation(m))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


_ISSUE = "CASE WHEN event_id % 4 = 0 THEN 'k  ' ELSE 'k ' END || (k % 10)"


@query(with_views("res", body=f" SELECT {COLLAPSE.format(_ISSUE)} AS issue, count(*) AS n FROM res WHERE status = 'ok' GROUP BY 1 ORDER BY n DESC, issue LIMIT 5"))
def issue_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent issues."""
    return evaluate.top_issues(v.eval_results(spark, sf).where("status = 'ok'").select("issue"))


@query(with_views("res", body=""", i AS (SELECT model, mode, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS b FROM res WHERE status = 'ok')
 SELECT model, mode, cast(sum(a) AS BIGINT) AS missing_facts, cast(sum(b) AS BIGINT) AS hallucinations, sum(a) > sum(b) AS omission_dominated FROM i GROUP BY ALL"""))
def issue_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of issue lists."""
    return evaluate.issue_totals(v.eval_results(spark, sf), "model", "mode")


@query(with_views("res", body=" SELECT cast(event_id AS VARCHAR) AS case_id, k * 60 AS total_tokens, 0::BIGINT AS input_tokens FROM res"))
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of two calls added."""
    both = evaluate.add_usage(F.col("model_usage"), F.col("judge_usage"))
    return v.eval_results(spark, sf).select("case_id", both["total_tokens"].alias("total_tokens"), both["input_tokens"].alias("input_tokens"))


@query("SELECT item_id AS case_id, CASE WHEN item_id % 4 = 0 THEN 'smoke' ELSE 'full' END AS suite FROM benchmark WHERE item_id % 4 = 0")
def suite_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of a suite."""
    cases = v.questions(spark, sf).select(F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 4 == 0, "smoke").otherwise("full").alias("suite"))
    return evaluate.suite_filter(cases, "smoke")


@query("SELECT item_id AS query_id, m.model, b.mode FROM benchmark, (VALUES ('a'), ('b')) m(model), (VALUES ('full_context'), ('tree_search')) b(mode)")
def eval_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every model, case and mode."""
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    return evaluate.run_grid(models, v.questions(spark, sf).select("query_id")).select("query_id", "model", "mode")


_SQ = r"regexp_replace(lower({0}), '\s+', '', 'g')"


@query(f"""WITH c AS (SELECT item_id, text AS answer, [string_split(text, ' ')[1], 'no such fact'] AS req, [string_split(text, ' ')[2], 'zzzz'] AS bad FROM benchmark),
 x AS (SELECT *, list_filter(req, lambda f: NOT contains({_SQ.format('answer')}, {_SQ.format('f')})) AS miss, list_filter(bad, lambda f: contains({_SQ.format('answer')}, {_SQ.format('f')})) AS made FROM c)
 SELECT item_id, len(miss) = 0 AND len(made) = 0 AS pass, round_even(1 - len(miss) / 2::DOUBLE, 4) AS score, cast(len(miss) AS INTEGER) AS n_missing, cast(len(made) AS INTEGER) AS n_made_up, 'missing' AS citation_quality FROM x""")
def judge_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by containment of facts and claims."""
    word = F.split("query", " ")
    a = v.questions(spark, sf).select(F.col("query_id").alias("item_id"), F.col("query").alias("answer"), F.array(word[0], F.lit("no such fact")).alias("required_facts"), F.array(word[1], F.lit("zzzz")).alias("forbidden_claims"))
    j = evaluate.judged(a)
    return j.select("item_id", "judge.pass", F.col("judge.score_0_to_1").alias("score"), F.size("judge.missing_facts").alias("n_missing"), F.size("judge.hallucinations").alias("n_made_up"), "judge.citation_quality")


# Replies of a model.

_K = "cast(json_extract_string(props, '$.k') AS INTEGER)"


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Events as replies: plain, fenced, with None, with trailing commas, unclosed, and garbage."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"k": '), k, F.lit(', "x": null}'))
    fence, nl = F.lit("```"), F.lit("\n")
    kind = F.col("event_id") % 6
    reply = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), body, nl, fence, F.lit(" done")))
        .when(kind == 2, F.concat(F.lit('{"k":\n '), k, F.lit(', "x": None}')))
        .when(kind == 3, F.concat(F.lit('{"l": [1, 2,], "k": '), k, F.lit(",}")))
        .when(kind == 4, F.concat(fence, F.lit("json"), body))
        .otherwise(F.concat(F.lit("no json "), k))
    )
    return v.table(spark, sf, "events").select("event_id", reply.alias("reply"))


@query(f"""SELECT event_id, CASE WHEN event_id % 6 < 4 THEN {_K} END AS k, event_id % 6 >= 4 AS is_empty FROM events""")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """replies as JSON, empty where nothing can be made of them."""
    fixed = t.repaired_json(F.col("reply"))
    return replies(spark, sf).withColumn("j", fixed).select("event_id", F.get_json_object("j", "$.k").try_cast("int").alias("k"), (F.col("j") == "{}").alias("is_empty"))


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN body WHEN 1 THEN body WHEN 2 THEN '{{"k":' || chr(10) || ' ' || k || ', "x": None}}' WHEN 3 THEN '{{"l": [1, 2,], "k": ' || k || ',}}' WHEN 4 THEN body ELSE 'no json ' || k END AS inside
 FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, '{{"k": ' || json_extract_string(props, '$.k') || ', "x": null}}' AS body FROM events)""")
def json_fence(spark: SparkSession, sf: str) -> DataFrame:
    """what a json fence holds."""
    return replies(spark, sf).select("event_id", t.fenced(F.col("reply")).alias("inside"))


@query(f"""SELECT doc_id, w[1] || CASE WHEN len(w) > 1 AND w[2] <> w[1] THEN ' ' || w[2] ELSE '' END AS first_words FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)""")
def unique_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values in the order they are first seen."""
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.slice(t.words(F.col("text")), 1, 2)), " ").alias("first_words"))


@query("""SELECT event_id, printf('%.1f%%', round_even(value, 1)) AS pct, printf('%.3f', round_even(value, 2)) AS three, printf('%.2f', round_even(value, 1)) AS secs FROM events WHERE value IS NOT NULL""")
def format_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """percentages and fixed places."""
    e = v.table(spark, sf, "events").where("value IS NOT NULL")
    return e.select("event_id", t.percent(F.bround("value", 1) / 100).alias("pct"), t.three_places(F.bround("value", 2)).alias("three"), t.seconds(F.bround("value", 1)).alias("secs"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || 'c<s>' ELSE 'a<s>b' END AS cut, cast(doc_id AS INTEGER) AS first_tag, cast(doc_id + 1 AS INTEGER) AS last_tag, replace('x/' || source || '/y', '/', '-') AS file, 'y' AS base FROM documents""")
def tag_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Sections between tags, tag numbers, file names."""
    d = v.table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, "a<s>b<s>c<s>").otherwise("a<s>b")
    tags = F.concat(F.lit("<start_index_"), F.col("doc_id").cast("string"), F.lit("> x <start_index_"), (F.col("doc_id") + 1).cast("string"), F.lit(">"))
    path = F.concat(F.lit("x/"), "source", F.lit("/y"))
    return d.select("doc_id", t.drop_first_section(text, F.lit("<s>")).alias("cut"), t.first_start_tag(tags).alias("first_tag"), t.last_start_tag(tags).alias("last_tag"), t.file_name(path).alias("file"), t.base_name(path).alias("base"))

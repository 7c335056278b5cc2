"""Tables in outline shapes derived from the example tables, in Spark and in SQL.

The example tables hold no headings or contents pages, so these views build them by
rules; each has a twin in ``SQL`` that a SQL engine can run on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import evaluate, markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages."""
    lines = markdown.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_num").alias("page_no"), "text", t.count_tokens(F.col("text")).alias("n_tokens"))


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text", t.count_tokens(F.col("text")).alias("n_tokens"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of web pages as pages."""
    parts = F.split("html", r"<p(?:\s[^>]*)?>")
    inside = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.regexp_replace(F.split_part(x, F.lit("</p>"), F.lit(1)), "<[^>]*>", " "))
    p = table(spark, sf_dir, "pages").select("page_id", F.filter(inside, lambda x: F.size(t.words(x)) > 0).alias("b"))
    return p.select(F.col("page_id").alias("doc_id"), F.posexplode("b").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "text", t.count_tokens(F.col("text")).alias("n_tokens"))


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page as a contents item with a dotted path, a printed and a physical page."""
    p = page_list(spark, sf_dir).where("page_no % 2 = 1").withColumn("idx", F.expr("cast((page_no - 1) / 2 AS int)"))
    p = p.withColumn("g", F.expr("cast(floor(idx / 3) AS int) + 1"))
    return p.select(
        "doc_id", "idx",
        F.when(F.col("idx") % 3 == 0, F.col("g").cast("string")).otherwise(F.concat_ws(".", F.col("g").cast("string"), (F.col("idx") % 3).cast("string"))).alias("structure"),
        F.array_join(F.slice(t.words(F.col("text")), 1, 5), " ").alias("title"),
        F.when(F.col("idx") % 7 == 6, F.lit(None)).when(F.col("idx") % 5 == 4, F.col("page_no") - 3).otherwise(F.col("page_no") - 2).cast("int").alias("page_num"),
        F.col("page_no").alias("physical_index"),
        F.concat(F.lit(f"<{t.TAG}_"), F.col("page_no").cast("string"), F.lit(">")).alias("physical_tag"),
        (F.col("idx") % 2 == 0).alias("appear_start"),
    )


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a heading for each item over its line and the one behind it, and fenced fakes."""
    items = toc_items(spark, sf_dir)
    lines = page_list(spark, sf_dir)
    body = lines.select("doc_id", F.col("page_no").alias("physical_index"), "text")
    behind = lines.select("doc_id", (F.col("page_no") - 1).alias("physical_index"), F.col("text").alias("behind"))
    items = items.join(behind, ["doc_id", "physical_index"], "left")
    level = F.when(F.col("idx") % 4 == 3, 3).when(F.col("idx") % 3 == 0, 1).otherwise(2)
    rows = items.join(body, ["doc_id", "physical_index"]).withColumn("heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "title"))
    fence = F.lit("```")
    parts = F.when(F.col("idx") % 6 == 5, F.array(fence, F.col("heading"), fence, F.col("text"), F.col("behind"))).otherwise(F.array(F.col("heading"), F.col("text"), F.col("behind")))
    parts = F.filter(parts, F.isnotnull)
    rows = rows.select("doc_id", "idx", F.posexplode(parts).alias("k", "text"))
    return rows.selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS line_num", "text")


def toc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.length("text") % 3 != 0, "yes").otherwise("no")
    return page_list(spark, sf_dir).select("doc_id", (F.col("page_no") - 1).alias("page"), answer.alias("answer"))


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation results."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    k = F.get_json_object("props", "$.k").cast("bigint")
    usage = lambda n: F.struct(*(F.when(F.lit(x == "total_tokens"), n).otherwise(F.lit(0)).cast("bigint").alias(x) for x in evaluate.USAGE_KEYS))
    issue = F.concat(F.when(F.col("event_id") % 4 == 0, "k  ").otherwise("k "), (k % 10).cast("string"))
    none = F.expr("cast(array() AS array<string>)")
    judge = F.struct(
        (F.col("value") >= 20).alias("pass"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score_0_to_1"),
        F.when(F.col("event_id") % 3 == 0, F.array(issue)).otherwise(none).alias("missing_facts"), F.when(F.col("event_id") % 5 == 0, F.array(issue, F.lit("made up"))).otherwise(none).alias("hallucinations"),
        F.lit("weak").alias("citation_quality"), F.lit("").alias("rationale"),
    )
    return e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.when(F.col("event_id") % 2 == 0, evaluate.FULL).otherwise(evaluate.TREE).alias("mode"),
        F.col("event_id").cast("string").alias("case_id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), judge.alias("judge"),
        usage(k * 50).alias("model_usage"), usage(k * 10).alias("judge_usage"), (F.col("value") / 10).alias("total_latency_sec"), issue.alias("issue"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("doc_id"), "embedding")


_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def sql_words(c: str) -> str:
    return _WORDS.format(c)


#: Views as common table expressions; each may use those before it.
SQL = {
    "page_list": f"""page_list AS (
  SELECT doc_id, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS page_no, unnest(string_split(text, chr(10))) AS text
  FROM documents), pl AS (
  SELECT doc_id, page_no, text, cast(len({_WORDS.format('text')}) AS INTEGER) AS n_tokens FROM page_list)""",
    "conv": f"""conv AS (SELECT conv_id AS doc_id, cast(turn + 1 AS INTEGER) AS page_no, text, cast(len({_WORDS.format('text')}) AS INTEGER) AS n_tokens FROM conversations)""",
    "toc": f"""toc0 AS (SELECT *, cast((page_no - 1) // 2 AS INTEGER) AS idx FROM pl WHERE page_no % 2 = 1), toc AS (
  SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN cast(idx // 3 + 1 AS VARCHAR) ELSE cast(idx // 3 + 1 AS VARCHAR) || '.' || cast(idx % 3 AS VARCHAR) END AS structure,
    array_to_string({_WORDS.format('text')}[1:5], ' ') AS title,
    cast(CASE WHEN idx % 7 = 6 THEN NULL WHEN idx % 5 = 4 THEN page_no - 3 ELSE page_no - 2 END AS INTEGER) AS page_num,
    page_no AS physical_index, '<physical_index_' || cast(page_no AS VARCHAR) || '>' AS physical_tag, idx % 2 = 0 AS appear_start, text AS page_text FROM toc0)""",
    "md": """md0 AS (SELECT t.doc_id, idx, repeat('#', CASE WHEN idx % 4 = 3 THEN 3 WHEN idx % 3 = 0 THEN 1 ELSE 2 END) || ' ' || title AS h, page_text, b.text AS behind
    FROM toc t LEFT JOIN pl b ON b.doc_id = t.doc_id AND b.page_no = t.physical_index + 1),
  md1 AS (SELECT doc_id, idx, unnest(CASE WHEN idx % 6 = 5 THEN ['```', h, '```', page_text, behind] ELSE [h, page_text, behind] END) AS text,
    unnest(CASE WHEN idx % 6 = 5 THEN [1, 2, 3, 4, 5] ELSE [1, 2, 3] END) AS k FROM md0),
  md AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS INTEGER) AS line_num, text FROM md1 WHERE text IS NOT NULL)""",
    "flags": "flags AS (SELECT doc_id, page_no - 1 AS page, CASE WHEN length(text) % 3 <> 0 THEN 'yes' ELSE 'no' END AS answer FROM pl)",
    "res": """res AS (SELECT 'm' || cast(user_id % 3 AS VARCHAR) AS model, CASE WHEN event_id % 2 = 0 THEN 'full_context' ELSE 'tree_search' END AS mode, event_id,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value >= 20 AS pass, least(value / 100, 1.0::DOUBLE) AS score,
    cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value / 10 AS latency FROM events WHERE value IS NOT NULL)""",
}


def with_views(*names: str, body: str) -> str:
    """SQL with the named views in front."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + body

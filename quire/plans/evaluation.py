"""Run evaluation cases through both modes and judge the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import evaluate, pages, search
from quire.operators.evaluate import FULL, TREE
from quire.sources.shared import light


def run(cases: DataFrame, nodes: DataFrame, page_rows: DataFrame, model: str = "rules", k: int = search.TOP_NODES) -> DataFrame:
    """Results of ``cases(case_id, doc_id, question, required_facts, forbidden_claims)`` in both modes.

    Tree search answers from the best nodes of the case's document, full context from all
    its pages. Usage counts words: the context as input, the answer as output. A case whose
    document is unknown is an error row without a verdict. ``nodes`` need text.
    """
    q = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"), "doc_id", "required_facts", "forbidden_claims")
    asked = nodes.join(light(q.select("doc_id").distinct(), search.BROADCAST_WORDS), "doc_id", "left_semi")
    mine = search.search_nodes(q.select("query_id", "query", "doc_id"), asked, k)
    tree = mine.join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"]).select("query_id", F.col("node_id").alias("label"), "text")
    full = q.join(page_rows, "doc_id").select("query_id", F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("label"), "text")
    known = page_rows.select("doc_id").distinct().withColumn("known", F.lit(True))
    out = None
    for mode, context in ((FULL, full), (TREE, tree)):
        answer = search.best_sentences(q.select("query_id", "query"), context)
        size = context.groupBy("query_id").agg(F.sum(t.count_tokens(F.col("text"))).cast("bigint").alias("n_in"))
        rows = q.join(answer, "query_id").join(size, "query_id", "left").join(known, "doc_id", "left")
        rows = evaluate.judged(rows).withColumn("known", F.coalesce("known", F.lit(False)))
        n_in = F.coalesce("n_in", F.lit(0)).cast("bigint")
        n_out = t.count_tokens(F.col("answer")).cast("bigint")
        zero = F.lit(0).cast("bigint")
        usage = F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens"), zero.alias("reasoning_tokens"), (n_in + n_out).alias("total_tokens"), zero.alias("cached_tokens"))
        none = F.struct(*(zero.alias(x) for x in evaluate.USAGE_KEYS))
        rows = rows.select(
            F.lit(model).alias("model"), F.lit(mode).alias("mode"), F.col("query_id").alias("case_id"), F.when(F.col("known"), "ok").otherwise("error").alias("status"),
            F.when(F.col("known"), F.col("judge")).alias("judge"), F.when(F.col("known"), usage).otherwise(none).alias("model_usage"), none.alias("judge_usage"),
            F.lit(0.0).alias("total_latency_sec"), F.when(~F.col("known"), F.lit("unknown document")).alias("error"), "answer",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def full_contexts(page_rows: DataFrame) -> DataFrame:
    return pages.full_context(page_rows)

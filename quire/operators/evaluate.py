"""Evaluation: retrieval metrics, the matrix over models and modes, deltas, advice, issues.

Two modes are compared: ``tree_search`` and ``full_context``. Results are
``model, mode, case_id, status, judge struct, model_usage, judge_usage, total_latency_sec``;
means are over results that are ok and judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t

TREE, FULL = "tree_search", "full_context"
USAGE_KEYS = ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "cached_tokens")
CITATION_QUALITY = ("missing", "weak", "adequate", "strong")
# Thresholds of the advice.
PASS_GAP, SCORE_GAP, TOKEN_GAP = 0.15, 0.1, 1000
PLACES = {"pass_rate": 4, "avg_score": 4, "avg_model_tokens": 1, "avg_judge_tokens": 1, "avg_total_latency_sec": 4}


def suite_filter(cases: DataFrame, suite: str) -> DataFrame:
    """``smoke`` keeps its own cases, ``full`` keeps both suites."""
    kept = {"smoke": ["smoke"], "full": ["smoke", "full"]}
    if suite not in kept:
        raise ValueError(f"unknown suite {suite}")
    return cases.where(F.col("suite").isin(*kept[suite]))


def model_names(text: str) -> list[str]:
    """Names from a comma-separated list."""
    names = [x.strip() for x in text.split(",") if x.strip()]
    if not names:
        raise ValueError("no model named")
    return names


def run_grid(models: DataFrame, cases: DataFrame) -> DataFrame:
    """Every model, case and mode (J6, E7). Both inputs are short lists."""
    modes = models.sparkSession.createDataFrame([(FULL,), (TREE,)], "mode string")
    return models.crossJoin(F.broadcast(cases)).crossJoin(F.broadcast(modes))


def add_usage(a: Column, b: Column) -> Column:
    """Element-wise sum of two usage structs; missing counts 0."""
    get = lambda u, k: F.coalesce(u.getField(k), F.lit(0))
    return F.struct(*((get(a, k) + get(b, k)).alias(k) for k in USAGE_KEYS))


def retrieval_metrics(results: DataFrame) -> DataFrame:
    """``query_id, hit, precision, recall`` of ``expected`` and ``retrieved`` id lists.

    An empty expected list is a hit with recall 1; precision is 0 if either list is empty.
    """
    e, r = F.array_distinct("expected"), F.array_distinct("retrieved")
    both, ne, nr = F.size(F.array_intersect(e, r)), F.size(e), F.size(r)
    return results.select(
        "query_id",
        ((ne == 0) | (both > 0)).alias("hit"),
        F.when((ne == 0) | (nr == 0), 0.0).otherwise(both / F.greatest(nr, F.lit(1))).alias("precision"),
        F.when(ne == 0, 1.0).otherwise(both / F.greatest(ne, F.lit(1))).alias("recall"),
    )


def benchmark_summary(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """One row: cases, hit rate and mean latency, zeros without cases (A10)."""
    mean = F.coalesce(F.avg(latency), F.lit(0.0)) if latency else F.lit(0.0)
    return metrics.agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("hit_rate"), mean.alias("avg_latency"))


def summary_matrix(results: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts and rounded means for every model and mode of ``grid(model, mode)``.

    Pairs without results are zeros. Rounding is half-even.
    """
    ok = (F.col("status") == "ok") & F.col("judge").isNotNull()
    mean = lambda c: F.avg(F.when(ok, c))
    agg = results.groupBy("model", "mode").agg(
        F.count("*").alias("cases"), F.count(F.when(ok, 1)).alias("successful_cases"),
        mean(F.col("judge.pass").cast("double")).alias("pass_rate"), mean(F.col("judge.score_0_to_1")).alias("avg_score"),
        mean(F.col("model_usage.total_tokens").cast("double")).alias("avg_model_tokens"), mean(F.col("judge_usage.total_tokens").cast("double")).alias("avg_judge_tokens"),
        mean(F.col("total_latency_sec")).alias("avg_total_latency_sec"),
    )
    out = grid.join(agg, ["model", "mode"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "model", "mode", zero("cases").cast("bigint").alias("cases"), zero("successful_cases").cast("bigint").alias("successful_cases"),
        *(F.bround(F.coalesce(c, F.lit(0.0)), n).alias(c) for c, n in PLACES.items()),
        zero(F.col("cases") - F.col("successful_cases")).cast("bigint").alias("errors"),
    )


def delta_table(matrix: DataFrame) -> DataFrame:
    """Tree search minus full context on the rounded matrix, one row per model."""
    wide = matrix.groupBy("model").pivot("mode", [TREE, FULL]).agg(*(F.first(c).alias(c) for c in PLACES))
    shown = [c for c in PLACES if c != "avg_judge_tokens"]
    return wide.select("model", *(F.bround(F.col(f"{TREE}_{c}") - F.col(f"{FULL}_{c}"), PLACES[c]).alias(f"delta_{c}") for c in shown))


def recommendation(matrix: DataFrame) -> DataFrame:
    """Which mode to use for each model; the first rule that holds wins."""
    wide = matrix.groupBy("model").pivot("mode", [TREE, FULL]).agg(*(F.first(c).alias(c) for c in PLACES))
    d = {c: F.col(f"{TREE}_{c}") - F.col(f"{FULL}_{c}") for c in PLACES}
    dp, ds, dt = d["pass_rate"], d["avg_score"], d["avg_model_tokens"]
    better, worse, cheaper = (dp >= PASS_GAP) | (ds >= SCORE_GAP), (dp <= -PASS_GAP) | (ds <= -SCORE_GAP), dt <= -TOKEN_GAP
    why = F.when(better, "quality").when(worse, "quality").when(cheaper, "tokens").otherwise("none")
    return wide.select("model", F.when(better, TREE).when(worse, FULL).when(cheaper, TREE).otherwise("either").alias("strategy"), why.alias("reason"))


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    """Counts of collapsed, non-blank issue texts (A6). ``issues(issue, ...)``."""
    return issues.withColumn("issue", t.collapse(F.col("issue"))).where("issue <> ''").groupBy(*by, "issue").agg(F.count("*").alias("n"))


def top_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent issues, ties by text (O2)."""
    return issue_counts(issues).orderBy(F.desc("n"), F.asc("issue")).limit(k)


def issue_totals(results: DataFrame, *by: str) -> DataFrame:
    """Numbers of missing facts and hallucinations, and whether omissions dominate."""
    missing, made_up = F.sum(F.size("judge.missing_facts")), F.sum(F.size("judge.hallucinations"))
    rows = results.where("status = 'ok' AND judge IS NOT NULL").groupBy(*by)
    out = rows.agg(F.coalesce(missing, F.lit(0)).alias("missing_facts"), F.coalesce(made_up, F.lit(0)).alias("hallucinations"))
    return out.withColumn("omission_dominated", F.col("missing_facts") > F.col("hallucinations"))


def judged(answers: DataFrame) -> DataFrame:
    """A verdict by rules (L23): ``answer, required_facts, forbidden_claims`` -> ``judge`` struct.

    A fact is missing, and a forbidden claim is made, by squashed containment. The score is
    the share of required facts found; a case passes with all facts and no forbidden claim.
    """
    a = t.squash(F.coalesce("answer", F.lit("")))
    missing = F.filter("required_facts", lambda f: ~F.contains(a, t.squash(f)))
    claims = F.filter("forbidden_claims", lambda f: F.contains(a, t.squash(f)))
    n = F.size("required_facts")
    score = F.when(n == 0, 1.0).otherwise(1 - F.size(missing) / F.greatest(n, F.lit(1)))
    cites = F.size(F.regexp_extract_all("answer", F.lit(r"\[[^\]]+\]"), F.lit(0)))
    quality = F.when(cites == 0, "missing").when(cites == 1, "weak").when(cites < 4, "adequate").otherwise("strong")
    ok = (F.size(missing) == 0) & (F.size(claims) == 0)
    return answers.withColumn("judge", F.struct(
        ok.alias("pass"), F.bround(score, 4).alias("score_0_to_1"), missing.alias("missing_facts"), claims.alias("hallucinations"),
        F.coalesce(quality, F.lit("missing")).alias("citation_quality"), F.when(ok, "all facts found").otherwise("facts missing or claims made").alias("rationale"),
    ))


def invalid_verdicts(results: DataFrame) -> DataFrame:
    """Results whose verdict breaks its schema: score outside [0, 1] or an unknown citation quality (F16)."""
    s, q = F.col("judge.score_0_to_1"), F.col("judge.citation_quality")
    return results.where("judge IS NOT NULL").where(~F.coalesce(s.between(0, 1) & q.isin(*CITATION_QUALITY), F.lit(False)))


def report(matrix: DataFrame, deltas: DataFrame, advice: DataFrame, most: int = 10_000) -> str:
    """A short Markdown report (E5, E6). The three tables have a row per model and mode, ``most`` at most (more raise a ValueError)."""
    show = {"pass_rate": lambda v: f"{v * 100:.1f}%", "avg_score": lambda v: f"{v:.3f}", "avg_total_latency_sec": lambda v: f"{v:.2f}"}
    parts = ["# Summary"]
    for title, df in (("Matrix", matrix), ("Tree search minus full context", deltas), ("Advice", advice)):
        held = df.orderBy(*df.columns[:2]).limit(most + 1).collect()
        if len(held) > most:
            raise ValueError(f"more than {most} rows for a report")
        rows = [[show.get(c, str)(r[c]) if r[c] is not None else "" for c in df.columns] for r in held]
        parts.append(f"## {title}\n\n{t.markdown_table(df.columns, rows)}")
    return "\n\n".join(parts) + "\n"

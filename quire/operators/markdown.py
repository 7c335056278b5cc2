"""Markdown lines to outline nodes: headings, sections, parents, rollups, thinning.

All steps are windows over ``doc_id`` in line order, so one exchange serves them all;
nothing is joined. Heading levels are at most six, which lets "nearest earlier heading
of a smaller level" and "first later heading that is not deeper" be six windows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text as t

LEVELS = range(1, 7)
def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, line_num, text`` of ``doc_id`` and a text column."""
    parts = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "text")
    return docs.select("doc_id", parts).select("doc_id", (F.col("pos") + 1).alias("line_num"), "text")


def marked_lines(md: DataFrame) -> DataFrame:
    """Lines with the level and title of headings outside code fences."""
    so_far = _doc().orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    fence = t.is_fence(F.col("text"))
    in_code = F.sum(F.when(fence, 1).otherwise(0)).over(so_far) % 2 == 1
    level = F.when(~fence & ~in_code, t.heading_level(F.col("text")))
    out = md.select("doc_id", "line_num", "text", level.alias("level"))
    return out.withColumn("title", F.when(F.col("level").isNotNull(), t.heading_title(F.col("text"))))


def headings(md: DataFrame) -> DataFrame:
    return marked_lines(md).where("level IS NOT NULL").select("doc_id", "line_num", "level", "title")


def sections(md: DataFrame) -> DataFrame:
    """``doc_id, ord, line_num, level, title, text, n_tokens``: a heading and its lines up to the next.

    Lines before the first heading belong to no section and go.
    """
    so_far = _doc().orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("level").isNotNull(), F.col("line_num")), ignorenulls=True).over(so_far)
    owned = marked_lines(md).withColumn("owner", owner).where("owner IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "text"))), lambda x: x["text"]), "\n")
    out = owned.groupBy("doc_id", "owner").agg(F.max("level").alias("level"), F.max("title").alias("title"), t.strip(joined).alias("text"))
    ord_ = F.row_number().over(_doc().orderBy("owner")) - 1
    return out.select("doc_id", ord_.alias("ord"), F.col("owner").alias("line_num"), "level", "title", "text", t.count_tokens(F.col("text")).alias("n_tokens"))


def parent_ord() -> Column:
    """Nearest earlier heading of a smaller level; null for roots."""
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before)) for k in LEVELS]
    return F.greatest(*last)


def run_end(value: Column, at_end: Column) -> Column:
    """``value`` at the first later heading that is not deeper, or ``at_end`` without one."""
    after = _doc().orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    found = F.coalesce(*(F.when(F.col("level") == k, F.first(F.when(F.col("level") <= k, value), ignorenulls=True).over(after)) for k in LEVELS))
    return F.coalesce(found, at_end)


def node_id(ord_: Column) -> Column:
    """Position padded with zeros to four digits; longer numbers stay whole."""
    s = ord_.cast("string")
    return F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)


def with_parents(secs: DataFrame) -> DataFrame:
    """Add ``parent_ord`` and ``depth``."""
    out = secs.withColumn("parent_ord", parent_ord())
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # Ancestors are the last headings of each smaller level that no later, smaller level has closed.
    open_ = [F.last(F.when(F.col("level") <= k, F.when(F.col("level") == k, F.col("ord")).otherwise(-1)), ignorenulls=True).over(before) for k in LEVELS]
    depth = sum((F.when((F.col("level") > k) & (open_[k - 1] >= 0), 1).otherwise(0) for k in LEVELS), F.lit(0))
    return out.withColumn("depth", depth.cast("int"))


def with_rollup(secs: DataFrame) -> DataFrame:
    """Add ``run_end`` (first ord behind the subtree) and ``subtree_tokens``.

    Tokens of joined texts are the sum of theirs, so a difference of running sums is enough.
    """
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = secs.withColumn("__before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    total, count = F.sum("n_tokens").over(_doc()), F.count("*").over(_doc()).cast("int")
    out = out.withColumn("run_end", run_end(F.col("ord"), count))
    out = out.withColumn("subtree_tokens", (run_end(F.col("__before"), total) - F.col("__before")).cast("bigint"))
    return out.drop("__before")


def thinned(secs: DataFrame, threshold: int) -> DataFrame:
    """Small subtrees folded into their top node.

    A node goes if a proper ancestor's subtree has fewer than ``threshold`` tokens; the
    topmost such ancestor takes the texts of all nodes below it. Ords are numbered anew.
    """
    rolled = with_rollup(secs)
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("subtree_tokens") < threshold, F.col("run_end"))).over(before)
    out = rolled.withColumn("gone", F.coalesce(covered > F.col("ord"), F.lit(False)))
    so_far = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("into", F.last(F.when(~F.col("gone"), F.col("ord")), ignorenulls=True).over(so_far))
    texts = F.transform(F.array_sort(F.collect_list(F.when((t.strip(F.col("text")) != "") | ~F.col("gone"), F.struct("ord", "text")))), lambda x: x["text"])
    first = F.min_by(F.struct("line_num", "level", "title"), "ord").alias("top")
    merged = out.groupBy("doc_id", "into").agg(first, F.array_join(F.filter(texts, lambda x: x != ""), "\n\n").alias("text"))
    ord_ = F.row_number().over(_doc().orderBy("into")) - 1
    return merged.select("doc_id", ord_.alias("ord"), "top.line_num", "top.level", "top.title", "text", t.count_tokens(F.col("text")).alias("n_tokens"))


def nodes(md: DataFrame, min_tokens: int | None = None, number: bool = True) -> DataFrame:
    """The flat node table of Markdown lines (C15), thinned below ``min_tokens`` if given.

    With ``number`` ids are 0-based and padded; without it they are the 1-based, unpadded
    numbers that building gives.
    """
    secs = sections(md)
    secs = thinned(secs, min_tokens) if min_tokens is not None else secs
    id_ = node_id(F.col("ord")) if number else (F.col("ord") + 1).cast("string")
    return with_parents(secs).select("doc_id", "ord", id_.alias("node_id"), "parent_ord", "depth", "level", "title", "line_num", "text", "n_tokens")


def summarised(nodes_: DataFrame, threshold: int = 200, sentences: int = 2) -> DataFrame:
    """Add ``summary`` to leaves and ``prefix_summary`` to inner nodes.

    A text under ``threshold`` tokens is its own summary, a longer one is cut to its leading sentences.
    """
    from quire.plans.reasoner import leading_sentences

    s = F.when(F.col("n_tokens") < threshold, F.col("text")).otherwise(leading_sentences(F.col("text"), sentences))
    next_level = F.lead("level").over(_doc().orderBy("ord"))
    inner = F.coalesce(next_level > F.col("level"), F.lit(False))
    return nodes_.withColumn("summary", F.when(~inner, s)).withColumn("prefix_summary", F.when(inner, s))

"""Outline trees as flat rows: parents from dotted paths, order, ids, leaves, rendering.

Rows are ``doc_id, idx, structure, title, ...``; ``parent_idx`` points into the same list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.markdown import node_id
from quire.operators.pages import in_order

def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def parent_path(structure: Column) -> Column:
    """The dotted path without its last part; null for top-level, empty and missing paths."""
    parts = F.split(structure, r"\.", -1)
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    return F.when((F.size(parts) > 1) & (up != ""), up)


def with_parents(items: DataFrame) -> DataFrame:
    """Add ``parent_idx``: the latest earlier item with exactly the parent's path.

    Items and look-ups are ordered together within a path, so a path that occurs often is a
    running value and no join. A child before its parent is a root.
    """
    own = items.select("doc_id", F.col("structure").alias("path"), "idx", F.lit(True).alias("defines"))
    ask = items.select("doc_id", parent_path(F.col("structure")).alias("path"), "idx", F.lit(False)).where("path IS NOT NULL")
    before = Window.partitionBy("doc_id", "path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    found = own.union(ask).withColumn("parent_idx", F.last(F.when(F.col("defines"), F.col("idx")), ignorenulls=True).over(before))
    found = found.where("NOT defines AND parent_idx IS NOT NULL").select("doc_id", "idx", "parent_idx")
    return items.drop("parent_idx").join(found, ["doc_id", "idx"], "left")


def paths(items: DataFrame) -> DataFrame:
    """``doc_id, idx, path``: each item's ancestors and itself, from the root down.

    Paths grow by doubling, so the number of joins is the logarithm of the longest dotted path.
    """
    parts = F.size(F.split(F.coalesce("structure", F.lit("")), r"\."))
    deepest = items.agg(F.max(parts)).first()[0] or 1
    now = items.select("doc_id", "idx", F.array("idx").alias("path"), F.col("parent_idx").alias("up"))
    reach = 1
    while reach < deepest:
        above = now.select("doc_id", F.col("idx").alias("up"), F.col("path").alias("over"), F.col("up").alias("next"))
        now = now.join(above, ["doc_id", "up"], "left").select(
            "doc_id", "idx", F.when(F.col("over").isNull(), F.col("path")).otherwise(F.concat("over", "path")).alias("path"), F.col("next").alias("up")
        )
        reach *= 2
    return now.select("doc_id", "idx", "path")


def with_order(items: DataFrame) -> DataFrame:
    """Add ``depth``, ``ord`` (pre-order) and ``node_id`` to items with ``parent_idx``."""
    out = items.join(paths(items), ["doc_id", "idx"])
    ord_ = F.row_number().over(_doc().orderBy("path")) - 1
    out = out.withColumn("depth", F.size("path") - 1).withColumn("ord", ord_).drop("path")
    return out.withColumn("node_id", node_id(F.col("ord")))


def with_parent_ord(nodes: DataFrame) -> DataFrame:
    """Add ``parent_ord``, the parent's place in pre-order."""
    up = nodes.select("doc_id", F.col("idx").alias("parent_idx"), F.col("ord").alias("parent_ord"))
    return nodes.join(up, ["doc_id", "parent_idx"], "left")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children (T5)."""
    parents = nodes.where("parent_idx IS NOT NULL").select("doc_id", F.col("parent_idx").alias("idx")).distinct()
    return nodes.join(parents, ["doc_id", "idx"], "left_anti")


def is_leaf(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(doc_id, node_id)`` with ``is_leaf``; unknown nodes are none."""
    known = leaves(nodes).select("doc_id", "node_id", F.lit(True).alias("leaf"))
    return asked.join(known, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("leaf", F.lit(False)).alias("is_leaf"))


def last_root(nodes: DataFrame) -> DataFrame:
    """The last top-level node of each document."""
    return nodes.where("depth = 0").groupBy("doc_id").agg(F.max_by("node_id", "ord").alias("node_id"), F.max_by("title", "ord").alias("title"))


def rendered(nodes: DataFrame, style: str = "plain") -> DataFrame:
    """``doc_id, tree``: the outline as indented lines.

    ``plain``: ``[id] title (pS-E)`` and an excerpt of summary or text below (T9).
    ``glyph``: en dash ranges and summaries cut at 120 code points (T10). ``titles``: titles only (T11).
    """
    def optional(name: str) -> Column:
        return F.col(name) if name in nodes.columns else F.lit(None).cast("string")

    indent = F.repeat(F.lit("  "), F.col("depth"))
    title = F.coalesce("title", F.lit("Untitled"))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    if style == "titles":
        line = F.concat(indent, title)
    else:
        missing, dash = ("-", "-") if style == "plain" else ("—", "–")
        head = F.concat(indent, F.lit("["), F.coalesce("node_id", F.lit(missing)), F.lit("] "), title, F.lit(" (p"), page("start_index"), F.lit(dash), page("end_index"), F.lit(")"))
        summary = F.nullif(optional("summary"), F.lit(""))
        if style == "plain":
            about, mark = t.excerpt(F.coalesce(summary, t.excerpt(optional("text"))), 180), "  - "
        else:
            about, mark = F.when(F.length(summary) > 120, F.concat(F.left(summary, F.lit(120)), F.lit("…"))).otherwise(summary), "     └ "
        line = F.when(F.coalesce(about, F.lit("")) != "", F.concat(head, F.lit("\n"), indent, F.lit(mark), about)).otherwise(head)
    return nodes.withColumn("line", line).groupBy("doc_id").agg(in_order("ord", "line", "\n").alias("tree"))


def without(nodes: DataFrame, *names: str) -> DataFrame:
    """Drop columns; unknown names are ignored."""
    return nodes.drop(*names)


def projected(nodes: DataFrame, *names: str) -> DataFrame:
    """Keep the named columns that exist, in the given order."""
    return nodes.select(*(c for c in names if c in nodes.columns))


def described(nodes: DataFrame) -> DataFrame:
    """What a description of a document is made from (P10)."""
    return projected(nodes, "title", "node_id", "summary", "prefix_summary")


def large_nodes(nodes: DataFrame, max_pages: int, min_tokens: int) -> DataFrame:
    """Nodes over both limits, whose pages are to be indexed again (T13's test)."""
    return nodes.where((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("n_tokens") >= min_tokens))


def over_limit(nodes: DataFrame, limit: int = 110_000) -> DataFrame:
    """Nodes with more than ``limit`` tokens."""
    return nodes.where(F.col("n_tokens") > limit)


def subtree_end(nodes: DataFrame) -> DataFrame:
    """Add ``subtree_end_index``: the last page of a node or anything below it (Z1), handed to all ancestors at once."""
    ends = nodes.select("doc_id", "idx", "end_index").join(paths(nodes), ["doc_id", "idx"])
    top = ends.select("doc_id", F.explode("path").alias("idx"), "end_index").groupBy("doc_id", "idx").agg(F.max("end_index").alias("subtree_end_index"))
    return nodes.join(top, ["doc_id", "idx"])

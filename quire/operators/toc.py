"""Contents-page arithmetic: islands, offsets, spans, prefaces and page ranges.

Items are ``doc_id, idx, structure, title, page_num, physical_index, appear_start``;
``idx`` is the place in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def islands(flags: DataFrame, limit: int = 20, start: int = 0) -> DataFrame:
    """0-based contents pages: the first run of ``yes`` that begins before ``limit``.

    ``flags(doc_id, page, answer)``. Only an explicit ``no`` ends the run; other answers
    neither extend nor end it.
    """
    f = flags.where(F.col("page") >= start)
    first = F.min(F.when((F.col("answer") == "yes") & (F.col("page") < limit), F.col("page"))).over(_doc())
    f = f.withColumn("first_yes", first).where("first_yes IS NOT NULL")
    stop = F.min(F.when((F.col("answer") == "no") & (F.col("page") > F.col("first_yes")), F.col("page"))).over(_doc())
    inside = (F.col("page") >= F.col("first_yes")) & (F.col("page") < F.coalesce(F.col("stop"), F.lit(2**31 - 1)))
    return f.withColumn("stop", stop).where(inside & (F.col("answer") == "yes")).select("doc_id", "page")


def page_pairs(printed: DataFrame, found: DataFrame, start: int = 0) -> DataFrame:
    """Items with a printed page joined to items with a physical one, by title.

    Null titles match each other; repeated titles multiply. ``pair_ord`` keeps list order.
    """
    p = printed.select("doc_id", F.col("idx").alias("toc_idx"), F.col("title").alias("toc_title"), "page_num")
    q = found.where(F.col("physical_index") >= start).select(F.col("doc_id").alias("doc"), F.col("idx").alias("phy_idx"), "title", "physical_index")
    both = q.join(p, (q["doc"] == p["doc_id"]) & q["title"].eqNullSafe(p["toc_title"]))
    return both.select("doc_id", "phy_idx", "toc_idx", "title", "page_num", "physical_index")


def page_offset(pairs: DataFrame) -> DataFrame:
    """``doc_id, page_offset``: most frequent difference, of ties the one seen first (A1)."""
    diff = pairs.where("page_num IS NOT NULL AND physical_index IS NOT NULL").withColumn("diff", F.col("physical_index") - F.col("page_num"))
    n = diff.groupBy("doc_id", "diff").agg(F.count("*").alias("n"), F.min(F.struct("phy_idx", "toc_idx")).alias("seen"))
    best = F.max_by("diff", F.struct("n", (-F.col("seen.phy_idx")).alias("a"), (-F.col("seen.toc_idx")).alias("b")))
    return n.groupBy("doc_id").agg(best.alias("page_offset"))


def apply_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """Physical pages from printed ones (F4); items without a printed page keep theirs."""
    out = items.join(offsets, "doc_id", "left")
    moved = F.when(F.col("page_num").isNotNull(), F.col("page_num") + F.col("page_offset")).otherwise(F.col("physical_index"))
    return out.withColumn("physical_index", moved.cast("int")).drop("page_offset")


def within_pages(items: DataFrame, sizes: DataFrame, start: int = 1) -> DataFrame:
    """Physical pages outside ``[start, n_pages + start - 1]`` become null (P4). ``sizes(doc_id, n_pages)``."""
    top = F.col("n_pages") + start - 1
    ok = (F.col("physical_index") <= top) & (F.col("physical_index") >= start)
    return items.join(sizes, "doc_id").withColumn("physical_index", F.when(ok, F.col("physical_index"))).drop("n_pages")


def sampled(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` items of each document, chosen by a seeded hash (O4). A sampling operator: nothing calls it unasked."""
    order = F.row_number().over(_doc().orderBy(F.xxhash64("idx", F.lit(seed)), "idx"))
    return items.withColumn("__n", order).where(F.col("__n") <= n).drop("__n")


def located(items: DataFrame) -> DataFrame:
    """Items that have a physical page."""
    return items.where("physical_index IS NOT NULL")


def neighbours(known: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """Nearest earlier and later known value by ``idx``, with defaults.

    Values to leave out (X5) are passed as null.
    """
    w = _doc().orderBy("idx")
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(prev, before), F.coalesce(next_, after)


def with_preface(items: DataFrame) -> DataFrame:
    """A preface on page 1 where the first item begins later (W10); ``idx`` is numbered anew."""
    first = F.row_number().over(_doc().orderBy("idx"))
    head = items.withColumn("__n", first).where((F.col("__n") == 1) & (F.col("physical_index") > 1)).drop("__n")
    own = {"idx": F.lit(-1), "structure": F.lit("0"), "title": F.lit("Preface"), "physical_index": F.lit(1)}
    head = head.select("doc_id", *(own.get(c, F.lit(None).cast(head.schema[c].dataType)).alias(c) for c in head.columns if c != "doc_id"))
    both = items.unionByName(head.select(*items.columns))
    return both.withColumn("idx", F.row_number().over(_doc().orderBy("idx")) - 1)


def page_ranges(items: DataFrame, ends: DataFrame) -> DataFrame:
    """Add ``start_index`` and ``end_index`` (W1). ``ends(doc_id, last_page)``.

    An item ends one page before the next one in the list if that begins its page, else on
    that page; the last ends with the document. Ends before starts are possible and kept.
    """
    w = _doc().orderBy("idx")
    next_start, next_top = F.lead("physical_index").over(w), F.lead("appear_start").over(w)
    end = F.when(F.lead("idx").over(w).isNull(), F.col("last_page")).when(F.coalesce(next_top, F.lit(False)), next_start - 1).otherwise(next_start)
    out = items.join(ends, "doc_id").withColumn("start_index", F.col("physical_index")).withColumn("end_index", end.cast("int"))
    return out.drop("last_page")

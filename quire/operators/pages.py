"""Page tables: labels, ranges, contexts and budgeted chunks. Pages are ``doc_id, page_no, text, n_tokens``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t


def labelled(text: Column, page_no: Column, gap: int = 1) -> Column:
    """A page between two equal tags, with ``gap`` line feeds behind."""
    tag = F.concat(F.lit(f"<{t.TAG}_"), page_no.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag, F.lit("\n" * gap))


def in_order(key: str, value: str, sep: str = "") -> Column:
    """Aggregate: strings joined by a key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), sep)


def node_pages(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each node and page of its range (J4), as an equi-join on exploded ranges.

    Ranges that end before they start have no page.
    """
    span = F.when(F.col("start_index") <= F.col("end_index"), F.sequence("start_index", "end_index"))
    return nodes.select("doc_id", "ord", F.explode(span).alias("page_no")).join(pages, ["doc_id", "page_no"])


def with_tokens(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``n_tokens`` of each node's pages without touching their texts."""
    agg = node_pages(nodes, pages.select("doc_id", "page_no", "n_tokens")).groupBy("doc_id", "ord").agg(F.sum("n_tokens").cast("int").alias("n_tokens"))
    return nodes.drop("n_tokens").join(agg, ["doc_id", "ord"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def with_text(nodes: DataFrame, pages: DataFrame, tags: bool = False, text: bool = True) -> DataFrame:
    """Add ``text``, the pages of each node's range joined (P2, T14), and ``n_tokens``; none gives ''.
    Without ``text`` only ``n_tokens``, and no text is moved.

    Pages and nodes meet in one row a document, so each page is shuffled once however many
    nodes it belongs to. Where a document's pages are numbered without gaps a range is a slice.
    """
    if tags:
        pages = pages.withColumn("text", labelled(F.col("text"), F.col("page_no")))
    held = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", *(["text"] if text else []), "n_tokens"))).alias("__pages"))
    own = [c for c in nodes.columns if c not in ("doc_id", "text", "n_tokens")]
    docs = nodes.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("__nodes")).join(held, "doc_id", "left")
    docs = docs.withColumn("__first", F.col("__pages")[0]["page_no"])
    even = F.expr("coalesce(size(array_distinct(transform(__pages, p -> p.page_no))) = size(__pages) AND element_at(__pages, -1).page_no - __first + 1 = size(__pages), false)")
    inside = """CASE WHEN __pages IS NULL OR NOT coalesce(x.start_index <= x.end_index AND __first <= x.end_index, false) THEN NULL
      WHEN __even THEN slice(__pages, cast(greatest(x.start_index, __first) - __first + 1 AS int), cast(x.end_index - greatest(x.start_index, __first) + 1 AS int))
      ELSE filter(__pages, p -> p.page_no BETWEEN x.start_index AND x.end_index) END"""
    rows = docs.withColumn("__even", even).select("doc_id", F.explode(F.expr(f"transform(__nodes, x -> struct(x, {inside} AS inside))")).alias("__r"))
    joined = [F.expr("coalesce(array_join(transform(__r.inside, p -> p.text), ''), '')").alias("text")] if text else []
    count = F.expr("cast(coalesce(aggregate(__r.inside, 0L, (s, p) -> s + coalesce(p.n_tokens, 0)), 0) AS int)")
    return rows.select("doc_id", *(F.col("__r")["x"][c].alias(c) for c in own), *joined, count.alias("n_tokens"))


def page_range(pages: DataFrame, first: int, last: int, tag: str = "start_index") -> DataFrame:
    """Text of pages ``first`` to ``last`` of every document between numbered tags (S3)."""
    n = F.col("page_no").cast("string")
    body = F.concat(F.lit(f"<{tag}_"), n, F.lit(">\n"), F.col("text"), F.lit(f"\n<{tag.replace('start', 'end')}_"), n, F.lit(">\n"))
    inside = pages.where(F.col("page_no").between(first, last)).withColumn("text", body)
    return inside.groupBy("doc_id").agg(in_order("page_no", "text").alias("text"), F.count("*").alias("n_pages"))


def full_context(pages: DataFrame) -> DataFrame:
    """``doc_id, context``: every page that is not blank as ``[pN]`` and its collapsed text."""
    rows = pages.withColumn("text", t.collapse(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("text", F.concat(F.lit("[p"), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text")))
    return rows.groupBy("doc_id").agg(in_order("page_no", "text", "\n\n").alias("context"))


def chunk_spans(pages: DataFrame, max_tokens: int, overlap: int = 1) -> DataFrame:
    """``doc_id, chunk_no, first_page, last_page, n_tokens``: greedy chunks under a budget.

    A document within the budget is one chunk. Otherwise chunks aim at the mean of an even
    part and the budget; each begins with the last ``overlap`` pages of the one before,
    whose tokens count. A page is never split; if the first page alone is over the aim the
    first chunk is empty (its last page lies before its first).
    """
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "n_tokens"))).alias("p"), F.sum("n_tokens").alias("total"))
    p = p.withColumn("t", F.expr("transform(p, x -> cast(x.n_tokens AS bigint))")).withColumn("parts", F.expr(f"ceil(total / {max_tokens})"))
    p = p.withColumn("aim", F.expr(f"CASE WHEN total <= {max_tokens} THEN total ELSE ceil((total / parts + {max_tokens}) / 2) END"))
    # Fold over pages: closed chunks, first page and tokens of the open one.
    fold = f"""
      aggregate(sequence(0, size(t) - 1),
        struct(cast(array() AS array<struct<lo:int,hi:int>>) AS done, 0 AS lo, 0L AS n),
        (a, i) -> CASE WHEN a.n + t[i] > aim THEN struct(
            concat(a.done, array(struct(a.lo AS lo, i - 1 AS hi))) AS done,
            greatest(i - {overlap}, 0) AS lo,
            aggregate(slice(t, greatest(i - {overlap}, 0) + 1, i - greatest(i - {overlap}, 0)), 0L, (s, x) -> s + x) + t[i] AS n)
          ELSE struct(a.done AS done, a.lo AS lo, a.n + t[i] AS n) END,
        a -> concat(a.done, array(struct(a.lo AS lo, size(t) - 1 AS hi))))"""
    out = p.where(F.size("p") > 0).select("doc_id", "p", "t", F.posexplode(F.expr(fold)).alias("chunk_no", "c"))
    tokens = F.expr("aggregate(slice(t, c.lo + 1, greatest(c.hi - c.lo + 1, 0)), 0L, (s, x) -> s + x)")
    return out.select("doc_id", "chunk_no", F.expr("p[c.lo].page_no").alias("first_page"), F.expr("coalesce(get(p, c.hi).page_no, p[c.lo].page_no - 1)").alias("last_page"), tokens.alias("n_tokens"))


def chunks(pages: DataFrame, max_tokens: int, overlap: int = 1) -> DataFrame:
    """Chunks with the texts of their pages joined."""
    spans = chunk_spans(pages, max_tokens, overlap)
    ranged = spans.withColumnRenamed("first_page", "start_index").withColumnRenamed("last_page", "end_index").withColumn("ord", F.col("chunk_no"))
    return with_text(ranged.drop("n_tokens"), pages).select(
        "doc_id", "chunk_no", F.col("start_index").alias("first_page"), F.col("end_index").alias("last_page"), "n_tokens", "text"
    )

"""From pages to an outline index: find contents, place items, verify, repair, split.

Every step is one plan over all documents; the driver only sequences the few rounds of
the mode cascade (per-document modes are a column), of repairs, and of node splitting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import pages as pg
from quire.operators import toc, tree
from quire.plans.options import Options
from quire.plans.reasoner import Reasoner, RuleReasoner, contents_lines
from quire.sources.shared import light, shared_folder

#: Ids of documents up to which they are broadcast.
BROADCAST_DOCUMENTS = 500_000


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")
ITEM = ["doc_id", "idx", "structure", "title", "page_num", "physical_index"]


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage between rounds by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))


def find_contents(pages: DataFrame, r: Reasoner, limit: int) -> DataFrame:
    """``doc_id, contents, has_numbers, last_page0`` of documents with contents pages.

    All runs of contents pages that begin before ``limit`` are seen at once; the first with
    page numbers wins, else the first.
    """
    flags = pages.select("doc_id", (F.col("page_no") - 1).alias("page"), "text", r.lists_contents(F.col("text")).alias("answer"))
    flags = flags.withColumn("text", F.when(F.col("answer") == "yes", F.col("text")))  # no other text is used below
    before = _doc().orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("answer") == "no", 1).otherwise(0)).over(before)
    runs = flags.withColumn("run", run).where("answer = 'yes'").groupBy("doc_id", "run").agg(
        F.min("page").alias("first_page0"), F.max("page").alias("last_page0"), pg.in_order("page", "text", "\n").alias("contents")
    ).where(F.col("first_page0") < limit)
    runs = runs.withColumn("contents", t.dot_leaders(F.col("contents"))).withColumn("has_numbers", r.has_page_numbers(F.col("contents")) == "yes")
    best = F.max_by(F.struct("contents", "has_numbers", "last_page0"), F.struct(F.col("has_numbers"), -F.col("run")))
    return runs.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def parse_contents(found: DataFrame) -> DataFrame:
    """Contents text to items (L8); the page column is split in its raw and numeric form."""
    rows = found.select("doc_id", F.posexplode(contents_lines(F.col("contents"))).alias("idx", "x")).select("doc_id", "idx", "x.*")
    return rows.withColumn("page_num", t.page_number(F.col("page_raw"))).drop("page_raw").withColumn("physical_index", F.lit(None).cast("int"))


def first_mention(items: DataFrame, pages: DataFrame, r: Reasoner, lo: str, hi: str) -> DataFrame:
    """``doc_id, idx, found``: the first page in ``[lo, hi]`` on which an item's title appears.

    The pages of a span are an equi-join on exploded page numbers.
    """
    span = F.when(F.col(lo) <= F.col(hi), F.sequence(F.greatest(F.col(lo), F.lit(1)), F.greatest(F.col(hi), F.lit(1))))
    asked = items.select("doc_id", "idx", "title", F.explode(span).alias("page_no")).join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    return asked.where(r.on_page(F.col("title"), F.col("text"))).groupBy("doc_id", "idx").agg(F.min("page_no").cast("int").alias("found"))


def headed(pages: DataFrame, r: Reasoner, tops: bool = True) -> DataFrame:
    """``doc_id, page_no, title, appear_start`` of pages on which a section begins.

    Both are asked where the page is, so its text goes no further. Without ``tops`` only titles.
    """
    title = r.heading(F.col("text"))
    if getattr(r, "plain", False):  # a filter on a plain column would work it out a second time
        rows = pages.select("doc_id", "page_no", "text", F.explode(F.filter(F.array(title), F.isnotnull)).alias("title"))
    else:
        rows = pages.select("doc_id", "page_no", "text", title.alias("title")).where("title IS NOT NULL")
    return rows.select("doc_id", "page_no", "title", *([r.starts_page(F.col("title"), F.col("text")).alias("appear_start")] if tops else []))


def without_contents(pages: DataFrame, r: Reasoner, start: int = 1, tops: bool = False) -> DataFrame:
    """Items from headings on the pages themselves (C4, R4); numbered in page order."""
    rows = headed(pages, r, tops)
    idx = F.row_number().over(_doc().orderBy("page_no")) - 1
    rows = rows.withColumn("idx", idx)
    return rows.select("doc_id", "idx", (F.col("idx") + 1).cast("string").alias("structure"), "title", F.lit(None).cast("int").alias("page_num"), F.col("page_no").cast("int").alias("physical_index"), *(["appear_start"] if tops else []))


def with_contents(items: DataFrame, pages: DataFrame, r: Reasoner) -> DataFrame:
    """Items of contents without page numbers: the first page of the document with the title."""
    asked = items.join(sizes(pages), "doc_id").withColumn("lo", F.lit(1))
    found = first_mention(asked, pages, r, "lo", "n_pages")
    return items.join(found, ["doc_id", "idx"], "left").withColumn("physical_index", F.col("found")).select(*ITEM)


def with_page_numbers(items: DataFrame, contents: DataFrame, pages: DataFrame, r: Reasoner, limit: int) -> DataFrame:
    """Items of contents with page numbers (C6): place some, infer the offset, apply it, fill the rest."""
    last = contents.select("doc_id", (F.col("last_page0") + 1).alias("start"))
    asked = items.join(last, "doc_id").withColumn("lo", F.col("start") + 1).withColumn("hi", F.col("start") + limit)
    found = first_mention(asked, pages, r, "lo", "hi").join(items.select("doc_id", "idx", "title"), ["doc_id", "idx"])
    pairs = toc.page_pairs(items, found.withColumnRenamed("found", "physical_index")).join(last, "doc_id").where("physical_index >= start")
    moved = toc.apply_offset(items.drop("physical_index").withColumn("physical_index", F.lit(None).cast("int")), toc.page_offset(pairs))
    return fill_missing(moved, pages, r).select(*ITEM)


def fill_missing(items: DataFrame, pages: DataFrame, r: Reasoner) -> DataFrame:
    """Place items without a physical page between their neighbours."""
    prev, next_ = toc.neighbours(F.col("physical_index"), F.lit(0), F.lit(-1))
    open_ = items.withColumn("lo", prev).withColumn("hi", next_).where("physical_index IS NULL")
    found = first_mention(open_, pages, r, "lo", "hi")
    out = items.join(found, ["doc_id", "idx"], "left")
    return out.withColumn("physical_index", F.coalesce("physical_index", "found")).drop("found")


def verified(items: DataFrame, pages: DataFrame, r: Reasoner, start: int = 1) -> DataFrame:
    """Items with ``correct``, and per document ``accuracy`` and ``reaches_middle``.

    Where the last placed item lies before the middle of the document nothing is checked and
    the accuracy is 0.
    """
    rows = items.join(sizes(pages), "doc_id")
    last = F.last(F.col("physical_index"), ignorenulls=True).over(_doc().orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("reaches_middle", F.coalesce(last - (start - 1) >= F.col("n_pages") / 2, F.lit(False)))
    text = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("page_text"))
    rows = rows.join(text, ["doc_id", "physical_index"], "left").withColumn("correct", F.when(F.col("physical_index").isNotNull(), r.on_page(F.col("title"), F.col("page_text"))))
    mean = F.coalesce(F.avg(F.col("correct").cast("int")).over(_doc()), F.lit(0.0))
    rows = rows.withColumn("accuracy", F.when(F.col("reaches_middle"), mean).otherwise(0.0))
    return rows.drop("page_text", "n_pages")


def fixed(checked: DataFrame, pages: DataFrame, r: Reasoner, start: int = 1) -> DataFrame:
    """One round of repairs (C9): look for wrong items between their right neighbours, keep what verifies."""
    end = checked.join(sizes(pages), "doc_id").withColumn("last_page", F.col("n_pages") + start - 1)
    known = F.when(F.col("correct"), F.col("physical_index"))
    prev, next_ = toc.neighbours(known, F.lit(start - 1), F.col("last_page"))
    wrong = end.withColumn("lo", prev).withColumn("hi", next_).where("NOT correct")
    found = first_mention(wrong, pages, r, "lo", "hi")
    out = checked.join(found, ["doc_id", "idx"], "left")
    better = ~F.coalesce(F.col("correct"), F.lit(True)) & F.col("found").isNotNull()
    return out.withColumn("physical_index", F.when(better, F.col("found")).otherwise(F.col("physical_index"))).withColumn(
        "correct", F.col("correct") | better
    ).drop("found")


def repaired(checked: DataFrame, pages: DataFrame, r: Reasoner, rounds: int = 3) -> DataFrame:
    """Repairs until nothing is wrong, ``rounds`` times at most."""
    for _ in range(rounds):
        checked = cut(fixed(checked, pages, r))
        if checked.where("NOT correct").isEmpty():
            break
    return checked


def with_tops(items: DataFrame, pages: DataFrame, r: Reasoner) -> DataFrame:
    """Add ``appear_start``: whether an item's title begins its page."""
    text = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("page_text"))
    out = toc.located(items).join(text, ["doc_id", "physical_index"], "left")
    return out.withColumn("appear_start", r.starts_page(F.col("title"), F.col("page_text"))).drop("page_text")


def cascade(pages: DataFrame, r: Reasoner, o: Options, tops: bool = False) -> DataFrame:
    """Items with the ``mode`` that made them (C11), and with ``tops`` also ``appear_start``.

    Documents with usable contents begin with their page numbers, all others without
    contents (C12). A perfect result is accepted, one above the limit is repaired and then
    accepted as it is; anything else falls to the next mode, the last being accepted anyway
    and therefore not verified. Without usable contents the last mode is the only one.
    """
    contents = cut(find_contents(pages, r, o.toc_check_pages))
    usable = contents.where("has_numbers AND trim(contents) <> ''")
    known = light(usable.select("doc_id"), BROADCAST_DOCUMENTS)
    parsed = cut(parse_contents(usable))
    todo, done = pages, []
    rounds = [("with_page_numbers", lambda p: with_page_numbers(parsed, contents, p, r, o.toc_check_pages)), ("without_page_numbers", lambda p: with_contents(parsed, p, r)), ("no_contents", lambda p: without_contents(p, r, tops=tops))]
    columns = [*ITEM, "mode", *(["appear_start"] if tops else [])]
    for mode, make in rounds if not usable.isEmpty() else rounds[-1:]:
        mine = todo if mode == "no_contents" else todo.join(known, "doc_id", "left_semi")
        items = toc.within_pages(toc.located(make(mine)), sizes(mine))
        if mode == "no_contents":
            done.append(cut(items.withColumn("mode", F.lit(mode)).select(*columns)))
            break
        checked = cut(verified(items, mine, r).withColumn("mode", F.lit(mode)))
        wrong = F.max(F.when(~F.col("correct"), 1).otherwise(0)).over(_doc())
        checked = checked.withColumn("any_wrong", wrong)
        accept = (F.col("accuracy") == 1.0) & (F.col("any_wrong") == 0)
        repair = ~accept & (F.col("accuracy") > o.accept_above)
        good = checked.where(accept)
        mended = repaired(checked.where(repair).drop("any_wrong"), mine, r, o.fix_rounds)
        out = cut(good.drop("any_wrong").unionByName(mended).select(*ITEM, "mode"))
        done.append(cut(with_tops(out, mine, r).select(*columns)) if tops else out)
        todo = todo.join(light(out.select("doc_id").distinct(), BROADCAST_DOCUMENTS), "doc_id", "left_anti")
    return reduce(DataFrame.unionByName, done).where("physical_index IS NOT NULL")


def few(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of the documents named in ``docs`` if these can be broadcast, else all: a filter that shuffles nothing."""
    ids = docs.select("doc_id").distinct()
    known = light(ids, BROADCAST_DOCUMENTS)
    return rows if known is ids else rows.join(known, "doc_id", "left_semi")


def split_large(nodes: DataFrame, pages: DataFrame, r: Reasoner, o: Options) -> DataFrame:
    """Index the pages of oversized nodes again, below them, until none is left.

    A node that gives a heading equal to its own title loses that heading; its end shrinks
    to its first child's start. Every node is split once at most, so the rounds end when
    new nodes are small or give no headings.

    A round sees the nodes made by the one before, named by their path from the node they
    began with. These lie inside their parents, so headings are looked for once, before the
    first split, and no round moves a text; all nodes are put in order at the end.
    """
    fresh = nodes.where("NOT split").select("doc_id", F.array("idx").alias("path"), "structure", "title", "start_index", "end_index")
    found, seen, made = None, [], []
    while True:
        # Nodes of few pages are small whatever they hold.
        long = fresh.where(F.col("end_index") - F.col("start_index") > o.max_pages_per_node)
        sized = pg.with_tokens(long.withColumn("ord", F.col("path")), pages)
        big = cut(tree.large_nodes(sized, o.max_pages_per_node, o.max_tokens_per_node).select(*fresh.columns))
        if big.isEmpty():
            break
        pages = few(pages, big)
        keys = big.select("doc_id", F.col("path").alias("parent"), F.col("structure").alias("up"), F.col("title").alias("own"), "end_index", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
        if found is None:
            # Plain columns are asked of every page; a question that costs more, of pages inside only.
            asked = pages if getattr(r, "plain", False) else pages.join(keys.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
            found = cut(headed(asked, r))
        w = Window.partitionBy("doc_id", "parent").orderBy("page_no")
        kids = keys.join(found, ["doc_id", "page_no"]).withColumn("k", F.row_number().over(w))
        kids = kids.where(~((F.col("k") == 1) & (F.trim("title") == F.trim("own")))).withColumn("k", F.row_number().over(w))
        end = F.coalesce(F.when(F.lead("appear_start").over(w), F.lead("page_no").over(w) - 1).otherwise(F.lead("page_no").over(w)), F.col("end_index"))
        kids = kids.withColumn("end", end).select("doc_id", F.concat("parent", F.array("k")).alias("path"), F.concat_ws(".", "up", F.col("k").cast("string")).alias("structure"), "title", F.col("page_no").cast("int").alias("start_index"), F.col("end").cast("int").alias("end_index"))
        fresh = cut(kids)
        seen.append(big.select("doc_id", "path"))
        made.append(fresh)
    if not seen:
        return nodes
    new = reduce(DataFrame.unionByName, made)
    first = new.where("element_at(path, -1) = 1").select("doc_id", F.expr("slice(path, 1, size(path) - 1)").alias("path"), F.col("start_index").alias("shrunk"))
    marks = reduce(DataFrame.unionByName, seen).withColumn("seen", F.lit(True)).join(first, ["doc_id", "path"], "left")
    both = nodes.withColumn("path", F.array("idx")).unionByName(new.withColumn("split", F.lit(False)), allowMissingColumns=True).join(marks, ["doc_id", "path"], "left")
    both = both.withColumn("end_index", F.coalesce("shrunk", "end_index")).withColumn("split", F.col("split") | F.coalesce("seen", F.lit(False)))
    return cut(both.withColumn("idx", F.row_number().over(_doc().orderBy("path")) - 1).select(*nodes.columns))


def index_documents(pages: DataFrame, options: Options | None = None, reasoner: Reasoner | None = None, splitter: Reasoner | None = None) -> DataFrame:
    """The outline index of every document as flat node rows.

    ``pages(doc_id, page_no, text, n_tokens)`` -> ``doc_id, ord, node_id, parent_ord, depth,
    structure, title, start_index, end_index, n_tokens, summary, text`` as the options ask.
    ``splitter`` looks for headings inside oversized nodes; the reasoner itself by default.
    """
    o, r = options or Options(), reasoner or RuleReasoner()
    pages = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text", F.col("n_tokens").cast("int").alias("n_tokens"))
    items = toc.with_preface(cascade(pages, r, o, tops=True))  # a preface comes first, so its flag is not used
    ends = sizes(pages).withColumnRenamed("n_pages", "last_page")
    flat = toc.page_ranges(items, ends).select("doc_id", "idx", "structure", "title", "start_index", "end_index", "mode").withColumn("split", F.lit(False))
    flat = split_large(cut(flat), pages, splitter or r, o).drop("split")
    # The tree is made of paths alone; titles and ranges are joined to it once.
    shape = tree.with_parent_ord(tree.with_order(tree.with_parents(flat.select("doc_id", "idx", "structure"))))
    nodes = flat.join(shape.drop("structure"), ["doc_id", "idx"]).drop("idx", "parent_idx")
    nodes = pg.with_text(nodes, pages, text=o.add_node_summary or o.add_node_text)
    if o.add_node_summary:
        nodes = nodes.withColumn("summary", F.when(F.col("n_tokens") < o.summary_tokens, F.col("text")).otherwise(r.summary(F.col("text"))))
    keep = ["doc_id", "ord", *(["node_id"] if o.add_node_id else []), "parent_ord", "depth", "structure", "title", "start_index", "end_index", "n_tokens", *(["summary"] if o.add_node_summary else []), *(["text"] if o.add_node_text else []), "mode"]
    return nodes.select(*keep)


def descriptions(nodes: DataFrame) -> DataFrame:
    """``doc_id, doc_description``: one sentence from the top-level titles."""
    roots = nodes.where("depth = 0").groupBy("doc_id").agg(pg.in_order("ord", "title", "; ").alias("titles"))
    return roots.select("doc_id", F.concat(F.lit("Covers: "), "titles", F.lit(".")).alias("doc_description"))

"""Pages, Markdown outlines and contents arithmetic. Docstrings name the inventory ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import markdown, pages, toc
from quire.plans.reasoner import RuleReasoner, contents_lines
from quire.queries.registry import query
from quire.sources import views as v
from quire.sources.views import with_views as sql

NL = "chr(10)"
COLLAPSE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
SQUASH = r"regexp_replace(lower({0}), '\s+', '', 'g')"
THIN, SUMMARY, CHUNK, LIMIT = 60, 40, 200, 6


@query(sql("page_list", body=" SELECT doc_id, page_no, text, n_tokens FROM pl"))
def page_list(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as numbered pages with token counts."""
    return v.page_list(spark, sf)


@query(sql("conv", body=" SELECT * FROM conv"))
def conv_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as pages."""
    return v.conv_pages(spark, sf)


@query(f"""SELECT page_id AS doc_id, cast(i AS INTEGER) AS page_no, b[i] AS text, cast(len({v.sql_words('b[i]')}) AS INTEGER) AS n_tokens
FROM (SELECT page_id, b, unnest(generate_series(1, len(b))) AS i FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array(html, '<p(?:\\s[^>]*)?>')[2:], lambda x: regexp_replace(split_part(x, '</p>', 1), '<[^>]*>', ' ', 'g')), lambda x: regexp_matches(x, '\\S')) AS b FROM pages))""")
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of web pages as pages (the text source that is at hand; PDF readers are optional)."""
    return v.html_blocks(spark, sf)


_TAGGED = "'<physical_index_' || page_no || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_no || '>' || chr(10)"


@query(sql("page_list", body=f" SELECT doc_id, page_no, {_TAGGED} AS one_gap, {_TAGGED} || chr(10) AS two_gaps FROM pl"))
def page_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Pages between their tags, in both spacings."""
    p = v.page_list(spark, sf)
    return p.select("doc_id", "page_no", pages.labelled(F.col("text"), F.col("page_no")).alias("one_gap"), pages.labelled(F.col("text"), F.col("page_no"), 2).alias("two_gaps"))


@query(sql("page_list", body=" SELECT doc_id, cast(count(*) AS BIGINT) AS n_pages, cast(sum(n_tokens) AS BIGINT) AS n_tokens FROM pl GROUP BY doc_id"))
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2, S3: pages and tokens of each document."""
    return v.page_list(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))


@query(sql("page_list", body=f" SELECT doc_id, string_agg('[p' || page_no || ']' || {NL} || {COLLAPSE.format('text')}, {NL} || {NL} ORDER BY page_no) AS context FROM pl WHERE {COLLAPSE.format('text')} <> '' GROUP BY doc_id"))
def full_context(spark: SparkSession, sf: str) -> DataFrame:
    """A document's pages as one labelled context."""
    return pages.full_context(v.page_list(spark, sf))


@query(sql("page_list", body=f""", c AS (SELECT doc_id, page_no, text, {COLLAPSE.format('text')} AS x FROM pl)
SELECT doc_id, page_no, CASE WHEN length(x) > 60 THEN rtrim(x[1:57]) || '...' ELSE x END AS excerpt, CASE WHEN length(text) > 40 THEN text[1:40] || '...' ELSE text END AS short FROM c"""))
def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts and display cuts."""
    return v.page_list(spark, sf).select("doc_id", "page_no", t.excerpt(F.col("text"), 60).alias("excerpt"), t.shorten(F.col("text")).alias("short"))


@query(sql("page_list", body=f""" SELECT doc_id, count(*) AS n_pages,
string_agg('<start_index_' || page_no || '>' || {NL} || text || {NL} || '<end_index_' || page_no || '>' || {NL}, '' ORDER BY page_no) AS text FROM pl WHERE page_no BETWEEN 2 AND 4 GROUP BY doc_id"""))
def page_range_text(spark: SparkSession, sf: str) -> DataFrame:
    """S3: pages 2 to 4 of every document between numbered tags."""
    return pages.page_range(v.page_list(spark, sf), 2, 4)


# Markdown.

_HEADS = r""", f AS (SELECT *, starts_with(trim(text), '```') AS fence, sum(CASE WHEN starts_with(trim(text), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_num) AS n FROM md),
 heads AS (SELECT doc_id, line_num, cast(length(regexp_extract(text, '^(#{1,6})', 1)) AS INTEGER) AS level, trim(regexp_extract(trim(text), '^#{1,6}\s+(.+)$', 1)) AS title
  FROM f WHERE NOT fence AND n % 2 = 0 AND regexp_matches(trim(text), '^#{1,6}\s+.+$') AND text LIKE '#%')"""
_SECS = f"""{_HEADS}, spans AS (SELECT *, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line_num) - 1 AS INTEGER) AS ord, lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num) AS stop FROM heads),
 secs0 AS (SELECT s.doc_id, ord, s.line_num, level, title, trim(string_agg(m.text, {NL} ORDER BY m.line_num), ' ' || chr(9) || chr(10) || chr(13)) AS text
  FROM spans s JOIN md m ON m.doc_id = s.doc_id AND m.line_num >= s.line_num AND (s.stop IS NULL OR m.line_num < s.stop) GROUP BY ALL),
 secs AS (SELECT *, cast(len({v.sql_words('text')}) AS INTEGER) AS n_tokens FROM secs0)"""
_MD = ("page_list", "toc", "md")
_ROLL = f"""{_SECS}, ends AS (SELECT a.doc_id, a.ord, min(b.ord) AS nxt FROM secs a LEFT JOIN secs b ON b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL),
 runs AS (SELECT s.*, cast(coalesce(e.nxt, (SELECT count(*) FROM secs c WHERE c.doc_id = s.doc_id)) AS INTEGER) AS run_end FROM secs s JOIN ends e USING (doc_id, ord)),
 rolled AS (SELECT r.doc_id, r.ord, r.line_num, r.level, r.title, r.text, r.n_tokens, r.run_end, cast(sum(c.n_tokens) AS BIGINT) AS subtree_tokens
  FROM runs r JOIN secs c ON c.doc_id = r.doc_id AND c.ord >= r.ord AND c.ord < r.run_end GROUP BY ALL)"""
_PARENT = """, par AS (SELECT a.doc_id, a.ord, max(b.ord) AS parent_ord FROM secs a LEFT JOIN secs b ON b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY ALL),
 up AS (SELECT doc_id, ord, parent_ord, 0 AS depth FROM par WHERE parent_ord IS NULL UNION ALL SELECT p.doc_id, p.ord, p.parent_ord, u.depth + 1 FROM par p JOIN up u ON u.doc_id = p.doc_id AND u.ord = p.parent_ord)"""
_PAD = "CASE WHEN length(cast({0} AS VARCHAR)) < 4 THEN lpad(cast({0} AS VARCHAR), 4, '0') ELSE cast({0} AS VARCHAR) END"


@query(sql(*_MD, body=f"{_HEADS} SELECT * FROM heads"))
def md_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings outside code fences."""
    return markdown.headings(v.md_lines(spark, sf))


@query(sql(*_MD, body=f"{_SECS} SELECT doc_id, ord, line_num, level, title, text, n_tokens FROM secs"))
def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Headings with the lines up to the next one."""
    return markdown.sections(v.md_lines(spark, sf))


@query(sql(*_MD, body=f"{_SECS}{_PARENT} SELECT doc_id, ord, cast(parent_ord AS INTEGER) AS parent_ord, cast(depth AS INTEGER) AS depth FROM up"))
def md_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents and depths from heading levels."""
    return markdown.with_parents(markdown.sections(v.md_lines(spark, sf))).select("doc_id", "ord", "parent_ord", "depth")


@query(sql(*_MD, body=f"""{_SECS}{_PARENT} SELECT doc_id, ord, {_PAD.format('ord')} AS node_id, cast(parent_ord AS INTEGER) AS parent_ord, cast(depth AS INTEGER) AS depth, level, title, line_num, text, n_tokens
 FROM secs JOIN up USING (doc_id, ord)"""))
def md_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The flat outline of every Markdown document."""
    return markdown.nodes(v.md_lines(spark, sf))


@query(sql(*_MD, body=f"{_ROLL} SELECT doc_id, ord, run_end, subtree_tokens FROM rolled"))
def md_subtree_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of whole subtrees."""
    return markdown.with_rollup(markdown.sections(v.md_lines(spark, sf))).select("doc_id", "ord", "run_end", "subtree_tokens")


@query(sql(*_MD, body=f"""{_ROLL}, gone AS (SELECT DISTINCT b.doc_id, b.ord FROM rolled a JOIN rolled b ON a.doc_id = b.doc_id AND a.ord < b.ord AND b.ord < a.run_end AND a.subtree_tokens < {THIN}),
 kept AS (SELECT r.* FROM rolled r ANTI JOIN gone USING (doc_id, ord)),
 merged AS (SELECT k.doc_id, k.ord, k.line_num, k.level, k.title, CASE WHEN k.subtree_tokens < {THIN} THEN string_agg(r.text, {NL} || {NL} ORDER BY r.ord) ELSE k.text END AS text
  FROM kept k JOIN rolled r ON r.doc_id = k.doc_id AND r.ord >= k.ord AND r.ord < CASE WHEN k.subtree_tokens < {THIN} THEN k.run_end ELSE k.ord + 1 END GROUP BY k.doc_id, k.ord, k.line_num, k.level, k.title, k.subtree_tokens, k.text)
 SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, line_num, level, title, text, cast(len({v.sql_words('text')}) AS INTEGER) AS n_tokens FROM merged"""))
def md_thinned(spark: SparkSession, sf: str) -> DataFrame:
    """Subtrees under 60 tokens folded into their top node."""
    return markdown.thinned(markdown.sections(v.md_lines(spark, sf)), THIN)


@query(sql(*_MD, body=f"""{_SECS}, s AS (SELECT *, {COLLAPSE.format('text')} AS x, coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY ord) > level, false) AS inner_node FROM secs),
 c AS (SELECT *, regexp_extract(x, '^((?:[^.!?]*[.!?]+(?:\\s|$)){{1,2}})', 1) AS two FROM s),
 d AS (SELECT *, CASE WHEN n_tokens < {SUMMARY} THEN text WHEN two <> '' THEN trim(two) ELSE x END AS said FROM c)
 SELECT doc_id, ord, CASE WHEN NOT inner_node THEN said END AS summary, CASE WHEN inner_node THEN said END AS prefix_summary FROM d"""))
def md_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of leaves and inner nodes; texts under 40 tokens are their own."""
    return markdown.summarised(markdown.nodes(v.md_lines(spark, sf)), SUMMARY).select("doc_id", "ord", "summary", "prefix_summary")


# Contents pages.


@query(sql("page_list", "toc", body=r""" SELECT doc_id, idx, regexp_replace(regexp_replace(title || repeat('.', 3 + idx % 5) || ' ' || repeat('. ', 3 + idx % 5) || physical_index, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS line FROM toc"""))
def toc_dot_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """Dot leaders of contents lines as colons."""
    dots = F.concat("title", F.expr("repeat('.', 3 + idx % 5)"), F.lit(" "), F.expr("repeat('. ', 3 + idx % 5)"), F.col("physical_index").cast("string"))
    return v.toc_items(spark, sf).select("doc_id", "idx", t.dot_leaders(dots).alias("line"))


@query(sql("page_list", "flags", body=f""", y AS (SELECT doc_id, min(page) AS first_yes FROM flags WHERE answer = 'yes' AND page < {LIMIT} GROUP BY doc_id),
 s AS (SELECT y.doc_id, first_yes, min(f.page) AS stop FROM y LEFT JOIN flags f ON f.doc_id = y.doc_id AND f.page > first_yes AND f.answer = 'no' GROUP BY ALL)
 SELECT f.doc_id, cast(f.page AS INTEGER) AS page FROM flags f JOIN s ON s.doc_id = f.doc_id WHERE f.answer = 'yes' AND f.page >= first_yes AND (stop IS NULL OR f.page < stop)"""))
def toc_islands(spark: SparkSession, sf: str) -> DataFrame:
    """The first run of contents pages within six pages."""
    return toc.islands(v.toc_flags(spark, sf), LIMIT)


@query(sql("page_list", "toc", body=""" SELECT doc_id, idx, physical_index AS from_tag, CASE WHEN idx % 2 = 0 THEN physical_index END AS from_mixed, page_num FROM toc"""))
def toc_physical_to_int(spark: SparkSession, sf: str) -> DataFrame:
    """page tags, other strings and printed pages as numbers."""
    mixed = F.when(F.col("idx") % 2 == 0, F.replace("physical_tag", F.lit("<"), F.lit(""))).otherwise(F.lit("page N/A"))
    printed = F.when(F.col("page_num").isNull(), F.lit("N/A")).otherwise(F.concat(F.lit(" "), F.col("page_num").cast("string")))
    return v.toc_items(spark, sf).select("doc_id", "idx", t.physical_index(F.col("physical_tag")).alias("from_tag"), t.physical_index(mixed).alias("from_mixed"), t.page_number(printed).alias("page_num"))


_PAIRS = """, pairs AS (SELECT f.doc_id, f.idx AS phy_idx, p.idx AS toc_idx, f.title, p.page_num, f.physical_index
 FROM toc f JOIN toc p ON p.doc_id = f.doc_id AND p.title IS NOT DISTINCT FROM f.title WHERE f.idx % 3 <> 1 AND f.physical_index >= 2)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    items = v.toc_items(spark, sf)
    return toc.page_pairs(items, items.where("idx % 3 <> 1"), 2)


@query(sql("page_list", "toc", body=f"{_PAIRS} SELECT * FROM pairs"))
def toc_page_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Printed and physical pages of equal titles."""
    return _pairs(spark, sf)


_OFFSET = f"""{_PAIRS}, d AS (SELECT doc_id, physical_index - page_num AS diff, count(*) AS n, min(phy_idx * 100000 + toc_idx) AS seen FROM pairs WHERE page_num IS NOT NULL GROUP BY ALL),
 off AS (SELECT doc_id, diff AS page_offset FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) = 1)"""


@query(sql("page_list", "toc", body=f"{_OFFSET} SELECT doc_id, cast(page_offset AS INTEGER) AS page_offset FROM off"))
def toc_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A1: the most frequent difference of physical and printed page, first seen wins ties."""
    return toc.page_offset(_pairs(spark, sf))


@query(sql("page_list", "toc", body=f"{_OFFSET} SELECT t.doc_id, idx, cast(CASE WHEN page_num IS NOT NULL THEN page_num + page_offset END AS INTEGER) AS physical_index FROM toc t LEFT JOIN off USING (doc_id)"))
def toc_apply_offset(spark: SparkSession, sf: str) -> DataFrame:
    """physical pages from printed ones."""
    items = v.toc_items(spark, sf).withColumn("physical_index", F.lit(None).cast("int"))
    return toc.apply_offset(items, toc.page_offset(_pairs(spark, sf))).select("doc_id", "idx", "physical_index")


@query(sql("page_list", "toc", body=""" , s AS (SELECT doc_id, max(page_no) AS n FROM pl GROUP BY doc_id)
 SELECT doc_id, idx, CASE WHEN physical_index * 2 - 3 BETWEEN 1 AND n THEN cast(physical_index * 2 - 3 AS INTEGER) END AS physical_index FROM toc JOIN s USING (doc_id)"""))
def toc_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Physical pages outside the document become null."""
    items = v.toc_items(spark, sf).withColumn("physical_index", F.col("physical_index") * 2 - 3)
    sizes = v.page_list(spark, sf).groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    return toc.within_pages(items, sizes).select("doc_id", "idx", "physical_index")


@query(sql("page_list", "toc", body=""", k AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN physical_index END AS known FROM toc)
 SELECT a.doc_id, a.idx, coalesce((SELECT arg_max(b.known, b.idx) FROM k b WHERE b.doc_id = a.doc_id AND b.idx < a.idx AND b.known IS NOT NULL), 0) AS prev_page,
  coalesce((SELECT arg_min(b.known, b.idx) FROM k b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.known IS NOT NULL), -1) AS next_page FROM k a"""))
def toc_prev_next_span(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest known pages on both sides."""
    prev, next_ = toc.neighbours(F.when(F.col("idx") % 3 == 0, F.col("physical_index")), F.lit(0), F.lit(-1))
    return v.toc_items(spark, sf).select("doc_id", "idx", prev.alias("prev_page"), next_.alias("next_page"))


_LATE = " , late AS (SELECT * FROM toc WHERE doc_id % 3 > 0 OR idx > 0)"


@query(sql("page_list", "toc", body=f"""{_LATE}, h AS (SELECT doc_id, -1 AS idx, '0' AS structure, 'Preface' AS title, 1 AS physical_index FROM late QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1 AND physical_index > 1),
 u AS (SELECT * FROM h UNION ALL SELECT doc_id, idx, structure, title, physical_index FROM late)
 SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, structure, title, physical_index FROM u"""))
def toc_preface(spark: SparkSession, sf: str) -> DataFrame:
    """A preface where the first item begins after page 1."""
    late = v.toc_items(spark, sf).where("doc_id % 3 > 0 OR idx > 0")
    return toc.with_preface(late.select("doc_id", "idx", "structure", "title", "physical_index"))


_RANGES = """, ends AS (SELECT doc_id, max(page_no) AS last_page FROM pl GROUP BY doc_id),
 ranges AS (SELECT a.doc_id, a.idx, a.structure, a.title, a.physical_index AS start_index,
   cast(CASE WHEN b.idx IS NULL THEN last_page WHEN b.appear_start THEN b.physical_index - 1 ELSE b.physical_index END AS INTEGER) AS end_index
   FROM toc a JOIN ends USING (doc_id) LEFT JOIN toc b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1)"""


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the example tables with page ranges."""
    ends = v.page_list(spark, sf).groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    return toc.page_ranges(v.toc_items(spark, sf), ends).select("doc_id", "idx", "structure", "title", "start_index", "end_index")


@query(sql("page_list", "toc", body=f"{_RANGES} SELECT doc_id, idx, start_index, end_index FROM ranges"))
def toc_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end pages of items."""
    return ranges(spark, sf).select("doc_id", "idx", "start_index", "end_index")


# Chunks.


def chunk_sql(tokens: int, overlap: int = 1) -> str:
    """The fold over pages as a recursive query: one step for each page."""
    return sql("page_list", body=f""", tot AS (SELECT doc_id, sum(n_tokens) AS total, max(page_no) AS n FROM pl GROUP BY doc_id),
 aim AS (SELECT *, CASE WHEN total <= {tokens} THEN total ELSE ceil((total / ceil(total / {tokens}) + {tokens}) / 2) END AS aim FROM tot),
 step AS (SELECT doc_id, 0 AS i, 0 AS lo, 0::BIGINT AS c, -1 AS closed_lo, -1 AS closed_hi, 0 AS done FROM aim
  UNION ALL SELECT s.doc_id, s.i + 1, CASE WHEN s.c + p.n_tokens > a.aim THEN greatest(s.i - {overlap}, 0) ELSE s.lo END,
   cast(CASE WHEN s.c + p.n_tokens > a.aim THEN coalesce(q.n_tokens, 0) + p.n_tokens ELSE s.c + p.n_tokens END AS BIGINT),
   CASE WHEN s.c + p.n_tokens > a.aim THEN s.lo ELSE -1 END, CASE WHEN s.c + p.n_tokens > a.aim THEN s.i - 1 ELSE -1 END, CASE WHEN s.c + p.n_tokens > a.aim THEN 1 ELSE 0 END
  FROM step s JOIN aim a USING (doc_id) JOIN pl p ON p.doc_id = s.doc_id AND p.page_no = s.i + 1 LEFT JOIN pl q ON q.doc_id = s.doc_id AND q.page_no = s.i),
 spans AS (SELECT doc_id, closed_lo AS lo, closed_hi AS hi, i FROM step WHERE done = 1
  UNION ALL SELECT s.doc_id, s.lo, a.n - 1, 1000000 FROM step s JOIN aim a ON a.doc_id = s.doc_id AND s.i = a.n)
 SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, lo + 1 AS first_page, cast(hi + 1 AS INTEGER) AS last_page,
  cast(coalesce((SELECT sum(n_tokens) FROM pl p WHERE p.doc_id = spans.doc_id AND p.page_no BETWEEN lo + 1 AND hi + 1), 0) AS BIGINT) AS n_tokens FROM spans""")


@query(chunk_sql(CHUNK))
def chunk_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of about 200 tokens that share a page."""
    return pages.chunk_spans(v.page_list(spark, sf), CHUNK)


@query(chunk_sql(40))
def chunk_small_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A budget that single pages exceed, so first chunks can be empty."""
    return pages.chunk_spans(v.page_list(spark, sf), 40)


# Rules in place of judgement.

RULES = RuleReasoner()


@query(sql("page_list", "toc", body=f""" SELECT t.doc_id, t.idx, p.page_no, contains({SQUASH.format('p.text')}, {SQUASH.format('t.title')}) AND title <> '' AS on_page, starts_with({SQUASH.format('p.text')}, {SQUASH.format('t.title')}) AND title <> '' AS starts_page
 FROM toc t JOIN pl p ON p.doc_id = t.doc_id AND p.page_no BETWEEN t.physical_index - 1 AND t.physical_index + 1"""))
def title_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Titles on their page and its neighbours."""
    near = v.toc_items(spark, sf).select("doc_id", "idx", "title", F.explode(F.sequence(F.col("physical_index") - 1, F.col("physical_index") + 1)).alias("page_no"))
    rows = near.join(v.page_list(spark, sf).select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    return rows.select("doc_id", "idx", "page_no", RULES.on_page(F.col("title"), F.col("text")).alias("on_page"), RULES.starts_page(F.col("title"), F.col("text")).alias("starts_page"))


@query(sql("page_list", "toc", body=r""", l AS (SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN structure || ' ' || title || ' ........ ' || physical_index ELSE title END AS line, structure, title, physical_index FROM toc),
 g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS contents, count(*) FILTER (WHERE idx % 2 = 0) AS numbered, count(*) AS n FROM l GROUP BY doc_id)
 SELECT doc_id, CASE WHEN numbered >= 3 THEN 'yes' ELSE 'no' END AS lists_contents, CASE WHEN 2 * len(list_filter(string_split(contents, chr(10)), lambda x: regexp_matches(x, '\d+\s*$'))) >= len(list_filter(string_split(contents, chr(10)), lambda x: trim(x) <> '')) THEN 'yes' ELSE 'no' END AS has_page_numbers FROM g"""))
def toc_page_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page lists contents and has page numbers."""
    line = F.when(F.col("idx") % 2 == 0, F.concat("structure", F.lit(" "), "title", F.lit(" ........ "), F.col("physical_index").cast("string"))).otherwise(F.col("title"))
    g = v.toc_items(spark, sf).withColumn("line", line).groupBy("doc_id").agg(pages.in_order("idx", "line", "\n").alias("contents"))
    return g.select("doc_id", RULES.lists_contents(F.col("contents")).alias("lists_contents"), RULES.has_page_numbers(F.col("contents")).alias("has_page_numbers"))


@query(sql("page_list", "toc", body=r""", w AS (SELECT * FROM toc WHERE regexp_matches(title, '^[A-Z][a-z]+( [a-z]+){1,4}$'))
 SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS pos, structure, title, cast(physical_index AS VARCHAR) AS page_raw FROM w"""))
def toc_line_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Contents lines as items."""
    plain = v.toc_items(spark, sf).where(F.col("title").rlike(r"^[A-Z][a-z]+( [a-z]+){1,4}$"))
    line = F.concat("structure", F.lit(" "), "title", F.lit(" ........ "), F.col("physical_index").cast("string"))
    g = plain.withColumn("line", line).groupBy("doc_id").agg(pages.in_order("idx", "line", "\n").alias("contents"))
    return g.select("doc_id", F.posexplode(contents_lines(F.col("contents"))).alias("pos", "x")).select("doc_id", "pos", "x.*")

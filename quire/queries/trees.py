"""Trees from dotted paths, and index builds."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pages, toc, tree
from quire.plans import build
from quire.plans.model import ModelReasoner
from quire.plans.options import Options
from quire.plans.reasoner import RuleReasoner
from quire.queries.outline import _PAD, _RANGES, COLLAPSE, NL, SQUASH, ranges
from quire.queries.registry import query
from quire.sources import views as v
from quire.sources.views import with_views

# Items with duplicate paths, children before their parents, and missing paths.
_ITEMS = f"""{_RANGES}, it AS (SELECT doc_id, idx, CASE WHEN idx % 11 = 10 THEN NULL WHEN idx % 7 = 5 THEN '1' WHEN idx % 9 = 8 THEN structure || '.1.2' ELSE structure END AS structure, title, start_index, end_index FROM ranges)"""
_UP = """, cand AS (SELECT doc_id, idx, structure, title, start_index, end_index, CASE WHEN structure LIKE '%.%' THEN regexp_replace(structure, '\\.[^.]*$', '') END AS up FROM it),
 par AS (SELECT c.doc_id, c.idx, c.structure, c.title, c.start_index, c.end_index, max(p.idx) AS parent_idx FROM cand c LEFT JOIN it p ON p.doc_id = c.doc_id AND p.structure = c.up AND p.idx < c.idx GROUP BY ALL)"""
_WALK = f""", walk AS (SELECT doc_id, idx, parent_idx, 0 AS depth, [idx] AS path FROM par WHERE parent_idx IS NULL UNION ALL SELECT p.doc_id, p.idx, p.parent_idx, w.depth + 1, list_append(w.path, p.idx) FROM par p JOIN walk w ON w.doc_id = p.doc_id AND w.idx = p.parent_idx),
 tree AS (SELECT p.*, w.depth, cast(row_number() OVER (PARTITION BY p.doc_id ORDER BY w.path) - 1 AS INTEGER) AS ord FROM par p JOIN walk w USING (doc_id, idx)),
 nodes AS (SELECT *, {_PAD.format('ord')} AS node_id FROM tree)"""
_VIEWS = ("page_list", "toc")
_TREE = f"{_ITEMS}{_UP}{_WALK}"


def sql(body: str) -> str:
    return with_views(*_VIEWS, body=body)


def items(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("structure")
    odd = F.when(F.col("idx") % 11 == 10, F.lit(None)).when(F.col("idx") % 7 == 5, "1").when(F.col("idx") % 9 == 8, F.concat(s, F.lit(".1.2"))).otherwise(s)
    return ranges(spark, sf).withColumn("structure", odd)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes in pre-order, with parents and ids."""
    return tree.with_order(tree.with_parents(items(spark, sf)))


@query(sql(f"{_ITEMS}{_UP} SELECT doc_id, idx, structure, cast(parent_idx AS INTEGER) AS parent_idx FROM par"))
def tree_path_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents by dotted path, the latest earlier item winning."""
    return tree.with_parents(items(spark, sf)).select("doc_id", "idx", "structure", "parent_idx")


@query(sql(f"{_TREE} SELECT doc_id, idx, cast(depth AS INTEGER) AS depth, ord, node_id FROM nodes"))
def tree_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Depth, pre-order place and padded id."""
    return nodes(spark, sf).select("doc_id", "idx", "depth", "ord", "node_id")


@query(sql(f"{_TREE} SELECT n.doc_id, n.node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_idx = n.idx)"))
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """T5: nodes without children."""
    return tree.leaves(nodes(spark, sf)).select("doc_id", "node_id")


@query(sql(f"{_TREE} SELECT d.doc_id, i.node_id, coalesce(bool_or(n.node_id IS NOT NULL AND c.idx IS NULL), false) AS is_leaf FROM (SELECT DISTINCT doc_id FROM it) d CROSS JOIN (VALUES ('0000'), ('0003'), ('9999')) i(node_id) LEFT JOIN nodes n ON n.doc_id = d.doc_id AND n.node_id = i.node_id LEFT JOIN nodes c ON c.doc_id = d.doc_id AND c.parent_idx = n.idx GROUP BY ALL"))
def tree_is_leaf(spark: SparkSession, sf: str) -> DataFrame:
    """Whether given ids are leaves; unknown ones are not."""
    n = nodes(spark, sf)
    asked = n.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("0000", "0003", "9999")))).alias("node_id"))
    return tree.is_leaf(n, asked)


@query(sql(f"{_TREE} SELECT doc_id, arg_max(node_id, ord) AS node_id, arg_max(title, ord) AS title FROM nodes WHERE depth = 0 GROUP BY doc_id"))
def tree_last_root(spark: SparkSession, sf: str) -> DataFrame:
    """The last top-level node."""
    return tree.last_root(nodes(spark, sf))


@query(sql(f"{_TREE} SELECT doc_id, string_agg(repeat('  ', depth) || '[' || node_id || '] ' || title || ' (p' || start_index || '-' || end_index || ')', {NL} ORDER BY ord) AS tree FROM nodes GROUP BY doc_id"))
def tree_render(spark: SparkSession, sf: str) -> DataFrame:
    """The outline as indented lines with ids and page ranges."""
    return tree.rendered(nodes(spark, sf))


_TEXTS = f"""{_TREE}, txt AS (SELECT n.doc_id, n.idx, n.ord, n.node_id, n.depth, n.parent_idx, n.title, n.start_index, n.end_index, coalesce(string_agg(p.text, '' ORDER BY p.page_no), '') AS text, cast(coalesce(sum(p.n_tokens), 0) AS INTEGER) AS n_tokens
 FROM nodes n LEFT JOIN pl p ON p.doc_id = n.doc_id AND p.page_no BETWEEN n.start_index AND n.end_index GROUP BY ALL)"""


def text_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return pages.with_text(nodes(spark, sf), v.page_list(spark, sf))


@query(sql(f"{_TEXTS}, s AS (SELECT *, {COLLAPSE.format('text')} AS x FROM txt), e AS (SELECT *, CASE WHEN length(x) > 220 THEN rtrim(x[1:217]) || '...' ELSE x END AS e FROM s), "
           f"f AS (SELECT *, CASE WHEN length(e) > 180 THEN rtrim(e[1:177]) || '...' ELSE e END AS about FROM e) "
           f"SELECT doc_id, string_agg(repeat('  ', depth) || '[' || node_id || '] ' || title || ' (p' || start_index || '-' || end_index || ')' || CASE WHEN about <> '' THEN {NL} || repeat('  ', depth) || '  - ' || about ELSE '' END, {NL} ORDER BY ord) AS tree FROM f GROUP BY doc_id"))
def tree_render_text(spark: SparkSession, sf: str) -> DataFrame:
    """The outline with excerpts of the nodes' texts."""
    return tree.rendered(text_nodes(spark, sf))


@query(sql(f"{_TREE}, g AS (SELECT *, repeat(title || ' ', 8) AS summary FROM nodes) SELECT doc_id, string_agg(repeat('  ', depth) || '[' || node_id || '] ' || title || ' (p' || start_index || '–' || end_index || ')' || {NL} || repeat('  ', depth) || '     └ ' || CASE WHEN length(summary) > 120 THEN summary[1:120] || '…' ELSE summary END, {NL} ORDER BY ord) AS tree FROM g GROUP BY doc_id"))
def tree_render_glyph(spark: SparkSession, sf: str) -> DataFrame:
    """The outline with glyphs and cut summaries."""
    return tree.rendered(nodes(spark, sf).withColumn("summary", F.expr("repeat(title || ' ', 8)")), "glyph")


@query(sql(f"{_TREE} SELECT doc_id, string_agg(repeat('  ', depth) || title, {NL} ORDER BY ord) AS tree FROM nodes GROUP BY doc_id"))
def tree_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles by depth."""
    return tree.rendered(nodes(spark, sf), "titles")


@query(sql(f"{_TEXTS} SELECT doc_id, node_id, text, n_tokens FROM txt"))
def tree_node_text(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of each node's range joined."""
    return text_nodes(spark, sf).select("doc_id", "node_id", "text", "n_tokens")


@query(sql(f"{_TEXTS} SELECT doc_id, node_id, start_index, end_index, n_tokens FROM txt WHERE end_index - start_index > 1 AND n_tokens >= 150"))
def tree_large_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """T13's test: nodes over a page and over a token limit."""
    return tree.large_nodes(text_nodes(spark, sf), 1, 150).select("doc_id", "node_id", "start_index", "end_index", "n_tokens")


@query(sql(f"{_TEXTS} SELECT doc_id, node_id, n_tokens FROM txt WHERE n_tokens > 400"))
def token_limit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes over a token limit."""
    return tree.over_limit(text_nodes(spark, sf), 400).select("doc_id", "node_id", "n_tokens")


@query(sql(f"{_TREE} SELECT title, node_id, start_index FROM nodes"))
def node_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Columns dropped, then kept in a given order where they exist."""
    return tree.projected(tree.without(nodes(spark, sf), "text", "end_index"), "title", "node_id", "summary", "start_index", "end_index")


@query(sql(f"{_TREE}, reach AS (SELECT doc_id, idx AS top, idx, end_index FROM nodes UNION ALL SELECT r.doc_id, r.top, n.idx, n.end_index FROM reach r JOIN nodes n ON n.doc_id = r.doc_id AND n.parent_idx = r.idx) SELECT doc_id, top AS idx, max(end_index) AS subtree_end_index FROM reach GROUP BY ALL"))
def tree_subtree_end(spark: SparkSession, sf: str) -> DataFrame:
    """The last page of a node or anything below it."""
    return tree.subtree_end(nodes(spark, sf)).select("doc_id", "idx", "subtree_end_index")


# Verification and repair, on items whose places are partly wrong.

_WRONG = ", w AS (SELECT doc_id, idx, structure, title, page_num, cast(CASE WHEN idx % 4 = 1 THEN physical_index + 2 ELSE physical_index END AS INTEGER) AS physical_index FROM toc), sz AS (SELECT doc_id, max(page_no) AS n FROM pl GROUP BY doc_id), b AS (SELECT w.*, n FROM w JOIN sz USING (doc_id))"
_CHECK = f"""{_WRONG}, bb AS (SELECT doc_id, idx, title, n, CASE WHEN physical_index <= n THEN physical_index END AS p FROM b),
 ck AS (SELECT bb.*, CASE WHEN p IS NOT NULL THEN contains({SQUASH.format('pl.text')}, {SQUASH.format('bb.title')}) AND bb.title <> '' END AS correct FROM bb LEFT JOIN pl ON pl.doc_id = bb.doc_id AND pl.page_no = bb.p),
 md2 AS (SELECT doc_id, arg_max(p, idx) >= any_value(n) / 2 AS reaches_middle, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE correct IS NOT NULL) AS a FROM ck GROUP BY doc_id)"""
RULES = RuleReasoner()


def checked(spark: SparkSession, sf: str) -> DataFrame:
    p = v.page_list(spark, sf)
    wrong = F.when(F.col("idx") % 4 == 1, F.col("physical_index") + 2).otherwise(F.col("physical_index"))
    its = v.toc_items(spark, sf).select("doc_id", "idx", "structure", "title", "page_num", wrong.alias("physical_index"))
    return build.verified(toc.within_pages(its, build.sizes(p)), p, RULES)


@query(sql(f"{_CHECK} SELECT doc_id, idx, correct, reaches_middle, round_even(CASE WHEN reaches_middle THEN coalesce(a, 0) ELSE 0 END, 6) AS accuracy FROM ck JOIN md2 USING (doc_id)"))
def verify_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Items checked against their pages, and the share that holds."""
    return checked(spark, sf).select("doc_id", "idx", "correct", "reaches_middle", F.bround("accuracy", 6).alias("accuracy"))


@query(sql(f"""{_CHECK}, span AS (SELECT a.doc_id, a.idx, a.title, a.n, a.p, a.correct,
  coalesce((SELECT arg_max(x.p, x.idx) FROM ck x WHERE x.doc_id = a.doc_id AND x.idx < a.idx AND x.correct), 0) AS lo, coalesce((SELECT arg_min(x.p, x.idx) FROM ck x WHERE x.doc_id = a.doc_id AND x.idx > a.idx AND x.correct), a.n) AS hi FROM ck a),
 hit AS (SELECT s.doc_id, s.idx, min(pl.page_no) AS found FROM span s JOIN pl ON pl.doc_id = s.doc_id AND pl.page_no BETWEEN s.lo AND s.hi WHERE NOT s.correct AND contains({SQUASH.format('pl.text')}, {SQUASH.format('s.title')}) AND s.title <> '' GROUP BY ALL)
 SELECT s.doc_id, s.idx, CASE WHEN NOT coalesce(correct, true) AND found IS NOT NULL THEN found ELSE p END AS physical_index, CASE WHEN found IS NOT NULL THEN true ELSE correct END AS correct FROM span s LEFT JOIN hit USING (doc_id, idx)"""))
def fix_incorrect(spark: SparkSession, sf: str) -> DataFrame:
    """Wrong items looked for between their right neighbours."""
    return build.fixed(checked(spark, sf), v.page_list(spark, sf), RULES).select("doc_id", "idx", "physical_index", "correct")


@query(sql(f""", asked AS (SELECT doc_id, idx, title FROM toc), s AS (SELECT doc_id, max(page_no) AS n FROM pl GROUP BY doc_id)
 SELECT a.doc_id, a.idx, min(pl.page_no) AS physical_index FROM asked a LEFT JOIN pl ON pl.doc_id = a.doc_id AND contains({SQUASH.format('pl.text')}, {SQUASH.format('a.title')}) AND a.title <> '' GROUP BY ALL"""))
def locate_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Items without printed pages, on the first page with their title."""
    return build.with_contents(v.toc_items(spark, sf), v.page_list(spark, sf), RULES).select("doc_id", "idx", "physical_index")


def index_sql(words: int, inner_words: int, max_pages: int, max_tokens: int, columns: str) -> str:
    """An index by headings: a preface, ranges, and the headings of oversized nodes below them.

    Headings found inside a node end its children, so these hold none of their own and one level is all.
    """
    strip = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    return sql(rf""", hd AS (SELECT doc_id, page_no, text, n_tokens, {COLLAPSE.format(f"regexp_extract({strip}, '^([^.!?]{{3,80}})', 1)")} AS h FROM pl),
 hw AS (SELECT *, len({v.sql_words('h')}) AS w FROM hd WHERE h <> ''),
 i0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS nth, h AS title, page_no AS p, text FROM hw WHERE w <= {words}),
 i1 AS (SELECT doc_id, nth, cast(nth AS VARCHAR) AS structure, title, p, text, 'no_contents' AS mode FROM i0 UNION ALL SELECT doc_id, 0, '0', 'Preface', 1, NULL, NULL FROM i0 WHERE nth = 1 AND p > 1),
 i2 AS (SELECT i1.*, coalesce(starts_with({SQUASH.format('coalesce(i1.text, pl.text)')}, {SQUASH.format('title')}), false) AS top FROM i1 JOIN pl ON pl.doc_id = i1.doc_id AND pl.page_no = i1.p),
 ends AS (SELECT doc_id, max(page_no) AS last_page FROM pl GROUP BY doc_id),
 i3 AS (SELECT doc_id, nth, structure, title, p AS s, mode, CASE WHEN lead(p) OVER w IS NULL THEN last_page WHEN lead(top) OVER w THEN lead(p) OVER w - 1 ELSE lead(p) OVER w END AS e FROM i2 JOIN ends USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
 sized AS (SELECT i3.doc_id, nth, structure, title, s, e, mode, coalesce(sum(n_tokens), 0) AS n FROM i3 LEFT JOIN pl ON pl.doc_id = i3.doc_id AND pl.page_no BETWEEN s AND e GROUP BY ALL),
 k0 AS (SELECT b.doc_id, b.nth, b.structure AS up, b.title AS own, b.e, h AS title, page_no AS p, row_number() OVER (PARTITION BY b.doc_id, b.nth ORDER BY page_no) AS r FROM sized b JOIN hw ON hw.doc_id = b.doc_id AND hw.page_no BETWEEN s AND e AND hw.w <= {inner_words} WHERE e - s > {max_pages} AND n >= {max_tokens}),
 k1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, nth ORDER BY p) AS k FROM k0 WHERE NOT (r = 1 AND trim(title) = trim(own))),
 k2 AS (SELECT doc_id, nth, k, up || '.' || k AS structure, title, p AS s, coalesce(lead(p) OVER (PARTITION BY doc_id, nth ORDER BY p) - 1, e) AS e FROM k1),
 small AS (SELECT doc_id, nth, min(s) AS first FROM k2 GROUP BY ALL),
 flat AS (SELECT doc_id, nth, 0 AS k, structure, title, s, coalesce(first, e) AS e, mode FROM i3 LEFT JOIN small USING (doc_id, nth) UNION ALL SELECT doc_id, nth, k, structure, title, s, e, NULL FROM k2),
 placed AS (SELECT *, cast(row_number() OVER (PARTITION BY doc_id ORDER BY nth, k) - 1 AS INTEGER) AS ord, cast(CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS depth FROM flat),
 full_nodes AS (SELECT c.doc_id, c.ord, {_PAD.format('c.ord')} AS node_id, u.ord AS parent_ord, c.depth, c.structure, c.title, cast(c.s AS INTEGER) AS start_index, cast(c.e AS INTEGER) AS end_index, c.mode FROM placed c LEFT JOIN placed u ON u.doc_id = c.doc_id AND u.nth = c.nth AND u.k = 0 AND c.k > 0),
 filled AS (SELECT f.*, coalesce(string_agg(pl.text, '' ORDER BY page_no), '') AS text, cast(coalesce(sum(n_tokens), 0) AS INTEGER) AS n_tokens FROM full_nodes f LEFT JOIN pl ON pl.doc_id = f.doc_id AND pl.page_no BETWEEN start_index AND end_index GROUP BY ALL),
 summed AS (SELECT *, {COLLAPSE.format('text')} AS x, trim(regexp_extract({COLLAPSE.format('text')}, '^((?:[^.!?]*[.!?]+(?:\s|$)){{1,2}})', 1)) AS lead_in FROM filled)
 SELECT {columns} FROM summed""")


_NODE = "doc_id, ord, node_id, parent_ord, depth, structure, title, start_index, end_index, n_tokens"


@query(index_sql(8, 8, 10, 20_000, f"{_NODE}, CASE WHEN n_tokens < 200 THEN text WHEN lead_in <> '' THEN lead_in ELSE x END AS summary, mode"))
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """The outline index of every document from its pages."""
    return build.index_documents(v.page_list(spark, sf))


def rule_client():
    """A client that answers as the rules do, in one of several shapes of reply."""
    few = re.compile(r"[^.!?]{3,80}")
    squash = lambda x: "".join((x or "").lower().split())

    def client(prompt: str) -> tuple[str, str, dict]:
        x = json.loads(prompt.rsplit("\n", 1)[1])
        if x["task"] == "summary":
            text = " ".join(x["text"].split())
            lead = re.match(r"((?:[^.!?]*[.!?]+(?:\s|$)){1,2})", text)
            return lead[1].strip() if lead and lead[1] else text, "stop", {}
        if x["task"] == "heading":
            m = few.match(x["page"].strip().split("\n")[0])
            title = " ".join(m[0].split()) if m else ""
            answer = title if title and len(title.split()) <= 8 else None
        else:
            title, page = squash(x.get("title")), squash(x.get("page"))
            ok = {"on_page": title in page, "starts_page": page.startswith(title)}.get(x["task"], False)
            answer = "yes" if ok and title else "no"
        body = json.dumps({"answer": answer})
        return (f"Here:\n```json\n{body}\n```" if len(body) % 2 else body), "stop", {}

    return client


@query(index_sql(8, 8, 10, 20_000, f"{_NODE}, CASE WHEN n_tokens < 200 THEN text WHEN lead_in <> '' THEN lead_in ELSE x END AS summary, mode"))
def index_build_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """The index with every judgement asked of a model client (here one that follows the rules)."""
    return build.index_documents(v.page_list(spark, sf), Options(), ModelReasoner(rule_client))


@query(index_sql(3, 12, 3, 150, f"{_NODE}, mode"))
def split_large_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """An index of few headings whose oversized nodes were indexed again with more."""
    o = Options.of(max_pages_per_node=3, max_tokens_per_node=150, add_node_summary=False)
    return build.index_documents(v.page_list(spark, sf), o, RuleReasoner(heading_words=3), RuleReasoner(heading_words=12))


_HAS = "contains({0}, {1})".format(SQUASH.format("pg.text"), SQUASH.format("i.title"))
_FIX = """, span{n} AS (SELECT a.*, coalesce((SELECT arg_max(x.phys, x.idx) FROM fix{m} x WHERE x.doc_id = a.doc_id AND x.idx < a.idx AND x.correct), 0) AS lo,
  coalesce((SELECT arg_min(x.phys, x.idx) FROM fix{m} x WHERE x.doc_id = a.doc_id AND x.idx > a.idx AND x.correct), a.n_pages) AS hi FROM fix{m} a),
 hit{n} AS (SELECT i.doc_id, i.idx, min(pg.page_no) AS found FROM span{n} i JOIN pg ON pg.doc_id = i.doc_id AND pg.page_no BETWEEN i.lo AND i.hi AND {has} WHERE NOT i.correct GROUP BY ALL),
 fix{n} AS (SELECT s.doc_id, s.idx, structure, title, page_num, coalesce(found, phys) AS phys, correct OR found IS NOT NULL AS correct, n_pages FROM span{n} s LEFT JOIN hit{n} h ON h.doc_id = s.doc_id AND h.idx = s.idx)"""
#: Contents whose items all stand on the contents page itself end before the middle, so the second mode accepts none here.
_CASCADE = sql(rf""", pt AS (SELECT doc_id, structure, title, physical_index AS page_num, cast(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx FROM toc WHERE regexp_matches(title, '^[A-Z][a-z]+( [a-z]+){{1,4}}$')),
 fr AS (SELECT doc_id, string_agg(structure || ' ' || title || ' ........ ' || page_num, {NL} ORDER BY idx) AS text, count(*) AS n FROM pt GROUP BY doc_id),
 pg AS (SELECT doc_id, 1 AS page_no, text FROM fr UNION ALL SELECT p.doc_id, p.page_no + CASE WHEN fr.n IS NULL THEN 0 ELSE 1 END, p.text FROM pl p LEFT JOIN fr USING (doc_id)),
 np AS (SELECT doc_id, max(page_no) AS n_pages FROM pg GROUP BY doc_id),
 parsed AS (SELECT pt.* FROM pt JOIN fr USING (doc_id) WHERE fr.n >= 3),
 m1 AS (SELECT i.doc_id, i.idx, i.title, min(pg.page_no) AS found FROM parsed i JOIN pg ON pg.doc_id = i.doc_id AND pg.page_no BETWEEN 2 AND 21 AND {_HAS} GROUP BY ALL),
 df AS (SELECT m.doc_id, found - page_num AS diff, count(*) AS n, min(m.idx * 1000000 + p.idx) AS seen FROM m1 m JOIN parsed p ON p.doc_id = m.doc_id AND p.title = m.title GROUP BY ALL),
 off AS (SELECT doc_id, diff FROM df QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) = 1),
 mv AS (SELECT p.*, CASE WHEN page_num + diff BETWEEN 1 AND n_pages THEN page_num + diff END AS phys, n_pages FROM parsed p JOIN off USING (doc_id) JOIN np USING (doc_id)),
 ck2 AS (SELECT i.doc_id, i.idx, structure, title, page_num, phys, n_pages, CASE WHEN phys IS NOT NULL THEN {_HAS} END AS correct FROM mv i LEFT JOIN pg ON pg.doc_id = i.doc_id AND pg.page_no = i.phys),
 st AS (SELECT doc_id, CASE WHEN coalesce(arg_max(phys, idx) >= any_value(n_pages) / 2, false) THEN coalesce(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE correct IS NOT NULL), 0) ELSE 0 END AS accuracy, coalesce(bool_or(NOT correct), false) AS wrong FROM ck2 GROUP BY doc_id),
 fix0 AS (SELECT c.doc_id, idx, structure, title, page_num, phys, correct, n_pages FROM ck2 c JOIN st USING (doc_id) WHERE NOT (accuracy = 1 AND NOT wrong) AND accuracy > 0.6)
 {"".join(_FIX.format(n=k + 1, m=k, has=_HAS) for k in range(3))},
 one AS (SELECT doc_id, idx, structure, title, page_num, phys FROM ck2 JOIN st USING (doc_id) WHERE accuracy = 1 AND NOT wrong UNION ALL SELECT doc_id, idx, structure, title, page_num, phys FROM fix3),
 hd AS (SELECT doc_id, page_no, {COLLAPSE.format("regexp_extract(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^([^.!?]{3,80})', 1)")} AS h FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM one)),
 three AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS n, h, page_no FROM hd WHERE h <> '' AND len({v.sql_words('h')}) <= 8)
 SELECT doc_id, idx, structure, title, cast(page_num AS INTEGER) AS page_num, cast(phys AS INTEGER) AS physical_index, 'with_page_numbers' AS mode FROM one WHERE phys IS NOT NULL
 UNION ALL SELECT doc_id, cast(n - 1 AS INTEGER), cast(n AS VARCHAR), h, NULL, cast(page_no AS INTEGER), 'no_contents' FROM three""")


@query(_CASCADE)
def mode_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, those with plain titles behind a contents page, through all modes."""
    its = v.toc_items(spark, sf).where(F.col("title").rlike(r"^[A-Z][a-z]+( [a-z]+){1,4}$"))
    line = F.concat("structure", F.lit(" "), "title", F.lit(" ........ "), F.col("physical_index").cast("string"))
    front = its.withColumn("line", line).groupBy("doc_id").agg(pages.in_order("idx", "line", "\n").alias("text")).select("doc_id", F.lit(1).alias("page_no"), "text", F.lit(10).alias("n_tokens"))
    moved = F.when(F.col("front"), F.col("page_no") + 1).otherwise(F.col("page_no"))
    body = v.page_list(spark, sf).join(front.select("doc_id", F.lit(True).alias("front")), "doc_id", "left").withColumn("page_no", moved).drop("front")
    return build.cascade(front.unionByName(body), RULES, Options())

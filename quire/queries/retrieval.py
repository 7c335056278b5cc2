"""Searching outlines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pages, search, tree
from quire.plans.build import cut
from quire.queries import trees
from quire.queries.outline import COLLAPSE, NL
from quire.queries.registry import query
from quire.queries.trees import _TEXTS, sql
from quire.sources import views as v
from quire.sources.views import sql_words

_QW = f", qw AS (SELECT DISTINCT item_id AS query_id, unnest({sql_words('lower(text)')}) AS word FROM benchmark)"
_SCORES = f"""{_TEXTS}{_QW}, nw AS (SELECT DISTINCT doc_id, ord, node_id, unnest({sql_words("lower(title || ' ' || text)")}) AS word FROM txt),
 inner_nodes AS (SELECT DISTINCT p.doc_id, p.ord FROM txt p JOIN txt c ON c.doc_id = p.doc_id AND c.parent_idx = p.idx),
 sc AS (SELECT query_id, doc_id, ord, node_id, count(*) * CASE WHEN i.ord IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM nw JOIN qw USING (word) LEFT JOIN inner_nodes i USING (doc_id, ord) GROUP BY query_id, doc_id, ord, node_id, i.ord)"""


def light_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes without texts, made once as several steps read them."""
    return cut(search.with_inner(tree.with_parent_ord(trees.nodes(spark, sf))))


def texts(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    """The given nodes with their texts."""
    return pages.with_text(of, v.page_list(spark, sf))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with their texts."""
    return texts(spark, sf, light_nodes(spark, sf))


def found_texts(spark: SparkSession, sf: str, asked: DataFrame, of: DataFrame) -> DataFrame:
    """Texts of the nodes that ``asked(doc_id, node_id)`` names; only pages of their documents are read into the exchange."""
    keys = cut(asked.select("doc_id", "node_id").distinct())
    own = of.join(F.broadcast(keys), ["doc_id", "node_id"], "left_semi")  # a few for each question
    p = v.page_list(spark, sf).join(F.broadcast(keys.select("doc_id").distinct()), "doc_id", "left_semi")
    return pages.with_text(own, p)


@query(sql(f"{_SCORES} SELECT query_id, doc_id, ord, node_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5"))
def tree_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nodes that share most words with each question, leaves first."""
    return search.search_nodes(v.questions(spark, sf), nodes(spark, sf)).select("query_id", "doc_id", "ord", "node_id", "score", "rank")


# Answers of a search: its nodes for each document, by rank, with a repeated and an unknown id.
_ANS = f"""{_SCORES.removeprefix(_TEXTS)}, best AS (SELECT query_id, doc_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM sc QUALIFY rank <= 5),
 ids AS (SELECT query_id, doc_id, list_concat(list(node_id ORDER BY rank), ['9999', '0000', list(node_id ORDER BY rank)[1], '0003']) AS node_list FROM best GROUP BY query_id, doc_id)"""


def answers(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    best = search.search_nodes(v.questions(spark, sf), texts(spark, sf, of))
    ids = best.groupBy("query_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("ids"))  # five at most
    return ids.select("query_id", "doc_id", F.concat("ids", F.array(F.lit("9999"), F.lit("0000"), F.col("ids")[0], F.lit("0003"))).alias("node_list"))


_DISTINCT = ", ex AS (SELECT query_id, doc_id, unnest(node_list) AS node_id, unnest(generate_series(1, len(node_list))) AS nth FROM ids), ds AS (SELECT query_id, doc_id, node_id, min(nth) AS nth FROM ex GROUP BY ALL)"


@query(sql(f"{_TEXTS}{_ANS}{_DISTINCT} SELECT d.query_id, d.doc_id, d.node_id, cast(row_number() OVER (PARTITION BY query_id, d.doc_id ORDER BY nth) - 1 AS INTEGER) AS pos FROM ds d JOIN txt n ON n.doc_id = d.doc_id AND n.node_id = d.node_id QUALIFY pos < 3"))
def node_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct known ids of an answer, the first three."""
    n = light_nodes(spark, sf)
    return search.chosen(answers(spark, sf, n), n, 3)


@query(sql(f"{_TEXTS}{_ANS}{_DISTINCT}, top AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY nth) <= 5), "
           f"j AS (SELECT t.query_id, t.doc_id, t.nth, '[' || n.node_id || ' p' || start_index || '-' || end_index || '] ' || title || {NL} || {COLLAPSE.format('text')} AS part FROM top t JOIN txt n ON n.doc_id = t.doc_id AND n.node_id = t.node_id WHERE {COLLAPSE.format('text')} <> '') "
           f"SELECT query_id, doc_id, string_agg(part, {NL} || {NL} ORDER BY nth) AS context FROM j GROUP BY ALL"))
def retrieved_context(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts of the first five distinct ids."""
    n = light_nodes(spark, sf)
    a = cut(answers(spark, sf, n))
    return search.retrieved_context(a, found_texts(spark, sf, a.select("doc_id", F.explode("node_list").alias("node_id")), n))


@query(sql(f"{_TEXTS}{_ANS}{_DISTINCT}, pg AS (SELECT d.query_id, d.doc_id, p.page_no, min(d.nth) AS nth FROM ds d JOIN txt n ON n.doc_id = d.doc_id AND n.node_id = d.node_id JOIN (SELECT DISTINCT page_no FROM pl) p ON p.page_no BETWEEN n.start_index AND n.end_index GROUP BY ALL) "
           "SELECT query_id, doc_id, cast(page_no AS INTEGER) AS page_no, cast(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY nth, page_no) - 1 AS INTEGER) AS place FROM pg"))
def retrieved_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pages of retrieved nodes, in the order they are first seen."""
    n = light_nodes(spark, sf)
    return search.retrieved_pages(answers(spark, sf, n), n)


@query(sql(f"{_TEXTS}{_ANS}{_DISTINCT} SELECT d.query_id, d.doc_id, d.node_id, coalesce(n.title, 'NOT FOUND') AS title FROM ds d LEFT JOIN txt n ON n.doc_id = d.doc_id AND n.node_id = d.node_id"))
def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of ids for display."""
    n = light_nodes(spark, sf)
    asked = answers(spark, sf, n).select("query_id", "doc_id", F.explode(F.array_distinct("node_list")).alias("node_id"))
    return search.looked_up(asked, n).select("query_id", "doc_id", "node_id", "title")


@query(sql(f"{_SCORES}, h AS (SELECT query_id, '0001' AS node_id, sum(CASE word WHEN 'the' THEN 2.5::DOUBLE WHEN 'de' THEN 1.0::DOUBLE END) AS boost FROM qw WHERE word IN ('the', 'de') GROUP BY query_id), "
           "b AS (SELECT s.query_id, doc_id, ord, s.node_id, score + coalesce(boost, 0) AS score FROM sc s LEFT JOIN h ON h.query_id = s.query_id AND h.node_id = s.node_id) "
           "SELECT query_id, doc_id, node_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS INTEGER) AS rank FROM b QUALIFY rank <= 3"))
def search_with_preference(spark: SparkSession, sf: str) -> DataFrame:
    """Scores raised by expert hints."""
    q = v.questions(spark, sf)
    hints = spark.createDataFrame([("the", "0001", 2.5), ("de", "0001", 1.0)], "keyword string, node_id string, boost double")
    best = search.search_nodes(q, nodes(spark, sf), 3, boosts=search.boosts(q, hints))
    return best.select("query_id", "doc_id", "node_id", "score", "rank")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de' AND n_chars > 2000")
def doc_search_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by a condition on their metadata; the filter reaches the scan."""
    return v.table(spark, sf, "documents").where("lang = 'de' AND n_chars > 2000").select("doc_id", "lang", "source", "n_chars")


@query(sql(f"{_TEXTS}{_QW}, ds AS (SELECT doc_id, 'Covers: ' || string_agg(title, '; ' ORDER BY ord) || '.' AS d FROM txt WHERE depth = 0 GROUP BY doc_id), dw AS (SELECT DISTINCT doc_id, unnest({sql_words('lower(d)')}) AS word FROM ds), "
           "s AS (SELECT query_id, doc_id, count(*) AS score FROM dw JOIN qw USING (word) GROUP BY ALL) SELECT query_id, doc_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"))
def doc_search_description(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their descriptions."""
    from quire.plans.build import descriptions

    return search.search_descriptions(v.questions(spark, sf), descriptions(trees.nodes(spark, sf)), 5)


_VEC = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, vec_id % 50 AS doc_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q), top AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 40)"""


def near(spark: SparkSession, sf: str) -> DataFrame:
    c = v.chunk_vectors(spark, sf)
    return search.search_vectors(c, c.where("vec_id = 0").select(F.col("embedding").alias("vector")), 40)


@query(f"{_VEC} SELECT vec_id, doc_id, round(score, 6) AS score FROM top")
def doc_search_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks nearest to a question's vector."""
    return near(spark, sf).select("vec_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"{_VEC} SELECT doc_id, round(sum(score) / sqrt(count(*) + 1), 6) AS doc_score, count(*) AS n_chunks FROM top GROUP BY doc_id")
def doc_score(spark: SparkSession, sf: str) -> DataFrame:
    """Document scores from chunk scores."""
    return search.document_scores(near(spark, sf)).select("doc_id", F.round("doc_score", 6).alias("doc_score"), "n_chunks")


@query(sql(f"""{_SCORES}, best AS (SELECT query_id, doc_id, node_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) <= 5),
 ctx AS (SELECT query_id, concat_ws(':', best.doc_id, node_id) AS label, regexp_replace({COLLAPSE.format('text')}, '([.!?]) ', '\\1' || chr(1), 'g') AS marked FROM best JOIN txt USING (doc_id, node_id)),
 st AS (SELECT query_id, label, unnest(string_split(marked, chr(1))) AS sentence, unnest(generate_series(1, len(string_split(marked, chr(1))))) AS pos FROM ctx),
 sw AS (SELECT DISTINCT query_id, label, pos, sentence, unnest({sql_words('lower(sentence)')}) AS word FROM st),
 hit AS (SELECT query_id, label, pos, sentence, count(*) AS score FROM sw JOIN qw USING (query_id, word) GROUP BY ALL),
 two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, pos) AS rank FROM hit QUALIFY rank <= 2),
 said AS (SELECT query_id, string_agg(sentence || ' [' || label || ']', ' ' ORDER BY rank) AS answer FROM two GROUP BY query_id)
 SELECT item_id AS query_id, coalesce(answer, 'The context is not sufficient to answer.') AS answer FROM benchmark LEFT JOIN said ON query_id = item_id"""))
def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    """An extractive, cited answer from each question's retrieved nodes."""
    q = v.questions(spark, sf)
    n = light_nodes(spark, sf)
    top = cut(search.search_nodes(q, texts(spark, sf, n)).select("query_id", "doc_id", "node_id"))
    ctx = top.join(found_texts(spark, sf, top, n).select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    return search.best_sentences(q, ctx.select("query_id", F.concat_ws(":", "doc_id", "node_id").alias("label"), "text"))

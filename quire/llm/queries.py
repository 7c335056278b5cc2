"""The thin queries of the corpus operators and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, extract, language, minhash, pieces, quality, secrets, sharding, token_counts, warc
from quire.llm.common import shared_folder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records against a replica with known damage."""
    recs = warc.records(table(spark, sf_dir, "pages"))
    return warc.audit(recs, warc.damaged(recs))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map goes through the shared folder: version 1 is written there and read back."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), store=f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op6_quality`` that SQL can express: statistics and base rules."""
    return quality.base_rules(table(spark, sf_dir, "documents")).drop("n_lines", "n_twice")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op1_secret_scan`` that SQL can express: how often each base pattern occurs."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_warc_fixity, op3_pieces, op4_html_extraction, op5_sharding, op6_quality, op7_language_id, op8_decontaminate, op9_minhash, op10_token_counts,
        quality_base_columns, secret_base_counts,
    )
}
_NL = "chr(13) || chr(10)"
#: The audit's result follows from the planted damage; records, places and digests are rebuilt from the pages.
_OP2 = f"""
WITH block AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body,
         'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || {_NL} || coalesce(html, '') AS block
  FROM pages
), record AS (
  SELECT page_id,
         'WARC/1.1' || {_NL} || 'WARC-Type: response' || {_NL} || 'WARC-Target-URI: ' || url || {_NL}
         || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id AS VARCHAR), '') || '>' || {_NL}
         || 'WARC-Payload-Digest: sha256:' || sha256(body) || {_NL}
         || 'Content-Type: application/http; msgtype=response' || {_NL}
         || 'Content-Length: ' || cast(strlen(block) AS VARCHAR) || {_NL} || {_NL} || block || {_NL} || {_NL} AS record
  FROM block
), side AS (
  SELECT 'a' AS side, page_id, record FROM record
  UNION ALL
  SELECT 'b', page_id, CASE WHEN page_id % {warc.DAMAGE_EVERY} = {warc.CHANGED_AT} THEN left(record, length(record) - 5) || chr(1) || {_NL} || {_NL} ELSE record END
  FROM record WHERE page_id % {warc.DAMAGE_EVERY} <> {warc.MISSING_AT}
  UNION ALL
  SELECT 'b', -page_id, record FROM record WHERE page_id % {warc.DAMAGE_EVERY} = {warc.EXTRA_AT}
), leaf AS (
  SELECT side, page_id, (page_id % {warc.RECORDS_PER_FILE} + {warc.RECORDS_PER_FILE}) % {warc.RECORDS_PER_FILE} AS idx, strlen(record) AS size, sha256(record) AS digest FROM side
), placed AS (
  SELECT *, (page_id - idx) // {warc.RECORDS_PER_FILE} AS file FROM leaf
), ranged AS (
  SELECT *, sum(size) OVER (PARTITION BY side, file ORDER BY idx ROWS UNBOUNDED PRECEDING) AS stop FROM placed
), one AS (SELECT * FROM ranged WHERE side = 'a'), two AS (SELECT * FROM ranged WHERE side = 'b')
SELECT cast(coalesce(one.file, two.file) AS BIGINT) AS file, cast(coalesce(one.idx, two.idx) AS BIGINT) AS idx, coalesce(one.page_id, two.page_id) AS page_id,
       CASE WHEN two.page_id IS NULL THEN 'missing' WHEN one.page_id IS NULL THEN 'extra' ELSE 'changed' END AS status,
       cast(one.stop - one.size AS BIGINT) AS start_a, cast(one.stop AS BIGINT) AS end_a, cast(two.stop - two.size AS BIGINT) AS start_b, cast(two.stop AS BIGINT) AS end_b,
       one.digest AS digest_a, two.digest AS digest_b
FROM one FULL JOIN two ON one.page_id = two.page_id WHERE one.digest IS DISTINCT FROM two.digest
"""
#: In these tables the article element holds the whole text; blocks are its headings and paragraphs.
_OP4 = r"""
WITH inside AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), block AS (
  SELECT page_id, url, unnest(generate_series(1, len(parts))) AS k, unnest(parts) AS part FROM inside
), clean AS (
  SELECT page_id, k, replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM block
), tidy AS (
  SELECT page_id, k, trim(regexp_replace(regexp_replace(t, '&amp$', '&'), '\s+', ' ', 'g')) AS t FROM clean
), joined AS (
  SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS text FROM tidy WHERE t <> '' GROUP BY page_id
)
SELECT page_id, url, coalesce(text, '') AS text, cast(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN joined USING (page_id)
"""
#: All pairs that share a shingle, on exact sets, and reachability by recursion.
_OP9 = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), place AS (
  SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM word WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM place
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN link l ON l.u = r.other
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN size USING (doc_id)
"""
#: Words, lines and repeated windows counted one by one.
_BASE6 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, generate_series(0, 7) g(j) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM t LEFT JOIN inside USING (doc_id)
"""
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_BASE1 = rf"""
SELECT doc_id, cast(len(list_filter(regexp_extract_all(t, '({_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
       cast(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
       cast(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
ORACLES: dict[str, str] = {"secret_base_counts": _BASE1, "quality_base_columns": _BASE6, "op2_warc_fixity": _OP2, "op4_html_extraction": _OP4, "op9_minhash": _OP9}

"""WARC records and a Merkle fixity audit of replicas (operator 2).

Pages become WARC response records, laid out by page id in container files. Each
record is hashed; records in offset order are hashed into a tree of ``FANOUT`` per
node, first inside each file and then over the files, up to one root per replica.
A node hashes place, bytes and digest of its children, so it fixes their ordered offset
ranges as well. Two replicas are compared at the root; only branches that differ are
followed down, so records under equal branches are never looked at.

The audit is built from DataFrame functions. Every node gathers at most ``FANOUT``
digests, and every place sums the digests of its records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col, cut, has_at_most

FANOUT, RECORDS_PER_FILE = 16, 1000
#: Files over which records without an id are spread by their digests.
NULL_FILES = 4096
#: Differing branches up to which a level's parents are broadcast.
BROADCAST_BRANCHES = 200_000


def record_text(url: Column, html: Column, page_id: Column) -> Column:
    """One WARC/1.1 response record, ending with two empty lines. Nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, body)
    digest = F.sha2(body.cast("binary"), 256)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """``page_id, record``: every page as a WARC record."""
    id_ = col("page_id")
    return pages.select(id_.cast("long").alias("page_id"), record_text(col("url"), col("html"), id_).alias("record"))


def digests(recs: DataFrame) -> DataFrame:
    """``page_id, size, digest`` of ``recs(page_id, record)``."""
    return recs.select("page_id", F.octet_length("record").cast("long").alias("size"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))


def _number(first: int, digits: int) -> Column:
    """Some digits of the digest as a number."""
    return F.conv(F.substring("digest", first, digits), 16, 10).cast("decimal(20,0)").cast("long")


def _placed(rows: DataFrame, per_file: int) -> DataFrame:
    lost = F.col("page_id").isNull()
    place = F.when(lost, _number(1, 8) % per_file).otherwise(F.pmod("page_id", F.lit(per_file)))
    file = F.when(lost, _number(9, 8) % NULL_FILES).otherwise(F.expr(f"(page_id - pmod(page_id, {per_file}L)) div {per_file}"))
    return rows.select(lost.cast("int").alias("kind"), file.cast("long").alias("file"), place.cast("long").alias("idx"), "page_id", "size", "digest")


def leaves(rows: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Leaves of ``rows(page_id, size, digest)``: one for each place that has a record.

    ``kind, file, idx, n_records, bytes, digest, page_id, record``. A file holds ``per_file``
    consecutive ids, each at a place of its own (``idx``), so a missing record moves no other
    one. Records without an id (kind 1) have places that follow from their digests. A place
    may hold any number of records, all of one id: their digests are summed in
    parts, a sum that does not depend on order, so no task gathers them. ``page_id``
    and ``record`` are those of the smallest record.
    """
    sums = [F.sum(_number(k, 16 - 1).cast("decimal(20,0)")).cast("string") for k in (1, 16, 31, 46)]
    out = _placed(rows, per_file).groupBy("kind", "file", "idx").agg(
        F.count("*").alias("n_records"), F.sum("size").alias("bytes"), F.min("digest").alias("record"), F.concat_ws(",", *sums).alias("sums"), F.min("page_id").alias("page_id")
    )
    digest = F.when(F.col("n_records") == 1, F.col("record")).otherwise(F.sha2(F.col("sums").cast("binary"), 256))
    return out.select(*_NODE, digest.alias("digest"), "page_id", "record")


_NODE = ("kind", "file", "idx", "n_records", "bytes")


def _parents(nodes: DataFrame, key: list[Column]) -> DataFrame:
    """Nodes one level up: they hash place, number of records, bytes and digest of up to ``FANOUT`` children, in order."""
    part = F.struct("kind", "file", "idx", F.concat_ws(":", *(F.col(x).cast("string") for x in (*_NODE, "digest"))).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), ";")
    up = nodes.groupBy(*key).agg(F.sum("n_records").alias("n_records"), F.sum("bytes").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("digest"))
    return up.select(*_NODE, "digest")


def _inside(per_file: int) -> int:
    """Levels between the leaves and the one node of each file."""
    n, levels = per_file, 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _keys(level: int, inside: int, top: int) -> list[Column]:
    """Key of the parents of ``level``'s nodes: first by places in a file, then by files, the root last."""
    zero, shift = F.lit(0).cast("long"), FANOUT.bit_length() - 1
    if level < inside:
        return [F.col("kind"), F.col("file"), F.shiftright("idx", shift).alias("idx")]
    if level < top - 1:  # an arithmetic shift, so negative files end at -1
        return [F.col("kind"), F.shiftright("file", shift).alias("file"), zero.alias("idx")]
    return [F.lit(0).alias("kind"), zero.alias("file"), zero.alias("idx")]


def height(leaf_tables: list[DataFrame], per_file: int = RECORDS_PER_FILE) -> int:
    """Levels above the leaves, the same for all replicas: until files are numbered 0 or -1, and the root."""
    far = max(((leaf.agg(F.max(F.greatest("file", -F.col("file") - 1))).first()[0]) or 0) for leaf in leaf_tables)
    levels = _inside(per_file) + 1
    while far > 0:
        far, levels = far // FANOUT, levels + 1
    return levels


def tree(leaf: DataFrame, top: int, per_file: int = RECORDS_PER_FILE) -> list[DataFrame]:
    """Levels from the leaves to the root, each ``kind, file, idx, n_records, bytes, digest``; no records, no nodes.

    Every node but the root has at most ``FANOUT`` children; the root at most four (ids
    below 0, from 0 on, and records without an id).
    """
    levels = [leaf]
    for level in range(top):
        levels.append(cut(_parents(levels[-1], _keys(level, _inside(per_file), top))))
    return levels


def compare(one: list[DataFrame], two: list[DataFrame], per_file: int = RECORDS_PER_FILE) -> tuple[DataFrame, list[int]]:
    """Leaves that differ, found from the root down, and the number of differing nodes per level.

    Only children of differing nodes are read at each level. Their offsets follow from the
    parent's and from the bytes of the siblings before them.
    """
    names = ("kind", "file", "idx")
    top, counts, open_, differ = len(one) - 1, [], None, None
    for level in range(top, -1, -1):
        pair = []
        for side, levels in (("a", one), ("b", two)):
            nodes = levels[level]
            more = ["page_id", "record"] if level == 0 else []
            start = F.lit(0).cast("long")
            if open_ is not None:
                parent = [k.alias(f"up_{n}") for k, n in zip(_keys(level, _inside(per_file), top), names)]
                nodes = nodes.select("*", *parent).join(open_, [f"up_{n}" for n in names])
                before = "sum(bytes) OVER (PARTITION BY up_kind, up_file, up_idx ORDER BY kind, file, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                if level < _inside(per_file):  # offsets begin anew in each file; a window holds FANOUT siblings at most
                    start = F.coalesce(F.col(f"up_start_{side}"), F.lit(0)) + F.coalesce(F.expr(before), F.lit(0))
            pair.append(nodes.select(*names, *(F.col(x).alias(f"{x}_{side}") for x in ("n_records", "bytes", "digest", *more)), start.alias(f"start_{side}")))
        same = (F.col("digest_a") == F.col("digest_b")) & (F.col("n_records_a") == F.col("n_records_b")) & (F.col("bytes_a") == F.col("bytes_b"))
        differ = cut(pair[0].join(pair[1], list(names), "full").where(~F.coalesce(same, F.lit(False))))
        counts.append(differ.count())
        open_ = differ.select(*(F.col(n).alias(f"up_{n}") for n in names), F.col("start_a").alias("up_start_a"), F.col("start_b").alias("up_start_b"))
        open_ = F.broadcast(open_) if counts[-1] <= BROADCAST_BRANCHES else open_
    return differ, counts


def audit(one: DataFrame, two: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Compare two replicas ``(page_id, record)``; see ``audit_digests``."""
    return audit_digests(digests(one), digests(two), per_file)


def audit_digests(one: DataFrame, two: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Compare two replicas ``(page_id, size, digest)``; one row for each record that differs.

    ``file, idx, page_id, status, start_a, end_a, start_b, end_b, digest_a, digest_b``, where
    status is ``changed``, ``missing`` (only in the first replica) or ``extra``. Offsets are
    those of the record's place in its file, with the records in the order of their ids.
    Equal replicas, and two empty ones, give no rows. Where an id has several records in
    one of the replicas, each that the other one lacks is a row, ``missing`` or ``extra``,
    with the offsets of the whole place. So are records without an id, whose ``file`` and
    ``idx`` are null. Of repeated equal records the surplus counts.
    """
    rows = [cut(x.select(F.col("page_id").cast("long").alias("page_id"), "size", "digest")) for x in (one, two)]
    leaf = [cut(leaves(x, per_file)) for x in rows]
    top = height(leaf, per_file)
    differ, _ = compare(*(tree(x, top, per_file) for x in leaf), per_file)
    single = (F.coalesce("n_records_a", F.lit(0)) <= 1) & (F.coalesce("n_records_b", F.lit(0)) <= 1)
    ends = {"a": F.col("start_a") + F.col("bytes_a"), "b": F.col("start_b") + F.col("bytes_b")}
    place = [F.when(F.col("kind") == 0, F.col(x)).alias(x) for x in ("file", "idx")]
    ranges = ["start_a", ends["a"].alias("end_a"), "start_b", ends["b"].alias("end_b")]
    both = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    alone = differ.where(single & (F.col("kind") == 0)).select(*place, F.coalesce("page_id_a", "page_id_b").alias("page_id"), both.alias("status"), *ranges, "digest_a", "digest_b")

    many = differ.where(~single | (F.col("kind") == 1)).select("kind", "file", "idx", *ranges)
    many = F.broadcast(many) if has_at_most(many, BROADCAST_BRANCHES) else many
    counted = None
    for sign, x in ((1, rows[0]), (-1, rows[1])):
        held = _placed(x, per_file).join(many.select("kind", "file", "idx"), ["kind", "file", "idx"], "left_semi")
        held = held.groupBy("kind", "file", "idx", "page_id", "digest").agg((F.count("*") * sign).alias("n"))
        counted = held if counted is None else counted.union(held)
    left = counted.groupBy("kind", "file", "idx", "page_id", "digest").agg(F.sum("n").alias("n")).where("n <> 0").join(many, ["kind", "file", "idx"])
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))))
    side = F.when(F.col("n") > 0, "missing").otherwise("extra")
    several = left.select(*place, "page_id", side.alias("status"), "start_a", "end_a", "start_b", "end_b", F.when(F.col("n") > 0, F.col("digest")).alias("digest_a"), F.when(F.col("n") < 0, F.col("digest")).alias("digest_b"))
    return alone.union(several)


def root_digest(levels: list[DataFrame]) -> str | None:
    row = levels[-1].first()
    return row.digest if row else None


# Files.


def write_files(recs: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as plain WARC text, one folder for each container, records in id order."""
    file = F.coalesce(F.expr(f"(page_id - pmod(page_id, {per_file}L)) div {per_file}").cast("string"), F.lit("none"))
    rows = recs.select(file.alias("file"), "page_id", F.regexp_replace("record", r"\r\n\r\n\z", "").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "page_id").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)\r\n", re.I)


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file (plain or gzip): type, target, offset, length and payload.

    Bytes that are no record (a broken header, a length that does not fit, a gzip stream
    that ends early) are a row of type ``error``; reading goes on at the next header, and
    the offsets of all rows cover the file without gaps.
    """
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    at, n = 0, len(data)
    while at < n:
        head = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        size = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        end = head + 8 + int(size[1]) if size else -1
        if not 0 <= end <= n or data[end - 4 : end] != b"\r\n\r\n":
            end = data.find(b"WARC/1.", at + 1)
            end = n if end < 0 else end
            yield {"type": "error", "url": None, "record_id": None, "offset": at, "length": end - at, "payload": data[at:end]}
            at = end
            continue
        fields = dict(x.split(": ", 1) for x in data[at:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        yield {"type": fields.get("WARC-Type"), "url": fields.get("WARC-Target-URI"), "record_id": fields.get("WARC-Record-ID"), "offset": at, "length": end - at, "payload": data[head + 4 : end - 4]}
        at = end


def _unzipped(data: bytes) -> bytes:
    """All that can be read of a gzip file of one or many members; the rest, if broken, as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        if not member.eof:
            return b"".join(out)
        data = member.unused_data
    return b"".join([*out, data])


_FILE_KINDS = [("path", pa.string()), ("type", pa.string()), ("url", pa.string()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]
_FILE_SCHEMA = "path string, type string, url string, record_id string, offset long, length long, digest string, payload binary"
#: Payload bytes in one batch.
_BATCH_BYTES = 16_000_000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (``*.warc``, ``*.warc.gz`` or what ``write_files`` wrote); a file is parsed in one task.

    ``digest`` is the SHA-256 of the whole record. Bytes that are no record have type ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                data = data.as_py()
                plain = _unzipped(data) if data[:2] == b"\x1f\x8b" else data
                for r in parse(plain):
                    digest = hashlib.sha256(plain[r["offset"] : r["offset"] + r["length"]]).hexdigest()
                    held.append(r | {"path": name.as_py(), "digest": digest})
                    size += r["length"]
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(_FILE_KINDS))
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, pa.schema(_FILE_KINDS))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _FILE_SCHEMA)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, size, digest`` of a folder of WARC files, for ``audit_digests``.

    The id is the number in ``<urn:page:...>``; records without one, and bytes that are no
    record, have a null id.
    """
    id_ = F.regexp_extract(F.coalesce("record_id", F.lit("")), "^<urn:page:(-?[0-9]{1,18})>$", 1)
    return read_files(spark, path).select(F.when(id_ != "", id_.cast("long")).alias("page_id"), F.col("length").alias("size"), "digest")


def audit_files(spark: SparkSession, one: str, two: str, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Compare two folders of WARC files; see ``audit_digests``."""
    return audit_digests(file_digests(spark, one), file_digests(spark, two), per_file)


# A replica with known damage, for the registered query and the tests.

#: Of each 97 page ids, one has a changed record, one has none, one has a second record under a negative id.
DAMAGE_EVERY, CHANGED_AT, MISSING_AT, EXTRA_AT = 97, 13, 29, 57


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with changed records (the last byte but four replaced), missing ones and extra ones."""
    at = lambda k: F.coalesce(F.pmod("page_id", F.lit(DAMAGE_EVERY)) == k, F.lit(False))
    bad = F.concat(F.expr("left(record, length(record) - 5)"), F.lit("\x01"), F.lit("\r\n\r\n"))
    kept = recs.where(~at(MISSING_AT)).select("page_id", F.when(at(CHANGED_AT) & (F.length("record") > 5), bad).otherwise(F.col("record")).alias("record"))
    return kept.union(recs.where(at(EXTRA_AT)).select((-F.col("page_id")).alias("page_id"), "record"))

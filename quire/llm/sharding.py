"""Sharding by fixed virtual slots (operator 5), with DataFrame functions only.

A record is hashed into one of a fixed number of virtual slots. Bytes are summed
per slot, and a map of that fixed size says which shard holds which slot. The first
map deals the slots, largest first, to the shard that is lightest so far; later ones
are edits: a new shard takes slots from all others and nothing else moves. Maps are
stored as versions.

A hot source, a group of copies and rows without an id are spread over all slots: a
slot follows from id, text and number of the copy. A row's place in its shard is its place in its slot plus the rows of the
shard's earlier slots, so no task ever orders a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col, cut

SLOTS, SHARDS = 4096, 16
#: Copies of one row that a task deals out at once.
COPIES = 4096
_BY_SLOT = "PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; a null text counts as empty.

    The slot follows from id, text and, for repeated rows, the number of the copy, so
    neither rows without an id nor a row that occurs very often share a slot. Copies
    are counted before they are moved and dealt out again in blocks.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    once = rows.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    blocks = rows.where("copies > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    many = blocks.repartition("doc_id", "size", "text_crc32", "block")
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(copies, (block + 1) * {COPIES}) - 1)"))).drop("block")
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(slots)).cast("int")
    return once.unionByName(many).select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``virtual_slot, bytes, n_rows, shard``: slots by falling bytes, each to the lightest shard so far.

    One fold over the slots, whose number is fixed and does not follow the input.
    """
    slots = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "n_rows"))).alias("slots"))
    dealt = slots.selectExpr(f"""
        aggregate(slots,
          struct(array_repeat(0L, {shards}) AS loads, cast(array() AS array<int>) AS shards),
          (acc, s) -> struct(
            transform(acc.loads, (x, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, x - s.less, x)) AS loads,
            concat(acc.shards, array(cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int))) AS shards),
          acc -> acc.shards) AS shards""", "slots")
    return dealt.selectExpr("inline(arrays_zip(slots, shards))").selectExpr(
        "slots.virtual_slot AS virtual_slot", "-slots.less AS bytes", "slots.n_rows AS n_rows", "shards AS shard"
    )


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """Edit a map for one more shard, number ``shards``: every shard gives about ``1 / (shards + 1)`` of its bytes."""
    given = "sum(bytes) OVER (PARTITION BY shard ORDER BY xxhash64(virtual_slot), virtual_slot ROWS UNBOUNDED PRECEDING)"
    share = f"sum(bytes) OVER (PARTITION BY shard) / {shards + 1}"
    return slot_map.selectExpr("virtual_slot", "bytes", "n_rows", f"cast(if({given} <= {share}, {shards}, shard) AS int) AS shard")


def rebalance_map(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Edit a map for the slots' present sizes: only slots of shards that are above the mean move.

    Slots are looked at by falling bytes; one moves to the lightest shard if that leaves
    the lightest below where the slot's own shard was. Slots that the map lacks are dealt so too.
    """
    now = sizes.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot", "left")
    slots = now.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "n_rows", F.coalesce("shard", F.lit(-1)).alias("shard")))).alias("slots"))
    slots = slots.selectExpr("slots", f"transform(sequence(0, {shards - 1}), k -> aggregate(filter(slots, s -> s.shard = k), 0L, (n, s) -> n - s.less)) AS loads", "aggregate(slots, 0L, (n, s) -> n - s.less) AS total")
    dealt = slots.selectExpr(f"""
        aggregate(slots, struct(loads AS loads, cast(array() AS array<int>) AS shards),
          (acc, s) -> named_struct(
            'loads', transform(acc.loads, (x, k) -> x
              + if(k = array_position(acc.loads, array_min(acc.loads)) - 1 AND (s.shard < 0 OR (get(acc.loads, s.shard) * {shards} > total AND array_min(acc.loads) - s.less < get(acc.loads, s.shard))), -s.less, 0L)
              + if(k = s.shard AND get(acc.loads, s.shard) * {shards} > total AND array_min(acc.loads) - s.less < get(acc.loads, s.shard), s.less, 0L)),
            'shards', concat(acc.shards, array(cast(if(
              s.shard < 0 OR (get(acc.loads, s.shard) * {shards} > total AND array_min(acc.loads) - s.less < get(acc.loads, s.shard)),
              array_position(acc.loads, array_min(acc.loads)) - 1, s.shard) AS int)))),
          acc -> acc.shards) AS shards""", "slots")
    return dealt.selectExpr("inline(arrays_zip(slots, shards))").selectExpr(
        "slots.virtual_slot AS virtual_slot", "-slots.less AS bytes", "slots.n_rows AS n_rows", "shards AS shard"
    )


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a map as a version; an existing version is never overwritten."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored versions, one folder each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    return sorted(int(x[8:]) for x in names if x.startswith("version="))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    version = max(versions(spark, path)) if version is None else version
    return spark.read.parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map to place rows by: version 1 where none is stored, else the latest one edited for ``sizes`` and stored as the next."""
    held = versions(spark, path)
    write_map(rebalance_map(read_map(spark, path), sizes, shards) if held else first_map(sizes, shards), path, max(held, default=0) + 1)
    return read_map(spark, path)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with their shard and their place in it, gapless from 0."""
    starts = slot_map.selectExpr("virtual_slot", "shard", f"coalesce(sum(n_rows) OVER ({_BY_SLOT}), 0L) AS start")
    place_in_slot = "row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size) - 1"
    numbered = rows.selectExpr("*", f"{place_in_slot} AS place")
    # The map has one row for each slot, a fixed number.
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("place"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot``.

    The law is ``bytes``: shards are near equal in bytes. ``slot`` is the row's place in
    its shard, gapless from 0; ``grown_shard`` is null under this law. A null text counts
    as empty; rows without an id and repeated rows get a place each; an empty table
    gives no rows. Other columns are ignored.

    ``store`` is a shared folder of map versions: the map is read from there, after
    the first version, or an edited one for the present sizes, has been written. Without
    it the map is dealt anew.
    """
    rows = records(docs, slots)
    sizes = slot_sizes(rows)
    out = place(rows, stored_map(docs.sparkSession, store, sizes, shards) if store else first_map(sizes, shards))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )

"""MinHash near-duplicates with b-bit signatures (operator 9).

1. Every document becomes a set of 5-word shingles (64-bit hashes), 256 minima,
   48 band keys of five minima, and a *b-bit signature*: the low two bits of each
   minimum, packed in two 32-byte planes.
2. Documents with equal shingle sets collapse into one class; only its smallest
   doc_id goes on.
3. Band keys make candidate buckets. A bucket is compared in blocks of at most
   512 x 512 packed signatures; bit counts give the agreement ``p`` and the
   collision-corrected estimate ``(p - 1/4) / (1 - 1/4)``. Only pairs whose
   estimate is within 4.5 standard errors of the threshold go on.
4. Those pairs are confirmed on the full word shingles of both texts, and the
   links give components.

A bucket of n near copies would have n * n / 2 pairs, so they are never emitted. The
first round pairs every member of a bucket with its smallest id only, estimates and
confirms these pairs, which joins most copies. The second round looks again at the
buckets that still hold two components: every block gets the full shingle sets of its
members, confirms all pairs between components that reach the estimate inside the task,
and emits at most one confirmed link for each join of two components. Pairs inside one
component cannot change the result; no others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, cut, has_at_most, release, small_batches
from quire.llm.components import connected_components

WORDS, HASHES, BANDS, ROWS, BITS, BLOCK = 5, 256, 48, 5, 2, 512
#: Ids up to which the list of documents to confirm is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Buckets with several members up to which their list is broadcast (24 bytes each).
BROADCAST_BUCKETS = 400_000

_U = np.uint64
_MUL = (np.random.default_rng(20240607).integers(1, 2**63, HASHES, dtype=np.uint64) << _U(1)) | _U(1)
_POS = (np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) << _U(1)) | _U(1)
_BAND = np.random.default_rng(78).integers(1, 2**63, BANDS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> set[bytes]:
    """The exact set: distinct 5-word shingles, or the whole shorter sequence as one."""
    w = words_of(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))}


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(WORDS, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += mix(h[i : n - k + 1 + i] + _U(i)) * _POS[i]
    return np.unique(mix(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(low, (_MUL[:, None] * hashes[None, i : i + 1024]).min(axis=1), out=low)
    return low >> _U(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS) + _U(1)
    return mix((mix(rows) * _POS[None, :ROWS]).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def pack(low: np.ndarray) -> bytes:
    """Low two bits of each minimum as two planes of one bit each."""
    return b"".join(np.packbits(((low >> _U(b)) & _U(1)).astype(np.uint8)).tobytes() for b in range(BITS))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of uint64): one with many, or row by row."""
    x = np.atleast_2d(one) ^ many
    half = x.shape[1] // BITS
    differ = np.bitwise_count(x[:, :half] | x[:, half:]).sum(axis=1)
    chance = 2.0**-BITS
    return (1.0 - differ / HASHES - chance) / (1.0 - chance)


def slack(threshold: float) -> float:
    """4.5 standard errors of the estimate at the threshold."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return 4.5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


_SKETCH = "struct<n:bigint,key:binary,bands:array<bigint>,packed:binary>"


def _sketch(text: pa.Array) -> pa.Array:
    n, keys, bands, packed = [], [], [], []
    for t in text:
        w = words_of(t.as_py())
        if not w:
            n.append(0), keys.append(None), bands.append(None), packed.append(None)
            continue
        h = shingle_hashes(w)
        low = minima(h)
        n.append(len(h))
        keys.append(xxhash.xxh3_128_digest(h.tobytes()))
        bands.append(band_keys(low))
        packed.append(pack(low))
    release()
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
        names=["n", "key", "bands", "packed"],
    )


@lru_cache(maxsize=16)
def _set(text: str | None) -> frozenset[bytes]:
    return frozenset(shingle_set(text))


def _jaccard_udf(threshold: int):
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            s, t = _set(x.as_py()), _set(y.as_py())
            both = len(s & t)
            out.append(bool(s) and bool(t) and 100 * both >= threshold * (len(s) + len(t) - both))
        return pa.array(out, pa.bool_())

    return linked


def _estimates(u: pa.Array, v: pa.Array) -> pa.Array:
    """Estimates of pairs of packed signatures."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1) for x in (u, v))
    return pa.array(estimate(a, b), pa.float64())


def _confirmed(threshold: int, floor: float, ids: np.ndarray, sig: np.ndarray, left: np.ndarray, label: np.ndarray, texts: list) -> Iterator[tuple[int, int]]:
    """Links of one block between components, confirmed on the full sets: one for each join."""
    diagonal = bool(left.all())
    root = np.unique(label, return_inverse=True)[1]
    if not root.any():
        return
    sets = [shingle_hashes(words_of(t)) for t in texts]
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat.max()) + 1, bool)
    for i in range(len(ids) - 1):
        y = np.arange(i + 1, len(ids))
        y = y[(root[y] != root[i]) & (diagonal | (left[y] != left[i]))]
        if len(y):
            y = y[estimate(sig[i], sig[y]) >= floor]
        if not len(y):
            continue
        own = flat[first[i] : first[i] + size[i]]
        mark[own] = True
        n = size[y]
        start = np.cumsum(n) - n
        both = np.add.reduceat(mark[flat[np.repeat(first[y] - start, n) + np.arange(n.sum())]].astype(np.int64), start)
        mark[own] = False
        for j in y[100 * both >= threshold * (size[i] + n - both)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield int(ids[i]), int(ids[j])


def _blocks(threshold: int, floor: float):
    """mapInArrow over rows sorted by (band, x, y): one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None and len(held):
                t = pa.concat_tables([held, t])
            if not len(t):
                continue
            key = np.stack([t[c].to_numpy() for c in ("band", "x", "y")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(ends[-1]) if len(ends) else 0
            yield from out(t.slice(0, last), ends[:-1] if len(ends) else ends)
            held = t.slice(last).combine_chunks()
        if held is not None and len(held):
            yield from out(held, np.array([], np.int64))
        release()

    def out(t: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        ids, label, blk, x = (t[c].to_numpy() for c in ("rep", "label", "blk", "x"))
        sig = np.frombuffer(b"".join(t["packed"].to_pylist()), np.uint64).reshape(len(t), -1)
        pairs: set[tuple[int, int]] = set()
        bounds = [0, *ends.tolist(), len(t)]
        for lo, hi in zip(bounds, bounds[1:]):
            found = _confirmed(threshold, floor, ids[lo:hi], sig[lo:hi], blk[lo:hi] == x[lo], label[lo:hi], t["text"][lo:hi].to_pylist())
            for a, b in found:
                if a != b:
                    pairs.add((min(a, b), max(a, b)))
        u, v = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _in_blocks(members: DataFrame, more: DataFrame, threshold: int, floor: float) -> DataFrame:
    """members(band, rep, m, label) and what a block needs of each rep -> confirmed links (u, v) between labels."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    blk = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tiles = (
        members.withColumn("blocks", blocks)
        .withColumn("blk", blk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "rep", "blk", "label")
        .join(more, "rep")
        .repartition("band", "x", "y")
        .sortWithinPartitions("band", "x", "y", "rep")
    )
    return tiles.mapInArrow(_blocks(threshold, floor), "u long, v long").distinct()


def _light(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast if there are at most so many."""
    return F.broadcast(rows) if has_at_most(rows, most) else rows


def _named(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id is among ``ids(id)``; only those are moved if the ids are few enough to broadcast."""
    return texts.join(_light(ids.distinct(), BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id", "text"])


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Keep the pairs that are linked on their full sets; only the texts they name are moved."""
    texts = _named(texts, pairs.select(F.col("u").alias("id")).union(pairs.select("v")))
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    linked = _jaccard_udf(threshold)
    return pairs.join(b, "v").join(a, "u").where(linked("text_u", "text_v")).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Links join documents with ``100 * |A n B| >= threshold * |A u B|``. A text that
    is null or has no word has an empty set and is linked with nothing. Rows that
    share a doc_id are one node. A null doc_id is linked with nothing, has a null
    component_id and is kept. Other columns of ``docs`` are ignored.
    """
    ids = small_batches(docs).select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    sk = cut(ids.select("doc_id", F.arrow_udf(_sketch, _SKETCH)("text").alias("s")).select("doc_id", "s.*"))
    classes = (
        sk.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    )
    classes = cut(classes)
    floor = threshold / 100 - slack(threshold / 100)
    signatures = classes.select("rep", "packed")
    every = classes.select("rep", F.explode("bands").alias("band"))
    buckets = cut(every.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("first")).where("m > 1"))
    members = cut(every.join(_light(buckets, BROADCAST_BUCKETS), "band"))
    texts = ids.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL")

    stars = members.where("first <> rep").select(F.col("first").alias("u"), F.col("rep").alias("v")).distinct()
    for side in ("u", "v"):
        stars = stars.join(signatures.select(F.col("rep").alias(side), F.col("packed").alias(f"packed_{side}")), side)
    near = F.arrow_udf(_estimates, "double")("packed_u", "packed_v") >= floor
    links = cut(_confirm(cut(stars.where(near).select("u", "v")), texts, threshold))
    label = connected_components(links).withColumnRenamed("node", "rep")
    labelled = cut(members.join(label, "rep", "left").select("band", "rep", "m", F.coalesce("component", "rep").alias("label")))
    several = cut(labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band"))
    open_ = cut(labelled.join(_light(several, BROADCAST_BUCKETS), "band", "left_semi"))
    more = _named(texts, open_.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep").join(signatures, "rep")
    links = cut(links.union(_in_blocks(open_, more, threshold, floor)))
    label = connected_components(links).withColumnRenamed("node", "rep")
    by_key = classes.select("key", "rep").join(label, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return (
        sk.select("doc_id", F.col("n").alias("n_shingles"), "key", "n")
        .join(by_key, "key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

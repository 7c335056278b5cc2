"""Benchmark decontamination by q-gram lemma filtering (operator 8).

Texts and benchmark items are taken in lower case with single spaces, as code points.
A passage is any stretch of 128 code points of an item, at whatever offset (or the whole
shorter item), and counts if it occurs in a text with at most 8 % edits. In one pass over
the texts every 8-gram is looked up; its hits fall on diagonals (place in the text minus
place in the item), which are counted in overlapping bands. A stretch of m code points
that occurs with at most e edits shares at least ``m + 1 - q * (e + 1)`` q-grams with the
text inside one band (the q-gram lemma), so only stretches that reach this count in a
band are worth a look. Unbroken runs of hits are exact passages; every other stretch is
verified by a banded alignment, many at a time.

Hits are worked on in slices of the text that overlap by a passage, so their number is
bounded however often a q-gram repeats. The inner part of a long run with a period of up
to 128 characters (rules, table borders) is passed over on both sides: it holds the same
stretches as the part that is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, cut, release, small_batches

Q, WINDOW, EDIT_SHARE = 8, 128, 0.08
#: By default items with fewer code points after normalisation are too short to be evidence.
MIN_CHARS = 24
#: Bytes of index that are built and broadcast at once, and those that a code point of the
#: benchmark takes; a larger benchmark is done in blocks.
BLOCK_BYTES, INDEX_BYTES = 96_000_000, 28
#: Hits that are worked on at once.
HITS = 200_000
#: Longest period of runs whose inner part is passed over, and the length that is left of them:
#: room for an occurrence at every offset of the period. Runs are first looked for in strides.
_PERIOD, _LEFT, _STRIDE = 128, 512, 64
_BITS = 22
_U = np.uint64
#: Alignments computed at once; a cost weighs _COST so that its start can ride below it.
_BATCH, _COST, _INF = 2048, 1 << 12, 10_000 << 12


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int) -> int:
    """Edits that a stretch of m code points may have; the lemma's count stays positive."""
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def windows(item, least: int = MIN_CHARS) -> list[tuple[int, bytes | str]]:
    """``(start, window)``: every stretch of an item that counts as a passage; all of a short item."""
    if len(item) < max(least, 1):
        return []
    return [(s, item[s : s + WINDOW]) for s in range(max(0, len(item) - WINDOW) + 1)]


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shortened(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without the inner part of long periodic runs, and the place of each code point that is left."""
    keep = np.ones(len(text), bool)
    column = np.ascontiguousarray(np.append(text, np.zeros(-len(text) % _STRIDE, text.dtype)).reshape(-1, _STRIDE).T)
    for p in range(1, _PERIOD + 1):
        if len(text) <= _LEFT + p:
            break
        some = column[p % _STRIDE, p // _STRIDE :]
        some = np.flatnonzero(some == column[0, : len(some)])
        n = _LEFT // _STRIDE - 1
        if len(some) < n or not (some[n - 1 :] - some[: len(some) - n + 1] == n - 1).any():
            continue
        edge = np.concatenate([[0], np.flatnonzero(np.diff(some) > 1) + 1, [len(some)]])
        for k in np.flatnonzero(np.diff(edge) >= n).tolist():
            low, high = max(0, int(some[edge[k]] - 1) * _STRIDE), min(len(text) - p, int(some[edge[k + 1] - 1] + 2) * _STRIDE)
            if not keep[low : high + p].all():
                continue
            same = (text[low + p : high + p] == text[low:high]) & (text[low + p : high + p] != 10)
            ends = low + np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for a, b in ends.reshape(-1, 2).tolist():  # the run is text[a : b + p]
                if b - a > _LEFT:
                    keep[a + _LEFT // 2 : a + _LEFT // 2 + (b + p - a - _LEFT) // p * p] = False
    place = np.flatnonzero(keep)
    return text[place], place


def _keys(text: np.ndarray) -> np.ndarray:
    """A 64-bit key for each q-gram of the code points, from keys of 2, 4 and 8."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    k = text.astype(np.uint64)
    for step in (1, 2, 4):
        k = (k[:-step] * _U(0x9E3779B97F4A7C15)) ^ (k[step:] * _U(0xC2B2AE3D27D4EB4F) >> _U(7)) * _U(0xFF51AFD7ED558CCD)
    return k


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, value)`` of the ranges ``first .. first + n - 1``."""
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


class BenchmarkIndex:
    """A block of items and where each of their q-grams occurs.

    Items under ``Q`` code points have no q-gram; they are found by plain search.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.short = [(item, "".join(map(chr, t))) for item, t in items if len(t) < Q]
        items = [(item, shortened(t)[0]) for item, t in items if len(t) >= Q]
        self.item = np.array([item for item, _ in items], np.int64)
        self.length = np.array([len(t) for _, t in items], np.int64)
        self.flat = np.concatenate([*(t for _, t in items), np.zeros(0, np.uint32)])
        self.base = np.cumsum(self.length) - self.length
        n = np.maximum(self.length - Q + 1, 0)
        row, off = _ranges(np.zeros(len(n), np.int64), n)
        key = np.concatenate([*(_keys(t) for _, t in items), np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key)).astype(np.int32)
        self.row, self.off = row[order].astype(np.int32), off[order].astype(np.int32)
        seen = np.zeros(1 << _BITS, bool)
        seen[(self.key >> _U(64 - _BITS)).astype(np.int64)] = True
        self.seen = np.packbits(seen)
        self.size = np.minimum(self.length, WINDOW)
        self.edits = np.array([budget(int(m)) for m in self.size], np.int64)
        self.least = self.size + 1 - Q * (self.edits + 1)
        self.step = int(self.edits.max(initial=0)) + 1
        self.shift = int(self.length.max(initial=0)) + self.step  # no band is negative
        self.reach = int((self.size + self.edits).max(initial=0))  # code points of the longest occurrence

    def hits(self, buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(row, place in the item, diagonal)`` of the q-grams that text and items share.

        Slices of the text, or of the items where a short stretch of text has very many
        hits; every occurrence of an item's stretch lies whole in one of them.
        """
        key = _keys(buf)
        if not len(key) or not len(self.key):
            return
        bit = (key >> _U(64 - _BITS)).astype(np.int64)
        pos = np.flatnonzero((self.seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
        at = np.minimum(np.searchsorted(self.key, key[pos]), len(self.key) - 1)
        hit = self.key[at] == key[pos]
        pos, at = pos[hit], at[hit]
        first = self.first[at].astype(np.int64)
        n = self.first[at + 1] - first
        total = np.cumsum(n)
        i, end = 0, len(pos)
        while i < end:
            j = int(np.searchsorted(total, total[i] - n[i] + HITS, "right"))
            j = max(j, int(np.searchsorted(pos, pos[i] + 2 * self.reach)))
            parts = -(-int(total[j - 1] - total[i] + n[i]) // HITS)
            for part in range(parts if parts > 1 else 1):
                k, each = _ranges(first[i:j], n[i:j]) if parts <= 1 else self._of_part(first[i:j], n[i:j], part, parts)
                row, off = self.row[each].astype(np.int64), self.off[each].astype(np.int64)
                yield row, off, pos[i:j][k] - off + self.shift
            if j >= end:
                return
            i = max(i + 1, int(np.searchsorted(pos, pos[j - 1] + 1 - self.reach)))

    def _of_part(self, first: np.ndarray, n: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges' values whose item belongs to a part, found few ranges at a time."""
        out = []
        edge = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(n)]):
            k, each = _ranges(first[a:b], n[a:b])
            mine = self.row[each] % parts == part
            out.append((k[mine] + a, each[mine]))
        return np.concatenate([k for k, _ in out]), np.concatenate([e for _, e in out])

    def exact(self, row, off, diagonal) -> np.ndarray:
        """Rows ``(row, start, diagonal)`` of stretches whose q-grams all lie on one diagonal."""
        order = np.lexsort((off, diagonal, row))
        row, off, diagonal = row[order], off[order], diagonal[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (diagonal[1:] != diagonal[:-1]) | (off[1:] != off[:-1] + 1)
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(row)))
        n = run - (self.size[row[head]] - Q)
        head, n = head[n > 0], n[n > 0]
        k, start = _ranges(off[head], n)
        return np.stack([row[head][k], start, diagonal[head][k]], axis=1)

    def regions(self, row, off, diagonal) -> np.ndarray:
        """Rows ``(row, start, band)``: stretches that share as many q-grams with a band as the lemma asks."""
        band = diagonal // self.step
        code = (row << 40) + band
        code = np.concatenate([code, code - 1])  # each band reaches over two steps
        codes, back, count = np.unique(code, return_inverse=True, return_counts=True)
        left = np.flatnonzero((count >= self.least[codes >> 40])[back])
        # Of the bands that are left, count each place of the item once only.
        place = np.unique(back[left] * (self.shift + 1) + np.tile(off, 2)[left])
        group, place = place // (self.shift + 1), place % (self.shift + 1)
        r = codes[group] >> 40
        last = np.arange(len(group)) + self.least[r] - 1
        ok = last < len(group)
        far = np.minimum(last, max(len(group) - 1, 0))
        ok &= (group[far] == group) & (place[far] - place <= self.size[r] - Q)
        r, group, near, far = r[ok], group[ok], place[ok], place[far][ok]
        low, high = np.maximum(far - (self.size[r] - Q), 0), np.minimum(near, self.length[r] - self.size[r])
        if len(low):  # both rise within a group, so ranges overlap only with the one before
            low[1:] = np.where(group[1:] == group[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        k, start = _ranges(low, np.maximum(high - low + 1, 0))
        return np.stack([r[k], start, codes[group][k] & ((1 << 40) - 1)], axis=1)

    def matches(self, docs: list[str]) -> np.ndarray:
        """Distinct rows ``(doc, row, start, end, edits)``, places in code points of the normalised texts."""
        buf, place = shortened(points("\n".join([*docs, ""])))  # no normalised text holds \n
        edge = np.append(0, np.flatnonzero(buf == 10) + 1)
        found = [np.zeros((0, 5), np.int64)]
        for hits in self.hits(buf):
            same = self.exact(*hits)
            at = same[:, 2] - self.shift + same[:, 1]
            found.append(np.unique(np.stack([same[:, 0], at, at + self.size[same[:, 0]], np.zeros_like(at)], axis=1), axis=0))
            found[-1] = np.concatenate([(np.searchsorted(edge, found[-1][:, 1], "right") - 1)[:, None], found[-1]], axis=1)
            found.append(self._near(buf, edge, same, self.regions(*hits)))
        out = np.unique(np.concatenate(found), axis=0)
        start = place[edge[out[:, 0]]]
        out[:, 2] = place[out[:, 2]] - start
        out[:, 3] = place[np.maximum(out[:, 3] - 1, 0)] + 1 - start
        return out

    def _near(self, buf: np.ndarray, edge: np.ndarray, same: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Stretches of ``todo`` that occur with edits; those with an exact occurrence in their band are left out."""
        if len(same):
            code = lambda r, s, b: ((self.base[r] + s) << 34) + b + 1
            b = same[:, 2] // self.step
            done = np.concatenate([code(same[:, 0], same[:, 1], b), code(same[:, 0], same[:, 1], b - 1)])
            todo = todo[~np.isin(code(*todo.T), done)]
        todo = todo[np.argsort(self.size[todo[:, 0]], kind="stable")]
        m, e = self.size[todo[:, 0]], self.edits[todo[:, 0]]
        low = todo[:, 2] * self.step - self.shift + todo[:, 1] - e
        high = low + 2 * self.step + m + 2 * e
        first = np.maximum(np.searchsorted(edge, np.maximum(low, 0), "right") - 1, 0)
        last = np.minimum(np.searchsorted(edge, np.minimum(high, len(buf)) - 1, "right") - 1, len(edge) - 2)
        k, doc = _ranges(first, np.maximum(last - first + 1, 0))
        a, b = np.maximum(low[k], edge[doc]), np.minimum(high[k], edge[doc + 1] - 1)
        keep = b - a >= m[k] - e[k]
        k, doc, a, b = k[keep], doc[keep], a[keep], b[keep]
        found = [np.zeros((0, 5), np.int64)]
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(m[k])) + 1):
            for i in range(0, len(part), _BATCH):
                p = part[i : i + _BATCH]
                j, size, most = k[p], int(m[k[p[0]]]), int(e[k[p[0]]])
                r = todo[j, 0]
                window = self.flat[(self.base[r] + todo[j, 1])[:, None] + np.arange(size)]
                s, t, cost = align_all(window, buf, a[p], b[p], most, 2 * (self.step + most))
                x = cost <= most
                found.append(np.stack([doc[p], r, a[p] + s, a[p] + t, cost], axis=1)[x])
        return np.concatenate(found)


def align_all(window: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``start, end, edits`` of each window (a row) inside its region ``text[a:b]``.

    An alignment may start at any of the first ``band`` places of the region and
    stays within ``most`` diagonals of its start, so only a band of the table is filled.
    Results with more than ``most`` edits say no more than that.
    """
    size, wide = window.shape[1], band + 2 * most + 1
    off = np.arange(wide) - most  # column c of row i stands at text place i + off[c]
    place = np.arange(size + wide) - most
    length = (b - a)[:, None]
    late, outside = place >= length, (place < 0) | (place >= length)
    region = np.where(outside, 0, text[np.clip(a[:, None] + place, 0, max(len(text) - 1, 0))] if len(text) else 0)
    late, outside = np.where(late, _INF, 0).astype(np.int32), np.where(outside, _INF, 0).astype(np.int32)
    cost = np.where((off >= 0) & (off <= length), off, _INF).astype(np.int32)  # the start rides below the edits
    ramp = (np.arange(wide) * _COST).astype(np.int32)
    for i in range(size):
        here = slice(i, i + wide)
        straight = cost + np.where(region[:, here] == window[:, i : i + 1], 0, _COST).astype(np.int32) + outside[:, here]
        up = late[:, here] + _COST  # the window's character is missing in the text
        up[:, :-1] += cost[:, 1:]
        up[:, -1] = _INF
        step = np.minimum(np.minimum(straight, up), _INF) - ramp
        cost = np.minimum(np.minimum.accumulate(step, axis=1) + ramp, _INF)  # a character of the text is extra
    k = cost.argmin(axis=1)
    best = cost[np.arange(len(cost)), k]
    return best % _COST, size + off[k], best // _COST


def align(window: bytes, region: bytes, most: int, band: int) -> tuple[int, int, int] | None:
    """``align_all`` for one window and region: ``(start, end, edits)``, or None beyond ``most`` edits."""
    text = np.frombuffer(region, np.uint8)
    found = align_all(np.frombuffer(window, np.uint8)[None, :], text, np.array([0]), np.array([len(text)]), most, band)
    s, t, cost = (int(x[0]) for x in found)
    return (s, t, cost) if cost <= most else None


def build_index(items: list[tuple[int, str | None]], least: int = MIN_CHARS) -> BenchmarkIndex:
    out = [(item, points(normal(text))) for item, text in items]
    return BenchmarkIndex([(item, text) for item, text in out if len(text) >= max(least, 1)])


def _place(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text itself, in code points."""
    word = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    size = [len(w) for w in text.lower().split()]
    if len(word) != len(size):
        return [(0, len(text)) for _ in spans]
    first = np.cumsum([0, *(s + 1 for s in size)])
    out = []
    for s, e in spans:
        i = min(int(np.searchsorted(first, s, "right")) - 1, len(word) - 1)
        j = min(int(np.searchsorted(first, max(s, e - 1), "right")) - 1, len(word) - 1)
        out.append((word[i][0], word[j][1]))
    return out


def _portions(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and normalised texts, about ``size`` code points at a time."""
    held, total = [], 0
    for i, t in enumerate(texts):
        held.append((i, normal(t)))
        total += len(held[-1][1])
        if total >= size or i == len(texts) - 1:
            yield [i for i, _ in held], [x for _, x in held]
            held, total = [], 0


def search(index: BenchmarkIndex, ids: list, texts: list[str | None], size: int = 1 << 19) -> Iterator[tuple]:
    """``(doc_id, item_id, start, end, edits, n_windows)`` for each text and item that match."""
    for at, docs in _portions(texts, size):
        out = index.matches(docs)
        head = np.flatnonzero(np.append(True, (out[1:, :2] != out[:-1, :2]).any(axis=1))) if len(out) else []
        for a, b in zip(head, [*head[1:], len(out)]):
            d, r = out[a, :2].tolist()
            part = out[a:b]
            spans = 1 + int((part[1:, 2:4] != part[:-1, 2:4]).any(axis=1).sum())  # rows are in order
            words = _place(texts[at[d]], [(int(part[:, 2].min()), int(part[:, 3].max()))])
            yield ids[at[d]], int(index.item[r]), *words[0], int(part[:, 4].min()), spans
        for d, text in enumerate(docs):
            for item, short in index.short:
                places = [m.start() for m in re.finditer(f"(?={re.escape(short)})", text)]
                if places:
                    words = _place(texts[at[d]], [(places[0], places[-1] + len(short))])
                    yield ids[at[d]], item, *words[0], 0, len(places)


def hold_passages(index: BenchmarkIndex, texts: list[str | None], size: int = 1 << 19) -> list[bool]:
    """Whether each text holds a passage of the index."""
    out = [False] * len(texts)
    for at, docs in _portions(texts, size):
        for d in np.unique(index.matches(docs)[:, 0]).tolist():
            out[at[d]] = True
        for d, text in enumerate(docs):
            out[at[d]] = out[at[d]] or any(short in text for _, short in index.short)
    return out


SCHEMA = "doc_id long, item_id long, start long, end long, edits long, n_windows long"


def indexes(benchmark: DataFrame, least: int = MIN_CHARS) -> Iterator:
    """Broadcast indexes of the benchmark: one, or blocks by hashed text where it would be beyond ``BLOCK_BYTES``.

    The benchmark is measured first, so what is on the driver at once has a bound. A text
    that is longer than a block is one block.
    """
    item = F.coalesce(col("item_id").cast("long"), F.lit(0))
    items = benchmark.select(item.alias("item_id"), col("text").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(chars * INDEX_BYTES // BLOCK_BYTES)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in part.toLocalIterator()], least))


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """One row for each document and benchmark item that share a passage.

    ``start`` and ``end`` are code points of the document that take in all matched
    stretches, ``edits`` the fewest edits of one, ``n_windows`` the places found (of long
    periodic runs, those in the part that is looked at). A passage counts from 128 code
    points of the item on, at any offset (or the whole shorter item), with at most 8 %
    edits. Items under ``least`` code points are left out; with ``least=1`` all take part,
    those under eight code points without edits. Null or empty texts match nothing;
    repeated rows and rows with a null doc_id are reported each. Items with a null
    item_id are reported as item 0. Other columns are ignored.

    Up to 96 MB of index are built on the driver and broadcast; a larger benchmark is cut
    in blocks of about that size, and the documents are passed over once for each block.
    """
    rows = small_batches(docs).select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    found = [rows.mapInArrow(_search(index), SCHEMA) for index in indexes(benchmark, least)]
    return reduce(DataFrame.unionByName, found)


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(search(index.value, b["doc_id"].to_pylist(), b["text"].to_pylist()))
            columns = list(zip(*got)) if got else [()] * 6
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The passages as a report: only documents that share one appear, marked not kept."""
    found = find_passages(docs, benchmark)
    return found.withColumn("contaminated", F.lit(True)).withColumn("kept", F.lit(False))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark passage, all columns kept.

    Each row is judged by its own text, whatever its doc_id; null texts stay. With a
    benchmark of several blocks the rows that are left are stored between blocks.
    """
    blocks = indexes(benchmark, least)
    out = small_batches(docs)
    out = out.where(~_holds(next(blocks))(col(text_col)))
    for index in blocks:
        out = cut(out).where(~_holds(index)(col(text_col)))
    return out


def _holds(index):
    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        found = pa.array(hold_passages(index.value, text.to_pylist()), pa.bool_())
        release()
        return found

    return holds

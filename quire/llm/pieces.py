"""SentencePiece encoding and decoding by a max-plus scan (operator 3).

The encoding of a text is the best path of a lattice whose states are "the last piece
reaches over this place". For a unigram model a step weighs the score of its piece. A
model that merges pieces by rank has no such scores, but its encoding can be recognised
locally: a sequence of pieces is the encoding of a text exactly if every two neighbours
are the encoding of their own concatenation. There a step weighs minus the number of ids
for a piece that may follow and minus infinity otherwise, which leaves one path.

A giant text is cut in chunks. Each chunk yields a transfer matrix from the states
at its first boundary to those at its last one, in the (max, +) semiring. Matrices
of neighbours combine associatively in a tree; walking the tree down fixes both
boundary states of every chunk, and each chunk then backtraces on its own. No task
sees a whole giant text after it has been cut.

Before a space mark that follows another character no piece can reach across, and
anything may follow. There all states fall together, so between the first and last
such place of a chunk only a sum is needed, and the words between are encoded once
per distinct word. Texts up to ``GIANT`` are one chunk and take that way alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, cut, portions, release, small_batches

#: Code points above which a text is cut, of a chunk, and chunks that one task combines.
GIANT, CHUNK, FAN = 32_768, 8_192, 64
MARK = "▁"
#: Entries of a task's dictionary of encoded words.
DICTIONARY = 60_000
#: Chunks whose matrices or ids a task holds at once.
AT_ONCE = 32
#: What the library takes off the lowest score for a character outside the vocabulary, and the bound of a piece's length.
UNKNOWN_PENALTY, WIDE = 10.0, 64
START = END = -1
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """A unigram or merge-rank model: its vocabulary, what pieces weigh, which may follow each other, and words already encoded."""

    def __init__(self, path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        kind, piece = model.trainer_spec.model_type, pb.ModelProto.SentencePiece
        self.unigram = kind == pb.TrainerSpec.UNIGRAM
        if kind not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) or any(p.type == piece.USER_DEFINED for p in model.pieces) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only unigram and merge-rank models with byte fallback, a leading space mark, no normalisation and no pieces of the user's are supported")
        model.normalizer_spec.add_dummy_prefix = False
        self.raw = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in normal):
            raise ValueError("a piece reaches across a space or a line")
        self.longest = max(map(len, normal))
        if self.longest >= WIDE:
            raise ValueError(f"a piece has {WIDE} characters or more")
        self.vocab = set(normal)
        if self.unigram:
            self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.NORMAL}
            self.score = {p.piece: p.score for p in model.pieces if p.type == piece.NORMAL}
            self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == pb.ModelProto.SentencePiece.BYTE else p.piece.replace(MARK, " ").encode() if p.type == pb.ModelProto.SentencePiece.NORMAL else b""
            for p in model.pieces
        ]
        self.words: dict[str, bytes] = {}
        self._ids: dict[str, tuple[int, ...] | None] = {}
        self._follows: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> tuple[int, ...] | None:
        """Ids if the string stays one piece (or one character outside the vocabulary), else null."""
        if piece not in self._ids:
            if len(self._ids) > DICTIONARY:
                self._ids.clear()
            if self.unigram and piece in self.vocab:
                got = [self.number[piece]]
            else:
                got = self.raw.encode(piece) if len(piece) == 1 or piece in self.vocab and not self.unigram else None
            self._ids[piece] = tuple(got) if got is not None and (len(piece) == 1 or len(got) == 1) else None
        return self._ids[piece]

    def weight(self, piece: str) -> float:
        """What a step over a piece weighs; ``ids`` must know it."""
        return self.score.get(piece, self.unknown) if self.unigram else -float(len(self.ids(piece)))

    def follows(self, a: str | None, b: str) -> bool:
        """Whether piece b may stand after a."""
        if a is None or self.unigram:
            return True
        key = (a, b)
        if key not in self._follows:
            if len(self._follows) > DICTIONARY:
                self._follows.clear()
            self._follows[key] = tuple(self.raw.encode(a + b)) == self.ids(a) + self.ids(b)
        return self._follows[key]

    def forget(self) -> None:
        """Drop what was learned about words and neighbours."""
        self.words.clear(), self._ids.clear(), self._follows.clear()

    def encode_words(self, texts: list[list[str]]) -> list[list[bytes]]:
        """Ids (int32, as bytes) of words of texts as ``split_words`` gives them; distinct ones are encoded once."""
        known = self.words
        if len(known) > DICTIONARY:
            known.clear()
        new = list(set().union(*texts).difference(known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = self.raw.encode([w if w[:1] in ("\n", MARK) else MARK + w for w in part], num_threads=1)
            known.update((w, array("i", x).tobytes()) for w, x in zip(part, got))
        return [list(map(known.__getitem__, words)) for words in texts]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the leading space that encoding adds."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many texts at once and where each ends; ``ends`` are those of the texts' ids, from 0 on."""
        if not hasattr(self, "_blob"):
            self._size = np.array(list(map(len, self.bytes)), np.int64)
            self._at = np.cumsum(self._size) - self._size
            self._blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        size, at = self._size[ids], self._at[ids]
        first = ends[:-1][ends[:-1] < ends[1:]]
        spaced = first[(size[first] > 0) & (self._blob[np.minimum(at[first], len(self._blob) - 1)] == 0x20)]
        size[spaced] -= 1
        at[spaced] += 1
        stop = np.cumsum(size)
        data = self._blob[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return data, np.concatenate([[0], stop])[ends]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def normal(text: str) -> str:
    return (MARK + text).replace(" ", MARK) if text else ""


def split_words(text: str) -> list[str]:
    """The text in parts that are encoded apart: a word stands for itself behind one space mark,
    a part that begins with a line feed or a mark for itself alone. No piece reaches from one into the next."""
    if not text:
        return []
    lines = text.replace("\n", " \n")
    if "  " not in lines and lines[0] != " " and lines[-1] != " " and MARK not in lines:
        return lines.split(" ")
    return _UNIT.findall(normal(text))


_SYNC = re.compile(f"[^{MARK}]{MARK}")


def syncs(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place behind ``lo`` and before ``hi`` that no piece reaches across."""
    m = _SYNC.search(text, lo, hi)
    if m is None:
        return None
    last = hi
    while True:
        last = text.rfind(MARK, lo + 1, last)
        if text[last - 1] != MARK:
            return m.start() + 1, last


class Chunk:
    """A chunk ``[lo, hi)`` of a text, which is given with enough text on both sides.

    A boundary state is ``before * WIDE + after``: the piece over (or ending at) the
    boundary starts ``before`` characters in front of it and ends ``after`` behind it.
    """

    def __init__(self, model: Pieces, text: str, lo: int, hi: int, first: bool, last: bool):
        self.m, self.text, self.lo, self.hi, self.first, self.last = model, text, lo, hi, first, last
        self.sync = syncs(text, lo, hi)

    def states(self, at: int) -> list[int]:
        """All states at a boundary inside the text."""
        out = []
        for s in range(max(0, at - self.m.longest), at):
            for e in range(at, min(len(self.text), s + self.m.longest) + 1):
                if self.m.ids(self.text[s:e]) is not None:
                    out.append((at - s) * WIDE + (e - at))
        return out

    def _walk(self, begin: list[tuple[int, int | None]], stop: int) -> tuple[dict, dict]:
        """Best paths from states ``(place, start of the last piece)`` until a piece reaches ``stop``.

        Gives, for every end state ``(start, end)``, a weight for each beginning, and the
        state before each state for each beginning.
        """
        n = len(begin)
        at: dict[int, dict[int | None, np.ndarray]] = {}
        came: dict[tuple[int, int], list] = {}
        done: dict[tuple[int, int], np.ndarray] = {}
        none = np.full(n, -np.inf)
        for k, (place, start) in enumerate(begin):
            row = at.setdefault(place, {}).setdefault(start, none.copy())
            row[k] = 0.0
            if place >= stop:
                done[(start, place)] = row
        for p in range(min(at, default=stop), stop):
            for start, value in sorted(at.pop(p, {}).items(), key=lambda x: -1 if x[0] is None else x[0]):
                before = None if start is None else self.text[start:p]
                for q in range(p + 1, min(len(self.text), p + self.m.longest) + 1):
                    piece = self.text[p:q]
                    if self.m.ids(piece) is None or not self.m.follows(before, piece):
                        continue
                    into = done if q >= stop else at.setdefault(q, {})
                    key = (p, q) if q >= stop else p
                    old = into.setdefault(key, none.copy())
                    new = value + self.m.weight(piece)
                    better = new > old
                    trace = came.setdefault((p, q), [None] * n)
                    for k in np.flatnonzero(better):
                        trace[k] = (start, p)
                    into[key] = np.maximum(old, new)
        return done, came

    def _begin(self) -> tuple[list[int], list[tuple[int, int | None]]]:
        if self.first:
            return [START], [(self.lo, None)]
        if self._at_sync(self.lo):
            return [START], [(self.lo, None)]
        names = self.states(self.lo)
        return names, [(self.lo + x % WIDE, self.lo - x // WIDE) for x in names]

    def _at_sync(self, p: int) -> bool:
        return 0 < p < len(self.text) and self.text[p] == MARK and self.text[p - 1] != MARK

    def _end(self, state: tuple[int, int]) -> int | None:
        s, e = state
        if self.last:
            return END if e == self.hi else None
        if self._at_sync(self.hi):
            return END if e == self.hi else None
        return (self.hi - s) * WIDE + (e - self.hi)

    def _units(self, lo: int, hi: int) -> list[bytes]:
        return self.m.encode_words([_UNIT.findall(self.text[lo:hi])])[0]

    def transfer(self) -> list[tuple[int, int, float]]:
        """``(state in, state out, weight)`` of the chunk's max-plus matrix."""
        names, begin = self._begin()
        if self.sync is None:
            done, _ = self._walk(begin, self.hi)
            return _best((names[k], self._end(s), float(v[k])) for s, v in done.items() if self._end(s) is not None for k in np.flatnonzero(v > -np.inf))
        a, b = self.sync
        left, _ = self._walk(begin, a)
        into = np.max([v for s, v in left.items() if s[1] == a] or [np.full(len(names), -np.inf)], axis=0)
        # Every path shares the stretch between, so any one weight does for it.
        middle = 0.0 if self.m.unigram else -float(sum(map(len, self._units(a, b))) // 4)
        right, _ = self._walk([(b, None)], self.hi)
        return _best(
            (names[k], self._end(s), float(into[k] + middle + v[0]))
            for s, v in right.items() if self._end(s) is not None and v[0] > -np.inf
            for k in np.flatnonzero(into > -np.inf)
        )

    def backtrace(self, state_in: int, state_out: int) -> bytes:
        """Ids (int32, as bytes) of the pieces that start in the chunk, on the path between two states."""
        names, begin = self._begin()
        k = names.index(state_in)
        if self.sync is None:
            return self._path([begin[k]], self.hi, state_out)
        a, b = self.sync
        return b"".join([self._path([begin[k]], a, None), *self._units(a, b), self._path([(b, None)], self.hi, state_out)])

    def _path(self, begin, stop: int, out: int | None) -> bytes:
        done, came = self._walk(begin, stop)
        ends = [s for s, v in done.items() if v[0] > -np.inf and (s[1] == stop if out is None else self._end(s) == out)]
        if not ends:
            raise ValueError("no path: the chunk and its boundary states do not belong together")
        state = max(ends, key=lambda s: done[s][0])
        ids: list[tuple[int, ...]] = []
        while state in came and came[state][0] is not None:
            ids.append(self.m.ids(self.text[state[0] : state[1]]))
            state = came[state][0]
        return np.array([i for x in reversed(ids) for i in x], np.int32).tobytes()


def _best(entries) -> list[tuple[int, int, float]]:
    """One entry, the greatest, for each pair of states."""
    best: dict[tuple[int, int], float] = {}
    for i, o, w in entries:
        best[i, o] = max(w, best.get((i, o), -np.inf))
    return [(i, o, w) for (i, o), w in best.items()]


def combine(a: list[tuple[int, int, float]], b: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Max-plus product of two sparse transfer matrices; associative."""
    by: dict[int, list[tuple[int, float]]] = {}
    for i, o, w in b:
        by.setdefault(i, []).append((o, w))
    best: dict[tuple[int, int], float] = {}
    for i, mid, w in a:
        for o, v in by.get(mid, ()):
            if best.get((i, o), -np.inf) < w + v:
                best[i, o] = w + v
    return [(i, o, w) for (i, o), w in best.items()]


def route(parts: list[list[tuple[int, int, float]]], first: int, last: int) -> list[tuple[int, int]]:
    """States in and out of each matrix on the best path from state ``first`` to ``last``."""
    value, came = {first: 0.0}, []
    for p in parts:
        new: dict[int, tuple[float, int]] = {}
        for i, o, w in p:
            if i in value and (o not in new or new[o][0] < value[i] + w):
                new[o] = (value[i] + w, i)
        came.append({o: i for o, (_, i) in new.items()})
        value = {o: v for o, (v, _) in new.items()}
    out, state = [], last
    for c in reversed(came):
        out.append((c[state], state))
        state = c[state]
    return out[::-1]


def encode_whole(model: Pieces, texts: list[str | None]) -> list[bytes]:
    """Ids (int32, as bytes) of texts that are one chunk each; null and empty give none."""
    return [b"".join(x) for x in model.encode_words([split_words(t or "") for t in texts])]


_CHUNK = "key string, k long, n long, text string, lo long, hi long"


def _cut_texts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b["key"].to_pylist(), b["text"]):
                t = normal(text.as_py())
                at = list(range(0, len(t), CHUNK))
                for i in range(0, len(at), 256):
                    rows = []
                    for p in at[i : i + 256]:
                        lo, hi = max(0, p - 2 * longest), min(len(t), p + CHUNK)
                        rows.append((key, p // CHUNK, len(at), t[lo : hi + 2 * longest], p - lo, hi - lo))
                    names = [x.split()[0] for x in _CHUNK.split(", ")]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("key", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    return run


def _slices(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch's rows, few at a time: a chunk's matrix takes many times its text as Python objects."""
    for d in it:
        for i in range(0, len(d), AT_ONCE):
            yield d.iloc[i : i + AT_ONCE]


def _matrix(path: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in _slices(it):
            rows = [Chunk(pieces(path), r.text, r.lo, r.hi, r.k == 0, r.k == r.n - 1).transfer() for r in d.itertuples()]
            yield _matrices(d[["key", "k"]], rows)
            del rows
            release()
        pieces(path).forget()
        release()

    return run


def _matrices(ids: pd.DataFrame, rows: list) -> pd.DataFrame:
    out = ids.reset_index(drop=True).copy()
    for j, c in enumerate(("ins", "outs", "weights")):
        out[c] = [[x[j] for x in r] for r in rows]
    return out


def _parts(d: pd.DataFrame) -> list[list[tuple[int, int, float]]]:
    return [list(zip(*x)) for x in zip(d["ins"], d["outs"], d["weights"])]


_MATRIX = "key string, k long, ins array<long>, outs array<long>, weights array<double>"


def _combined(fan: int):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("k")
        ids = pd.DataFrame({"key": [d["key"].iloc[0]], "k": [int(d["k"].iloc[0]) // fan]})
        return _matrices(ids, [reduce(combine, _parts(d))])

    return run


def _routed(d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("k")
    way = route(_parts(d), int(d["state_in"].iloc[0]), int(d["state_out"].iloc[0]))
    return pd.DataFrame({"key": d["key"], "k": d["k"], "state_in": [x for x, _ in way], "state_out": [x for _, x in way]})


def _traced(path: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in _slices(it):
            ids = [
                np.frombuffer(Chunk(pieces(path), r.text, r.lo, r.hi, r.k == 0, r.k == r.n - 1).backtrace(r.state_in, r.state_out), np.int32)
                for r in d.itertuples()
            ]
            yield pd.DataFrame({"key": d["key"], "k": d["k"], "ids": ids})
            release()
        pieces(path).forget()
        release()

    return run


def encode_giants(texts: DataFrame, path: str) -> DataFrame:
    """``texts(key, text)``, each key once and no text empty -> ``(key, ids array<int>)``."""
    schema = "key string, k long, state_in long, state_out long"
    chunks = texts.select("key", "text").mapInArrow(_cut_texts(pieces(path).longest), _CHUNK).repartition("key", "k")
    chunks = cut(chunks)
    levels = [cut(chunks.select("key", "k", "n", "text", "lo", "hi").mapInPandas(_matrix(path), _MATRIX))]
    most = chunks.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = levels[-1].withColumn("up", F.floor(F.col("k") / FAN)).groupBy("key", "up")
        levels.append(cut(up.applyInPandas(_combined(FAN), _MATRIX)))
        most = -(-most // FAN)
    # The top has one matrix for each text, from its start to its end.
    way = levels[-1].select("key", "k", F.lit(START).cast("long").alias("state_in"), F.lit(END).cast("long").alias("state_out"))
    for below in reversed(levels[:-1]):
        given = below.withColumn("up", F.floor(F.col("k") / FAN)).join(way.withColumnRenamed("k", "up"), ["key", "up"])
        way = given.groupBy("key", "up").applyInPandas(_routed, schema)
    traced = chunks.join(way, ["key", "k"]).mapInPandas(_traced(path), "key string, k long, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode_small(text: Column, path: str) -> Column:
    """``struct<ids, same>`` of a text of at most ``GIANT`` code points; a null text has no ids.

    ``same`` tells whether the ids, decoded, are the text again. Encoding and decoding share
    one Python worker, so a task holds one model.
    """

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = pieces(path)
        try:
            for text in batches:
                out, same = [], []
                for part in portions(text, 300_000):
                    ids = encode_whole(m, part)
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    data, stop = m.decode_all(np.frombuffer(b"".join(ids), np.int32), ends)
                    back = data.tobytes()
                    same += [back[a:b] == (t or "").encode("utf-8", "surrogatepass") for t, a, b in zip(part, stop, stop[1:])]
                    out += ids
                size = np.cumsum([0, *(len(x) // 4 for x in out)])
                values = pa.Array.from_buffers(pa.int32(), int(size[-1]), [None, pa.py_buffer(b"".join(out))])
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(size, pa.int32()), values), pa.array(same, pa.bool_())], names=["ids", "same"])
                release()
        finally:  # a worker that waits for its next task holds no dictionary
            m.forget()
            release()

    return F.arrow_udf(encoded, "struct<ids:array<int>,same:boolean>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null stays null."""

    def decoded(ids: pa.Array) -> pa.Array:
        m = pieces(path)
        flat = ids.flatten().to_numpy(zero_copy_only=False)  # without those of null arrays
        ends = np.concatenate([[0], np.cumsum([0 if n is None else n for n in pc.list_value_length(ids).to_pylist()])]).astype(np.int64)
        data, stop = m.decode_all(flat, ends)
        out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(stop.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that no encoding gives
            out = pa.array([None if x is None else m.decode(x) for x in ids.to_pylist()], pa.large_string())
        out = pc.if_else(pc.is_valid(ids), out, pa.scalar(None, pa.large_string()))
        return out.cast(pa.string())

    return F.arrow_udf(decoded, "string")(ids)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "piece_ids", same_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``out_col array<int>`` (replaced if it exists).

    ``same_col`` adds whether decoding gives the text back.

    Ids are those of the library for the whole text, without begin or end ids (for a unigram
    model, where several segmentations have the same score, one of them; the library's choice
    then hangs on the rounding of its sums). A null
    or empty text gives an empty array. Equal giant texts are encoded once.
    """
    names = [c for c in docs.columns if c not in (out_col, same_col)]
    more = [out_col, *([same_col] if same_col else [])]
    text = col(text_col)
    rows = small_batches(docs).select(*map(col, names))
    small = F.coalesce(F.length(text) <= GIANT, F.lit(True))
    few = rows.where(small).withColumn("__e", encode_small(text, path))
    few = few.withColumn(out_col, F.col("__e.ids"))
    few = (few.withColumn(same_col, F.col("__e.same")) if same_col else few).select(*map(col, [*names, *more]))
    giant = rows.where(~small).withColumn("__key", F.sha2(text, 256))
    done = encode_giants(giant.select(F.col("__key").alias("key"), text.alias("text")).dropDuplicates(["key"]), path)
    many = giant.join(done.withColumnRenamed("key", "__key").withColumnRenamed("ids", out_col), "__key")
    many = (many.withColumn(same_col, decode(col(out_col), path) == text) if same_col else many).select(*map(col, [*names, *more]))
    return few.unionByName(many)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_pieces, piece_ids, n_chunks, round_trip``.

    ``round_trip`` tells whether decoding gives the text back; it is true for null and
    empty texts and can be false only for texts that hold U+2581 itself, which the
    model cannot tell from a space. Repeated rows are encoded each; other columns are
    ignored.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    out = encode(rows, path, same_col="round_trip")
    chunks = F.when(F.length("text") <= GIANT, 1).otherwise(F.ceil((F.length("text") + 1) / CHUNK)).cast("long")
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", chunks.alias("n_chunks"), "round_trip")

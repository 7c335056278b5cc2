"""Language identification of mixed-language text (operator 7).

Training counts hashed character 1- to 4-grams of words for each language on a
bounded sample and notes which scripts a language uses. Prediction scores each
distinct word once: the script of its letters narrows the candidate languages, the
gram model scores them. A Viterbi pass over the words of a whole text, with a
penalty for each switch, labels spans; the language with most letters is the
document's. A text in which no span, nor a prefix and a suffix together, could win more
than one switch costs keeps one label, which is proved by running sums before the full
pass is spent on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, cut, has_at_most, portions, release, small_batches

#: Bound of the training sample: documents of each language, and hashed grams.
SAMPLE_PER_LANGUAGE, BUCKETS = 400, 1 << 16
#: Values of lang that are learned at most, and tasks that count their samples.
MOST_LANGUAGES, SAMPLE_TASKS = 256, 16
#: Share of a language's letters that must be in a script for it to be a candidate there.
SCRIPT_SHARE = 0.02
SWITCH_PENALTY = 14.0
#: Entries of a task's dictionary of scored words.
DICTIONARY = 200_000
GRAMS = 4
#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter; the number of its script, 0 for others."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            script[lo : hi + 1] = k
    return letter, script


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams of the words, the words they belong to, and letters and script of each word."""
    letter, script = _tables()
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    is_letter = letter[code]
    letters = np.bincount(owner, is_letter, len(words)).astype(np.int64)
    kinds = len(SCRIPTS) + 1
    votes = np.bincount(owner[is_letter] * kinds + script[code[is_letter]], minlength=len(words) * kinds).reshape(-1, kinds)
    grams, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        same = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            same = same & is_letter
        x = h[same]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append((x >> np.uint64(48)).astype(np.int64))
        owners.append(owner[: len(same)][same])
    return np.concatenate(grams), np.concatenate(owners), letters, votes.argmax(axis=1)


def _bare(word: str) -> str:
    return word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789«»¿¡„“”‚‘’–—…").lower()


@dataclass
class LanguageModel:
    """Learned gram weights (grams x languages) and the languages each script allows."""

    langs: list[str]
    weight: np.ndarray
    allowed: np.ndarray  # scripts x languages
    penalty: float = SWITCH_PENALTY
    _row: dict = field(default_factory=dict, repr=False)
    _rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_row": {}, "_rows": []}

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of every language for every word, and the words' letters."""
        gram, owner, letters, script = _grams([_bare(w) for w in words])
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.weight[gram, k], len(words))
        out *= 1.0 / GRAMS
        barred = ~self.allowed[script]
        barred[~self.allowed[script].any(axis=1)] = False
        out = np.where(barred, out.min(axis=1, keepdims=True) - 8.0, out)
        out[letters == 0] = 0.0
        return out, letters

    def forget(self) -> None:
        """Drop the scored words."""
        self._row, self._rows = {}, []

    def _lookup(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._row) > DICTIONARY:
            self.forget()
        new = list(set().union(*docs).difference(self._row))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self._row.update(zip(part, range(len(self._row), len(self._row) + len(part))))
            self._rows.append(self.scores(part))
        if len(self._rows) > 1:
            self._rows = [(np.concatenate([r[0] for r in self._rows]), np.concatenate([r[1] for r in self._rows]))]
        return self._rows[0] if self._rows else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))

    def labels(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best language of each word of each text under the switching penalty."""
        out, hard = [], []
        for s in scores:
            best = int(s.sum(axis=0).argmax())
            run = np.cumsum(s - s[:, best : best + 1], axis=0)
            low = np.minimum(np.minimum.accumulate(run, axis=0), 0.0)
            # What a stretch in another language wins over the best one, at most; a path that
            # uses the best one has a switch for each such stretch. A path that never does has one
            # fewer, but then its first stretch is a prefix and its last one a suffix.
            ends = run[:-1].max(initial=0.0) + (run[-1:] - run[:-1]).max(initial=0.0)
            if max(ends, (run[1:] - low[:-1]).max(initial=run[:1].max(initial=0.0))) > self.penalty:
                hard.append(len(out))
            out.append(np.full(len(s), best))
        hard.sort(key=lambda k: -len(out[k]))
        while hard:  # as many texts side by side as 32 MB of back pointers allow
            room = max(1, (32 << 20) // (len(out[hard[0]]) * len(self.langs)))
            now, hard = hard[:room], hard[room:]
            for k, path in zip(now, viterbi([scores[k] for k in now], self.penalty)):
                out[k] = path
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, str]]:
        """``(lang, score, spans)`` of each text; spans are ``start:end:lang``, comma-joined."""
        if not self.langs:
            yield from (("und", 0.0, "") for _ in texts)
            return
        docs = [(t or "").split() for t in texts]
        score, letters = self._lookup(docs)
        row = self._row
        at = [np.fromiter(map(row.__getitem__, words), np.int64, len(words)) for words in docs]
        some = [k for k, x in enumerate(at) if letters[x].any()]
        paths = dict(zip(some, self.labels([score[at[k]] for k in some])))
        for k, (text, x) in enumerate(zip(texts, at)):
            if k not in paths:
                yield "und", 0.0, ""
                continue
            n, path = letters[x], paths[k]
            share = np.bincount(path, n, len(self.langs))
            best = int(share.argmax())
            # Letters that the winner labels, damped where its lead over them is small.
            lead = score[x[path == best]].sum(axis=0)
            rest = np.delete(lead, best)
            sure = 1.0 if not len(rest) else 1.0 / (1.0 + np.exp(-min(50.0, lead[best] - rest.max())))
            yield self.langs[best], float(share[best] / n.sum() * sure), self._spans(text, path)

    def _spans(self, text: str, path: np.ndarray) -> str:
        cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
        if not len(cuts):
            return f"0:{len(text)}:{self.langs[path[0]]}"
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        if len(starts) != len(path):  # white space that split() and \S tell apart
            starts, at = [], 0
            for w in text.split():
                at = text.index(w, at)
                starts.append(at)
                at += len(w)
        bounds = [0, *(starts[c] for c in cuts), len(text)]
        return ",".join(f"{a}:{b}:{self.langs[path[i]]}" for a, b, i in zip(bounds, bounds[1:], [0, *cuts]))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best paths through scores (words x languages), longest text first, paying ``penalty`` for each switch.

    All texts advance together, one word at a time.
    """
    size = np.array([len(s) for s in scores])
    flat, first = np.concatenate(scores), np.cumsum(size) - size
    n, (d, k) = int(size[0]), (len(scores), flat.shape[1])
    active = np.searchsorted(-size, -np.arange(n), "left")  # texts that are longer than each place
    switch, source = np.zeros((n, d, k), bool), np.zeros((n, d), np.int32)
    v = flat[first].copy()
    for i in range(1, n):
        m = active[i]
        now = v[:m]
        j = now.argmax(axis=1)
        move = now[np.arange(m), j] - penalty
        switch[i, :m] = now < move[:, None]
        source[i, :m] = j
        v[:m] = np.maximum(now, move[:, None]) + flat[first[:m] + i]
    paths = np.empty(len(flat), np.int64)
    state = v.argmax(axis=1)
    for i in range(n - 1, -1, -1):
        m = active[i]
        paths[first[:m] + i] = state[:m]
        if i:
            state[:m] = np.where(switch[i, np.arange(m), state[:m]], source[i, :m], state[:m])
    return np.split(paths, first[1:])


_COUNTS = "lang string, grams binary, scripts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
            words = [x for x in map(_bare, (text or "").split()) if x]
            if not words:
                continue
            g, _, n, s = _grams(words)
            grams[lang] = grams.get(lang, np.zeros(BUCKETS)) + np.bincount(g, minlength=BUCKETS)
            scripts[lang] = scripts.get(lang, np.zeros(len(SCRIPTS) + 1)) + np.bincount(s, n, len(SCRIPTS) + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(grams), pa.string()), pa.array([g.tobytes() for g in grams.values()], pa.binary()), pa.array([scripts[x].tobytes() for x in grams], pa.binary())],
        names=["lang", "grams", "scripts"],
    )


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from text and lang of rows that are not held out and have a doc_id.

    At most ``per_language`` documents of each language, those whose hashed id is
    smallest, are counted on the executors, each language in one task; the driver gets
    the hashed counts of each language, 512 KB, for at most ``MOST_LANGUAGES`` values of
    lang (more raise a ValueError).
    """
    rows = docs.select(col("doc_id").alias("doc_id"), col("lang").cast("string").alias("lang"), col("text").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Null texts may be drawn; they teach nothing, and only the narrow columns are read here.
    known = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("h"))
    sizes = cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    if not has_at_most(sizes, MOST_LANGUAGES):
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    sizes = F.broadcast(sizes)
    # First about twice as many as needed by hash alone, so that no task orders a whole language.
    ids = cut(
        known.join(sizes, "lang").where(F.col("h") * F.col("n") < F.lit(2.0 * per_language * (1 << 31))).select("doc_id", "lang", "h").distinct()
        .selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k")
        .where(F.col("k") <= per_language)
        .select("doc_id", "lang")
    )
    ids = F.broadcast(ids) if has_at_most(ids, 200_000) else ids
    sample = rows.join(ids, ["doc_id", "lang"], "left_semi")
    parts = sample.select("lang", "text").repartition(SAMPLE_TASKS, "lang").mapInArrow(_count, _COUNTS).collect()
    langs = sorted({p.lang for p in parts})
    c = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
    for p in parts:
        k = langs.index(p.lang)
        c[:, k] += np.frombuffer(p.grams)
        scripts[:, k] += np.frombuffer(p.scripts)
    c += 0.5
    weight = np.log(c / c.sum(axis=0, keepdims=True)) if langs else c
    weight = weight - weight.mean(axis=1, keepdims=True) if langs else c
    return LanguageModel(langs, weight.astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True))



def identify(text: Column, model: LanguageModel, session) -> Column:
    """Column ``struct<lang_pred, score, n_spans, spans>`` of a text column."""
    shared = session.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,n_spans:bigint,spans:string>")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
        try:
            for text in batches:
                out = [[], [], [], []]
                for part in portions(text):
                    for lang, score, spans in m.predict(part):
                        for x, v in zip(out, (lang, score, spans.count(",") + 1 if spans else 0, spans)):
                            x.append(v)
                yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["lang_pred", "score", "n_spans", "spans"])
                release()
        finally:  # a worker that waits for its next task holds no dictionary
            m.forget()
            release()

    return labelled(text)


def language_id(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, n_spans, spans``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    if nothing could be learned (an empty table). A null doc_id is not held out and is
    never learned from. Columns other than doc_id, text and lang are ignored, and lang
    is read for training only.
    """
    model = model or train(docs)
    rows = small_batches(docs).select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("p")
    ).select("doc_id", "held_out", "p.*")

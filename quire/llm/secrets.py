"""Secret scan by token efficiency (operator 1).

Three base patterns find keyword assignments, access-key ids and long hexadecimal
runs. The method adds random strings that no pattern names: inside runs of key-like
characters, a stretch that a byte-level BPE vocabulary cannot shorten (few characters
per token over at least 16 characters) is reported as ``random``, so words around a key
do not dilute it. Only digests, UUIDs, time stamps and numbers are left out untested.
Prose, even invented prose, takes more characters per token than random text; plain
words are held to a lower ratio than parts with digits or capitals inside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, release, small_batches

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A stretch is random if it has fewer characters per token than this; one of words alone, fewer than the second.
MAX_CHARS_PER_TOKEN, MAX_IN_WORDS = 2.4, 2.1
MIN_RUN = 16
#: Plain words at either end of a random stretch are left out of it from this ratio on.
WORD_RATIO = 3.0
#: Hexadecimal lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PART = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STAMP = re.compile(r"[0-9]{8}T[0-9]{4,6}Z?")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _known(part: str) -> bool:
    """Whether a part is a digest or a time stamp."""
    return bool(_STAMP.fullmatch(part) or (len(part) in DIGEST_LENGTHS and _DIGEST.fullmatch(part)))


def _pieces(run: str) -> list[list[tuple[int, int]]]:
    """Places of the alphanumeric parts to test; UUIDs, digests and time stamps divide a run, numbers are passed over."""
    uuids = [m.span() for m in _UUID.finditer(run) if not run[m.start() - 1 : m.start()].isalnum() and not run[m.end() : m.end() + 1].isalnum()]
    out, k = [[]], 0
    for m in _PART.finditer(run):
        while k < len(uuids) and uuids[k][1] <= m.start():
            k += 1
        if k < len(uuids) and uuids[k][0] <= m.start() or _known(m[0]):
            out.append([])
        elif not m[0].isdigit():
            out[-1].append(m.span())
    return out


def _random(run: str, encoding, most: float) -> list[tuple[int, int]]:
    """Spans of the run whose tokens are too short, from part to part."""
    out = []
    for parts in _pieces(run):
        if sum(e - s for s, e in parts) < MIN_RUN:
            continue
        units, ratio = [], []  # (part, characters, tokens, whether a word)
        for k, (s, e) in enumerate(parts):
            word = bool(_WORD.fullmatch(run, s, e))
            tokens = encoding.encode_ordinary(run[s:e].lower() if word else run[s:e])
            ratio.append((e - s) / len(tokens) if word else 0.0)
            units += [(k, e - s, len(tokens), True)] if word else [(k, len(encoding.decode_single_token_bytes(t)), 1, False) for t in tokens]
        low, j, chars, n, mixed = set(), 0, 0, 0, 0
        for i, (k, c, t, word) in enumerate(units):
            while j < len(units) and chars < MIN_RUN:
                chars, n, mixed, j = chars + units[j][1], n + units[j][2], mixed + (not units[j][3]), j + 1
            if chars < MIN_RUN:
                break
            if chars < (most if mixed else min(most, MAX_IN_WORDS)) * n:
                low.update(range(k, units[j - 1][0] + 1))
            chars, n, mixed = chars - c, n - t, mixed - (not word)
        k = 0
        while k < len(parts):
            if k not in low:
                k += 1
                continue
            a = k
            while k < len(parts) and k in low:
                k += 1
            b = k - 1  # words at either end are not part of the key
            while a < b and ratio[a] >= WORD_RATIO and parts[b][1] - parts[a + 1][0] >= MIN_RUN:
                a += 1
            while a < b and ratio[b] >= WORD_RATIO and parts[b - 1][1] - parts[a][0] >= MIN_RUN:
                b -= 1
            out.append((parts[a][0], parts[b][1]))
    return out


def find_secrets(text: str | None, vocabulary: str, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` in code points, by start and then kind.

    A ``random`` span that overlaps a base span is left out.
    """
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    runs = list(_RUN.finditer(text))
    for r in runs:  # access keys and long hexadecimal runs lie inside such runs
        s, e = r.span()
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text, s, e) if m.end() - m.start() >= MIN_ACCESS]
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, s, e) if m.end() - m.start() >= MIN_HEX]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    starts, reach, more = [s for s, _, _ in found], list(accumulate((e for _, e, _ in found), max)), []
    for r in runs:
        if len(r[0].strip("./=-_+")) < MIN_RUN:
            continue
        spans = [(r.start() + s, r.start() + e) for s, e in _random(r[0], _encoding(vocabulary), max_chars_per_token)]
        for s, e in spans:
            k = bisect_left(starts, e)  # base spans that begin before the end of this one
            if not k or reach[k - 1] <= s:
                more.append((s, e, "random"))
    return sorted(found + more, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _by_task(batch: Callable[[pa.Array], pa.Array]):
    """A function over a task's batches that holds the vocabulary (about 150 MB) only as long as the task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from map(batch, batches)
        finally:
            _encoding.cache_clear()
            release()

    # The worker looks at the types to tell batches from single arrays.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def scan(text: Column, vocabulary: str) -> Column:
    """Column ``struct<n_assign, n_access, n_hex, n_random, base_sha256, spans>``."""

    def scanned(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            spans = find_secrets(t.as_py(), vocabulary)
            row = {f"n_{k}": sum(x[2] == k for x in spans) for k in KINDS}
            base = written([x for x in spans if x[2] != "random"])
            row |= {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": written(spans)}
            out.append(row)
        kinds = [(f"n_{k}", pa.int64()) for k in KINDS]
        return pa.array(out, pa.struct([*kinds, ("base_sha256", pa.string()), ("spans", pa.string())]))

    kind = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_random:bigint,base_sha256:string,spans:string>"
    return F.arrow_udf(_by_task(scanned), kind)(text)


def redact(text: Column, vocabulary: str, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark`` (overlapping spans by one); null stays null."""

    def redacted(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            t = t.as_py()
            at, parts = 0, []
            for s, e, _ in find_secrets(t, vocabulary):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pa.array(out, pa.string())

    return F.arrow_udf(_by_task(redacted), "string")(text)


def secret_scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the counts, ``base_sha256`` and ``spans``.

    A null or empty text has no span: zero counts, the digest of the empty string and
    an empty ``spans``. Repeated rows are scanned each; other columns are ignored.
    ``vocabulary`` is the path of a ``.tiktoken`` rank file.
    """
    return small_batches(docs).select(col(id_col).alias("doc_id"), scan(col(text_col), vocabulary).alias("s")).select("doc_id", "s.*")

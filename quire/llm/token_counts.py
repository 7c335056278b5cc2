"""Token counts without token ids (operator 10).

A text is cut at ASCII white space, where neither the normaliser nor the merges of
the vocabulary reach across. Each distinct pre-token of a task is given to the
tokeniser once; its number of pieces is kept in a dictionary, and a document's
count is the sum of frequency x pieces over its own distinct pre-tokens. Ids are
never kept. The dictionary is local to a task (a shuffle of all (document,
pre-token) pairs would move more than the texts themselves); when it has
``DICTIONARY`` entries it starts anew, which costs time but changes no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, portions, small_batches

#: Entries of a task's dictionary of pre-tokens (about 150 bytes each).
DICTIONARY = 1_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def count_tokens(path: str, texts: list[str | None], known: dict[bytes, int] | None = None) -> list[int]:
    """Number of tokens of each text; null counts as empty. ``known`` is the task's dictionary."""
    known = {} if known is None else known
    freqs = [Counter((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    out, todo, start = [], {}, 0

    def flush(end: int) -> None:
        new = list(todo)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = _tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update(zip(part, (len(e) for e in got)))
        out.extend(sum(n * known[w] for w, n in f.items()) for f in freqs[start:end])
        todo.clear()

    for i, f in enumerate(freqs):
        todo.update(dict.fromkeys(w for w in f if w not in known))
        if len(todo) >= 200_000:
            flush(i + 1)
            start = i + 1
        if len(known) > DICTIONARY:
            flush(i + 1)
            start = i + 1
            known.clear()
    flush(len(freqs))
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a tokenizer JSON file that every executor can read.
    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows are counted
    each; other columns are ignored.
    """

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for text in batches:
            out: list[int] = []
            for part in portions(text):
                out += count_tokens(vocabulary, part, known)
            yield pa.array(out, pa.int64())

    counted = F.arrow_udf(counted, "bigint")
    text = F.coalesce(col(text_col), F.lit(""))
    return (
        small_batches(docs).select(col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

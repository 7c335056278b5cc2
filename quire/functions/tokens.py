"""Counting tokens by a model's vocabulary instead of words (F1)."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t

#: How a text is divided before it is encoded, where the vocabulary does not say: contractions, letters, numbers, marks, space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        encoding = tiktoken.Encoding("pages", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"unknown vocabulary {path}; known: .tiktoken, .json, .model")


def counter(vocabulary: str | None = None, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens; words without a vocabulary.

    ``vocabulary`` is the path of a ``.tiktoken``, ``.json`` or ``.model`` file that executors
    can read. Null counts 0. Counts of joined pages are sums of the pages' counts.
    """
    if vocabulary is None:
        return t.count_tokens
    if not vocabulary.endswith((".tiktoken", ".json", ".model")):
        raise ValueError(f"unknown vocabulary {vocabulary}; known: .tiktoken, .json, .model")

    @F.arrow_udf("int")
    def counted(text: pa.Array) -> pa.Array:
        return pa.array(_encoder(vocabulary, pattern)([x or "" for x in text.to_pylist()]), pa.int32())

    return counted

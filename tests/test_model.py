"""Model tokens and the model-backed reasoner."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import tokens
from quire.plans import build
from quire.plans.model import ModelReasoner
from quire.plans.options import Options

PAGES = [(1, 1, "Contents\nAlpha .... 2\nBeta .... 3\nGamma .... 5", 9), (1, 2, "Alpha text", 2), (1, 3, "Beta here", 2), (1, 4, "more", 1), (1, 5, "  gamma  end", 2), (2, 1, "Start of two", 3), (2, 2, "nothing", 1)]


def scripted():
    """Finds contents only on a page that says so and knows headings of document 2; everything else by containment."""

    def client(prompt):
        x = json.loads(prompt.rsplit("\n", 1)[1])
        task = x["task"]
        squash = lambda s: "".join(s.lower().split())
        if task == "summary":
            return f"SUM {len(x['text'])}", "stop", {}
        if task == "heading":
            return json.dumps({"answer": "Two" if x["page"].startswith("Start") else None}), "stop", {}
        if task == "lists_contents":
            return "```json\n" + json.dumps({"answer": "yes" if "Contents" in x["page"] else "no"}) + "\n```", "stop", {}
        if task == "has_page_numbers":
            return '{"answer": "yes",}', "stop", {}
        if task == "starts_page":
            return json.dumps({"answer": "yes" if squash(x["page"]).startswith(squash(x["title"])) else "no"}), "stop", {}
        return json.dumps({"answer": "yes" if squash(x["title"]) in squash(x["page"]) else "no"}), "stop", {}

    return client


def test_index_by_scripted_model(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_no int, text string, n_tokens int")
    out = build.index_documents(pages, Options.of(summary_tokens=1), ModelReasoner(scripted)).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.title, r.start_index, r.end_index, r["mode"]) for r in out] == [
        (1, "Preface", 1, 1, None), (1, "Alpha", 2, 2, "with_page_numbers"), (1, "Beta", 3, 4, "with_page_numbers"), (1, "Gamma", 5, 5, "with_page_numbers"), (2, "Two", 1, 2, "no_contents"),
    ]
    assert all(r.summary.startswith("SUM ") for r in out)


def test_failing_model_is_no(spark):
    def broken():
        def client(prompt):
            raise OSError

        return client

    r = ModelReasoner(broken, attempts=1)
    row = spark.createDataFrame([("t", "t page")], "title string, page string").select(
        r.on_page(F.col("title"), F.col("page")).alias("a"), r.lists_contents(F.col("page")).alias("b"), r.heading(F.col("page")).alias("c"), r.summary(F.col("page")).alias("d")
    ).first()
    assert tuple(row) == (False, "no", None, "Error")


def test_token_counts_by_vocabulary(spark):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import sentencepiece
    import tiktoken

    texts = ["Hello, world!", "", None, "näher an 42 ¶ words", "a" * 500, "tabs\tand\nlines  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = lambda name: [r[0] for r in df.select(tokens.counter(P.path(name))("text")).collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got("byte_bpe_50k.tiktoken") == [len(e.encode_ordinary(t or "")) for t in texts]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert got("piece_bpe_32k.model") == [len(sp.encode(t or "")) for t in texts]
    assert [r[0] for r in df.select(tokens.counter()(F.col("text"))).collect()] == [2, 0, 0, 5, 1, 3]
    with pytest.raises(ValueError):
        tokens.counter("words.txt")

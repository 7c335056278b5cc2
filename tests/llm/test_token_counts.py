import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import token_counts
from tests.llm.corpus import edges, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return len(token_counts._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def test_edges(spark):
    texts = edges() + ["a<|endoftext|>b <|startoftext|>", "don't we'll 12345", "\x1c\x85x y İ ΑΣ ΣΑΣ"]
    out = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert (out[i].n_bytes, out[i].n_tokens) == (len((t or "").encode()), library(t))
        assert out[i].over_limit == (out[i].n_tokens > 2048)
    assert token_counts.token_counts(frame(spark, []), PATH).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in token_counts.token_counts(df, PATH).collect():
        assert r.n_tokens == library(text[r.doc_id])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert token_counts.count_tokens(PATH, [text]) == [library(text)]


def test_full_dictionary_changes_nothing(monkeypatch):
    texts = edges() * 2
    want = token_counts.count_tokens(PATH, texts)
    monkeypatch.setattr(token_counts, "DICTIONARY", 10)
    assert token_counts.count_tokens(PATH, texts) == want

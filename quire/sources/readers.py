"""Readers of pages, Markdown, stored indexes and evaluation data."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions import text as t
from quire.operators import markdown
from quire.sources import pdf


def _with_id(df: DataFrame) -> DataFrame:
    """``doc_id`` from a hash of the file's path, ``doc_name`` from its last part."""
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(t.base_name(F.url_decode(path)), r"\.[^.]*$", "")
    return df.select(F.xxhash64(path).alias("doc_id"), t.file_name(name).alias("doc_name"), "*")


def text_pages(spark: SparkSession, path: str, mark: str = "\f", tokens: Callable[[Column], Column] = t.count_tokens) -> DataFrame:
    """Pages of text files, split at form feeds: ``doc_id, doc_name, page_no, text, n_tokens`` (S1). ``tokens`` counts (F1)."""
    files = _with_id(spark.read.text(path, wholetext=True, recursiveFileLookup=True))
    pages = files.select("doc_id", "doc_name", F.posexplode(F.split("value", mark, -1)).alias("pos", "text"))
    return pages.select("doc_id", "doc_name", (F.col("pos") + 1).alias("page_no"), "text", tokens(F.col("text")).alias("n_tokens"))


def table_pages(spark: SparkSession, path: str, doc: str = "doc_id", page: str = "page_no", text: str = "text", tokens: Callable[[Column], Column] = t.count_tokens) -> DataFrame:
    """Pages that were extracted before, from Parquet."""
    df = spark.read.parquet(path)
    return df.select(F.col(doc).alias("doc_id"), F.col(page).cast("int").alias("page_no"), F.col(text).alias("text"), tokens(F.col(text)).alias("n_tokens"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Markdown files: ``doc_id, doc_name, line_num, text``."""
    files = _with_id(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md"))
    rows = files.select("doc_id", "doc_name", F.posexplode(F.split("value", "\n", -1)).alias("pos", "text"))
    return rows.select("doc_id", "doc_name", (F.col("pos") + 1).alias("line_num"), "text")


PDF_PARSERS = ("plain", "pypdf", "pymupdf")


def pdf_texts(data: bytes, parser: str = "plain") -> tuple[str, Iterator[str]]:
    """Title and page texts of a PDF in memory (S1, S2). Other parsers than ``plain`` need their library."""
    if parser not in PDF_PARSERS:
        raise ValueError(f"unknown parser {parser}; known: {', '.join(PDF_PARSERS)}")
    if parser == "plain":
        made = pdf.Pdf(data)
        return made.title(), made.pages()
    if parser == "pypdf":
        import pypdf

        doc = pypdf.PdfReader(io.BytesIO(data))
        return (doc.metadata or {}).get("/Title") or "Untitled", (p.extract_text() for p in doc.pages)
    import pymupdf

    doc = pymupdf.open(stream=data, filetype="pdf")
    return doc.metadata.get("title") or "Untitled", (p.get_text() for p in doc)


def pdf_pages(spark: SparkSession, path: str, parser: str = "plain", tokens: Callable[[Column], Column] = t.count_tokens) -> DataFrame:
    """Pages of PDF files: ``doc_id, doc_name, page_no, text, n_tokens, title``.

    Files are read by Spark, so they may lie wherever Spark can read; one is parsed in one
    task. ``title`` is that of the metadata.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return pdf_rows(_with_id(files), parser, tokens)


def pdf_rows(files: DataFrame, parser: str = "plain", tokens: Callable[[Column], Column] = t.count_tokens) -> DataFrame:
    """Pages of PDFs that are in memory, ``files(doc_id, doc_name, content)``."""
    if parser not in PDF_PARSERS:
        raise ValueError(f"unknown parser {parser}; known: {', '.join(PDF_PARSERS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            rows, size = [], 0
            for doc_id, name, data in zip(d.column(0), d.column(1), d.column(2)):
                doc_id, name = doc_id.as_py(), name.as_py()
                title, texts = pdf_texts(data.as_py(), parser)
                for i, text in enumerate(texts, 1):
                    rows.append((doc_id, name, i, text, title))
                    size += len(text)
                    if len(rows) >= 5000 or size >= 1 << 22:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)

    made = pa.schema([("doc_id", pa.int64()), ("doc_name", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("title", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), made)], schema=made)

    rows = files.select("doc_id", "doc_name", "content").mapInArrow(run, "doc_id long, doc_name string, page_no int, text string, title string")
    return rows.select("doc_id", "doc_name", "page_no", "text", tokens(F.col("text")).alias("n_tokens"), "title")


class PdfPages(DataSource):
    """``spark.read.format("quire_pdf").option("parser", "plain").load(paths)``: a row for each page.

    Paths are comma-separated and local to every executor; ``pdf_pages`` reads from any store
    (S1, S2, U2).
    """

    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return "path string, page_no int, text string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(dict(self.options))


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.parser = options.get("parser", "plain")
        if self.parser not in PDF_PARSERS:
            raise ValueError(f"unknown parser {self.parser}; known: {', '.join(PDF_PARSERS)}")
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            title, texts = pdf_texts(f.read(), self.parser)
        for i, text in enumerate(texts, 1):
            yield partition.value, i, text, title


def flatten(structure: list, doc_name: str = "") -> list[dict]:
    """Nested nodes as flat rows in pre-order."""
    rows: list[dict] = []
    todo = [(n, None, 0) for n in reversed(structure or [])]
    while todo:
        node, parent, depth = todo.pop()
        ord_ = len(rows)
        rows.append({
            "doc_name": doc_name, "ord": ord_, "parent_ord": parent, "depth": depth, "node_id": node.get("node_id"), "title": node.get("title"),
            "start_index": node.get("start_index"), "end_index": node.get("end_index"), "line_num": node.get("line_num"),
            "summary": node.get("summary") or node.get("prefix_summary"), "text": node.get("text"),
        })
        todo += [(c, ord_, depth + 1) for c in reversed(node.get("nodes") or [])]
    return rows


INDEX = "doc_name string, ord int, parent_ord int, depth int, node_id string, title string, start_index int, end_index int, line_num int, summary string, text string"


def _stored(value: str) -> list:
    """The indexes of a file's text: one, or one on each line."""
    try:
        return [json.loads(value)]
    except json.JSONDecodeError:
        return [json.loads(x) for x in value.split("\n") if x.strip()]


def index_files(spark: SparkSession, path: str, pattern: str = "*_structure.json", layout: str = "files") -> DataFrame:
    """Stored indexes as flat node rows (S6, S9); a document's tree is walked in one task.

    ``layout`` as they were written: ``files`` takes a file whole, ``lines`` its lines one at a time.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    ints = ["ord", "parent_ord", "depth", "start_index", "end_index", "line_num"]

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ints})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for d in it:
            for value in d["value"]:
                for doc in _stored(value):
                    doc = doc if isinstance(doc, dict) else {"structure": doc}
                    rows += flatten(doc.get("structure", []), doc.get("doc_name") or "")
                if len(rows) >= 5000:
                    yield table(rows)
                    rows = []
        yield table(rows)

    files = spark.read.text(path, wholetext=layout == "files", recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.mapInPandas(run, INDEX)


def file_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path`` of the files under a folder that match, in order (S9, O3). Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path").orderBy("path")


def eval_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Checked evaluation cases (S7, D11): a non-empty list, unique ids, known suites."""
    from quire.schema import EVAL_CASES

    if not cases:
        raise ValueError("no cases")
    ids = [c["case_id"] for c in cases]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise ValueError(f"case ids occur twice: {', '.join(twice)}")
    for c in cases:
        if c.get("suite") not in ("smoke", "full"):
            raise ValueError(f"unknown suite in case {c['case_id']}")
    names = [x.split()[0] for x in EVAL_CASES.split(", ")]
    return spark.createDataFrame([tuple(c.get(n) if n not in ("required_facts", "forbidden_claims") else list(c.get(n) or []) for n in names) for c in cases], EVAL_CASES)


def eval_file(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a YAML or JSON file with a ``cases`` list; read on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return eval_cases(spark, (yaml.safe_load(text) or {}).get("cases") or [])
    return eval_cases(spark, json.loads(text).get("cases") or [])


def benchmark_file(spark: SparkSession, path: str) -> DataFrame:
    """``query, expected, notes`` from a JSON list of benchmark cases."""
    df = spark.read.schema("query string, expected_nodes array<string>, notes string").json(path, multiLine=True)
    return df.select("query", F.coalesce("expected_nodes", F.expr("cast(array() AS array<string>)")).alias("expected"), "notes")

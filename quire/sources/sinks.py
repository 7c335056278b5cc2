"""Writers of indexes, logs and reports."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t

_FIELDS = ("title", "node_id", "start_index", "end_index", "line_num", "summary", "prefix_summary", "text")


def nested(rows: list[dict]) -> list[dict]:
    """Flat rows in pre-order as nested nodes; leaves have no ``nodes``, null fields go."""
    made: dict[int, dict] = {}
    roots: list[dict] = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        node = {k: r[k] for k in _FIELDS if k in r and r[k] is not None and r[k] == r[k]}
        made[r["ord"]] = node
        up = r.get("parent_ord")
        if up is None or up != up:
            roots.append(node)
        else:
            made[int(up)].setdefault("nodes", []).append(node)
    return roots


def index_json(nodes: DataFrame, descriptions: DataFrame | None = None, indent: int | None = 2) -> DataFrame:
    """``doc_id, doc_name, json``: every document's nested index (S10, D5). One document's nodes meet in one row."""
    if "doc_name" not in nodes.columns:
        nodes = nodes.withColumn("doc_name", F.col("doc_id").cast("string"))
    flat = F.struct(*(c for c in ("ord", "parent_ord", *_FIELDS) if c in nodes.columns))
    docs = nodes.groupBy("doc_id").agg(F.first("doc_name").alias("doc_name"), F.to_json(F.collect_list(flat)).alias("rows"))
    if descriptions is None:
        docs = docs.withColumn("doc_description", F.lit(None).cast("string"))
    else:
        docs = docs.join(descriptions.select("doc_id", "doc_description"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            made = []
            for name, about, rows in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), d.column(3).to_pylist()):
                doc = {"doc_name": name}
                if about is not None:
                    doc["doc_description"] = about
                doc["structure"] = nested(json.loads(rows))
                made.append(json.dumps(doc, indent=indent, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([d.column(0), d.column(1), pa.array(made, pa.string())], ["doc_id", "doc_name", "json"])

    kind = nodes.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "doc_name", "doc_description", "rows").mapInArrow(run, f"doc_id {kind}, doc_name string, json string")


LAYOUTS = ("files", "lines")


def write_index(nodes: DataFrame, path: str, descriptions: DataFrame | None = None, layout: str = "files") -> None:
    """Indexes as JSON text: ``files``, one folder ``doc_name=...`` for each document, or ``lines``, a line for each.

    Folders cost a few file operations a document, so ``lines`` is for large tables.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}; known: {', '.join(LAYOUTS)}")
    if layout == "lines":
        index_json(nodes, descriptions, None).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
        return
    docs = index_json(nodes, descriptions)
    docs.select(F.concat(t.file_name(F.col("doc_name")), F.lit("_structure")).alias("doc_name"), F.col("json").alias("value")).write.partitionBy("doc_name").mode("overwrite").text(path)


def pdf_files(pages: DataFrame) -> DataFrame:
    """``doc_id, doc_name, content``: a plain PDF of each document's pages ``(doc_id, page_no, text)``; its pages meet in one row."""
    from quire.sources import pdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            for i in range(0, d.num_rows, 200):  # files of so many documents at once
                ids = d.column(0).slice(i, 200)
                names = [str(x) for x in ids.to_pylist()]
                made = [pdf.written(texts, name) for texts, name in zip(d.column(1).slice(i, 200).to_pylist(), names)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(made, pa.binary())], ["doc_id", "doc_name", "content"])

    held = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    docs = pages.groupBy("doc_id").agg(F.transform(held, lambda x: x["text"]).alias("texts"))
    return docs.mapInArrow(run, "doc_id long, doc_name string, content binary")


def run_name(stem: str, now: datetime.datetime | None = None) -> str:
    """A file name for a run: the stem and its time, without slashes."""
    return f"{stem.replace('/', '-')}_{(now or datetime.datetime.now()).strftime('%Y%m%d_%H%M%S')}"


class RunLog:
    """An append-only log on the driver, rewritten every ``every`` entries and on close."""

    def __init__(self, path: str, every: int = 20):
        self.path, self.every, self.entries, self._open = Path(path), every, [], 0

    def add(self, entry: str | dict) -> None:
        self.entries.append({"message": entry} if isinstance(entry, str) else dict(entry))
        self._open += 1
        if self._open >= self.every:
            self.flush()

    def flush(self) -> None:
        if self._open:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self.entries, indent=2, ensure_ascii=False))
            self._open = 0

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_samples(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON, a folder for each model, case and mode."""
    results.write.partitionBy("model", "case_id", "mode").mode("overwrite").json(path)


def write_benchmark(metrics: DataFrame, path: str) -> None:
    """Benchmark results as JSON lines."""
    metrics.write.mode("overwrite").json(path)

"""Command line: index documents, search indexes, show outlines.

    python -m quire.cli index --pages PATH | --text PATH | --markdown PATH | --pdf PATH --out PATH [options]
    python -m quire.cli search --index PATH QUESTION...
    python -m quire.cli show --index PATH [--style plain|glyph|titles]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.functions.tokens import counter
from quire.operators import markdown, search, tree
from quire.plans import build
from quire.plans.options import Options
from quire.sources import readers, sinks

_FLAGS = ("add_node_id", "add_node_text", "add_node_summary", "add_doc_description")
_NUMBERS = ("toc_check_pages", "max_pages_per_node", "max_tokens_per_node", "summary_tokens")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    source = i.add_mutually_exclusive_group(required=True)
    for name in ("pages", "text", "markdown", "pdf"):
        source.add_argument(f"--{name}")
    i.add_argument("--out", required=True)
    i.add_argument("--layout", choices=sinks.LAYOUTS, help="a folder for each document or a line for each; lines by default for --pages, else files")
    i.add_argument("--thin-below", type=int)
    i.add_argument("--parser", choices=readers.PDF_PARSERS, default="plain")
    i.add_argument("--vocabulary", help="a .tiktoken, .json or .model file that counts tokens; words by default")
    for name in _FLAGS:
        i.add_argument(f"--{name.replace('_', '-')}", choices=("yes", "no"))
    for name in _NUMBERS:
        i.add_argument(f"--{name.replace('_', '-')}", type=int)
    s = sub.add_parser("search")
    s.add_argument("--index", required=True)
    s.add_argument("--top", type=int, default=search.TOP_NODES)
    s.add_argument("question", nargs="+")
    v = sub.add_parser("show")
    v.add_argument("--index", required=True)
    v.add_argument("--style", choices=("plain", "glyph", "titles"), default="plain")
    for c in (s, v):
        c.add_argument("--layout", choices=sinks.LAYOUTS, default="files", help="lines reads an index with a line for each document in portions")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    if a.command == "index":
        o = Options.of(**{n: getattr(a, n) for n in (*_FLAGS, *_NUMBERS)})
        if a.markdown:
            lines = readers.markdown_files(spark, a.markdown)
            names = lines.select("doc_id", "doc_name").distinct()
            nodes = markdown.nodes(lines.drop("doc_name"), a.thin_below, o.add_node_id)
            nodes = markdown.summarised(nodes, o.summary_tokens) if o.add_node_summary else nodes
            nodes = (nodes if o.add_node_text else nodes.drop("text")).join(names, "doc_id")
        else:
            count = counter(a.vocabulary)
            if a.pages:
                pages = readers.table_pages(spark, a.pages, tokens=count)
            else:
                pages = readers.pdf_pages(spark, a.pdf, a.parser, count) if a.pdf else readers.text_pages(spark, a.text, tokens=count)
            nodes = build.index_documents(pages, o)
            if not a.pages:
                nodes = nodes.join(pages.select("doc_id", "doc_name").distinct(), "doc_id")
        sinks.write_index(nodes, a.out, build.descriptions(nodes) if o.add_doc_description else None, a.layout or ("lines" if a.pages else "files"))
        return 0
    nodes = readers.index_files(spark, a.index, "*", a.layout)
    nodes = nodes.withColumn("doc_id", F.xxhash64("doc_name"))
    if a.command == "show":
        for r in tree.rendered(nodes, a.style).collect():
            print(r.tree)
        return 0
    q = spark.createDataFrame([(0, " ".join(a.question))], "query_id long, query string")
    best = search.search_nodes(q, nodes.withColumn("text", F.coalesce("text", "summary")), a.top)
    shown = best.join(nodes.select("doc_id", "node_id", "doc_name", "title", "start_index", "end_index"), ["doc_id", "node_id"]).orderBy("rank")
    for r in shown.collect():
        print(f"{r['rank']}. {r.doc_name} [{r.node_id}] {r.title} (p{r.start_index}-{r.end_index})")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

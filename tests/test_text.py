import json
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t


def column(spark, values, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space(spark):
    v = ["  a  b\n\tc ", "", " x ", None]
    assert column(spark, v, t.strip) == [None if x is None else x.strip() for x in v]
    assert column(spark, v, t.collapse) == [" ".join((x or "").split()) for x in v]
    assert column(spark, ["A b C"], t.squash) == ["abc"]
    assert column(spark, v, t.count_tokens) == [len((x or "").split()) for x in v]


def test_excerpts(spark):
    long = "word " * 60
    assert column(spark, [long, "short", None], lambda c: t.excerpt(c, 20)) == ["word word word wo...", "short", ""]
    assert column(spark, ["x" * 41, "x" * 40], t.shorten) == ["x" * 40 + "...", "x" * 40]


def test_page_tags(spark):
    assert column(spark, ["<physical_index_5>", "physical_index_7", "other", "<physical_index_x>", None, ""], t.physical_index) == [5, 7, None, None, None, None]
    assert column(spark, ["5", " 6 ", "N/A", None, "3.5"], t.page_number) == [5, 6, None, None, None]


def test_dot_leaders(spark):
    assert column(spark, ["Intro.......5", "Intro . . . . . . 5", "a....b", "x"], t.dot_leaders) == ["Intro: 5", "Intro : 5", "a....b", "x"]


def test_headings(spark):
    v = ["# A", "###   B c ", "####### no", "#no", "  ## indented", "## ", None]
    assert column(spark, v, t.heading_level) == [1, 3, None, None, None, None, None]
    assert column(spark, v[:2], t.heading_title) == ["A", "B c"]


REPLIES = ['{"a": 1}', 'say ```json\n{"a": [1,\n 2]}\n``` bye', '{"a": None}', '{"a": [1, 2,],}', "```json {\"a\": 1}", "garbage", "[1, 2]", ""]


def literal(reply):
    at = reply.find("```json")
    body = reply[at + 7 : reply.rfind("```")].strip() if at >= 0 else reply.strip()
    body = " ".join(body.replace("None", "null").split())
    for text in (body, re.sub(r",([\]}])", r"\1", body)):
        try:
            return json.loads(text)
        except ValueError:
            pass
    return {}


def test_json_repair(spark):
    got = column(spark, REPLIES, t.repaired_json)
    assert [json.loads(x) for x in got] == [literal(x) for x in REPLIES]


def test_sections_and_tags(spark):
    assert column(spark, ["a<s>b<s>c<s>d<s>", "a<s>b", "x"], lambda c: t.drop_first_section(c, F.lit("<s>"))) == ["ac<s>d<s>", "a<s>b", "x"]
    assert column(spark, ["<start_index_3> <start_index_9>", "none"], t.first_start_tag) == [3, -1]
    assert column(spark, ["<start_index_3> <start_index_9>", "none"], t.last_start_tag) == [9, -1]


def test_markdown_table():
    assert t.markdown_table(["a", "b"], [["1", "2"]]) == "| a | b |\n| --- | --- |\n| 1 | 2 |"


@pytest.mark.parametrize("given, error", [({"nope": 1}, ValueError), ({"chunk_tokens": "5"}, TypeError), ({"add_node_id": 3}, TypeError)])
def test_options_reject(given, error):
    from quire.plans.options import Options

    with pytest.raises(error):
        Options.of(**given)


def test_options_merge():
    from quire.plans.options import Options

    o = Options.of(add_node_text="yes", chunk_tokens=5, fix_rounds=None)
    assert (o.add_node_text, o.chunk_tokens, o.fix_rounds, o.add_doc_description) == (True, 5, 3, False)

"""Scalar text functions as columns. All null-safe: null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "physical_index"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends; null gives '' (F9)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def squash(c: Column) -> Column:
    """Lower case without any white space: how titles are looked for on pages."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def excerpt(c: Column, limit: int = 220) -> Column:
    """Collapsed text; beyond ``limit`` code points cut to fit with three dots."""
    x = collapse(c)
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.left(x, F.lit(limit - 3))), F.lit("..."))).otherwise(x)


def shorten(c: Column, limit: int = 40) -> Column:
    """Cut for display: the first ``limit`` code points and three dots."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def count_tokens(c: Column) -> Column:
    """Number of words: the default tokenizer, additive over joined texts (F1). Null counts 0."""
    return F.size(words(c)).cast("int")


def physical_index(c: Column) -> Column:
    """``<physical_index_N>`` or ``physical_index_N`` as a number, other strings as null (F2)."""
    return F.regexp_extract(c, rf"^<?{TAG}_(?:.*_)?\s*(\d+)\s*>*\s*$", 1).try_cast("int")


def page_number(c: Column) -> Column:
    """A printed page as a number where it is one."""
    return c.try_cast("int")


def add_offset(page_num: Column, offset: Column) -> Column:
    """Physical page of a printed one (F4); null where either is unknown."""
    return page_num + offset


def dot_leaders(c: Column) -> Column:
    """Dot leaders of contents lines as a colon."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def heading_level(line: Column) -> Column:
    """Level 1 to 6 of a Markdown heading that begins its line, else null (F8)."""
    n = F.length(F.regexp_extract(line, r"^(#{1,6})", 1))
    return F.when(strip(line).rlike(r"(?U)^#{1,6}\s+.+$") & (n > 0), n)


def heading_title(line: Column) -> Column:
    return strip(F.regexp_extract(strip(line), r"(?U)^#{1,6}\s+(.+)$", 1))


def is_fence(line: Column) -> Column:
    return strip(line).startswith("```")


def file_name(c: Column) -> Column:
    """A name that can be a file: slashes replaced."""
    return F.replace(c, F.lit("/"), F.lit("-"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def drop_first_section(c: Column, tag: Column) -> Column:
    """Without the first part from a tag to its next occurrence, both included."""
    first = F.instr(c, tag)
    rest = F.substr(c, first + F.length(tag))
    second = F.instr(rest, tag)
    cut = F.concat(F.substr(c, F.lit(1), first - 1), F.substr(rest, second + F.length(tag)))
    return F.when((first > 0) & (second > 0), cut).otherwise(c)


def first_start_tag(c: Column) -> Column:
    """Number of the first ``<start_index_N>`` tag, -1 without any."""
    return F.coalesce(F.regexp_extract(c, r"<start_index_(\d+)>", 1).try_cast("int"), F.lit(-1))


def last_start_tag(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"<start_index_(\d+)>"), F.lit(1)), F.lit(-1)).try_cast("int"), F.lit(-1))


#: The last fence and all behind it.
LAST_FENCE = r"(?s)```(?!.*```).*$"


def fenced(c: Column) -> Column:
    """What a json fence holds: after the first opening, up to the last fence, stripped."""
    at = F.instr(c, F.lit("```json"))
    body = F.when(at > 0, F.substr(c, at + 7)).otherwise(c)
    return strip(F.regexp_replace(body, LAST_FENCE, ""))


def repaired_json(c: Column) -> Column:
    """A model's reply as JSON text, ``{}`` where it cannot be repaired.

    The fence is cut, ``None`` becomes ``null``, white space collapses; if that does not
    parse, commas before a closing bracket go. An opening fence without a closing one
    leaves nothing.
    """
    at = F.instr(c, F.lit("```json"))
    body = F.substr(c, at + 7)
    inside = F.when(F.contains(body, F.lit("```")), F.regexp_replace(body, LAST_FENCE, "")).otherwise(F.lit(""))
    text = collapse(F.replace(F.when(at > 0, inside).otherwise(c), F.lit("None"), F.lit("null")))
    fixed = F.replace(F.replace(text, F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))

    def valid(x: Column) -> Column:
        return F.try_parse_json(x).isNotNull() & (x != "")

    return F.when(valid(text), text).when(valid(fixed), fixed).otherwise(F.lit("{}"))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def three_places(c: Column) -> Column:
    return F.format_string("%.3f", c)


def seconds(c: Column) -> Column:
    return F.format_string("%.2f", c)


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    """A Markdown table; rendered on the driver for small reports."""
    lines = [headers, ["---"] * len(headers), *rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in lines)

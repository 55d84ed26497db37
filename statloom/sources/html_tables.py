"""Tables and lists out of raw pages, with native string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def plain_text(markup: Column) -> Column:
    """Markup to text: tags go, the common entities are decoded, blanks are squeezed."""
    out = F.regexp_replace(markup, "(?s)<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def _elements(text: Column, tag: str, enclosing: str) -> Column:
    """(tag, body) of the elements of a tag in order. An element ends with its own end tag, with the next one, or with the text; elements of
    the enclosing tag end it too."""
    start = F.regexp_extract_all(text, F.lit(rf"(?is)<({tag})\b[^>]*>"), F.lit(1))
    body = F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)(?=<(?:{tag}|{enclosing})\b|</(?:{tag}|{enclosing})\s*>|\z)"), F.lit(1))
    return F.arrays_zip(start.alias("tag"), body.alias("body"))


def containers(html: Column, container: str = "table", row: str = "tr", cell: str = "t[dh]") -> Column:
    """(open, body) of every element of a container tag in order of its start tag, nested ones included.

    The text is cut at the container's tags and the depth is counted along the pieces. What lies deeper than a container is in its body without its
    container, row and cell tags: a table in a cell is text of that cell and leaves the outer rows whole. Unclosed ones end with the text.
    """
    pieces = F.split(F.regexp_replace(html, _UNSEEN, " "), rf"(?i)(?=</?{container}\b)")
    opens = rf"(?is)^<{container}\b.*"
    closes = rf"(?is)^</{container}\b.*"
    counted = F.aggregate(
        pieces, F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("depths")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p.rlike(opens), 1).when(p.rlike(closes) & (s["depth"] > 0), -1).otherwise(0)).alias("depth"),
            F.array_append(s["depths"], s["depth"] + F.when(p.rlike(opens), 1).when(p.rlike(closes) & (s["depth"] > 0), -1).otherwise(0)).alias("depths")),
        lambda s: F.arrays_zip(pieces.alias("text"), s["depths"].alias("depth")))
    inner = rf"(?is)</?(?:{container}|{row}|{cell})\b[^>]*>"

    def body(all_pieces: Column, i: Column, own: Column) -> Column:
        later = F.slice(all_pieces, i + 2, F.greatest(F.size(all_pieces) - i - 1, F.lit(0)))
        end = F.array_position(F.transform(later, lambda p: p["depth"] < own), F.lit(True)).cast("int")
        held = F.slice(later, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(later)))
        close = rf"(?is)^</?{container}\b[^>]*>"
        return F.concat(F.regexp_replace(F.get(all_pieces, i)["text"], close, ""), F.array_join(F.transform(held, lambda p: F.when(
            p["depth"] == own, F.regexp_replace(p["text"], close, " ")).otherwise(F.regexp_replace(p["text"], inner, " "))), ""))

    # one array of one element: the pieces are made once
    return F.flatten(F.transform(F.array(counted), lambda ps: F.filter(
        F.transform(ps, lambda p, i: F.when(p["text"].rlike(opens), F.struct(i.alias("open"), body(ps, i, p["depth"]).alias("body")))), lambda b: b.isNotNull())))


def container_rows(html: Column, container: str = "table", row: str = "tr", cell: str = "t[dh]") -> Column:
    """Rows of the container with most of them (the first of equals): arrays of (tag, text) cells; null without one."""
    found = F.transform(containers(html, container, row, cell), lambda c: F.struct(
        F.size(F.regexp_extract_all(c["body"], F.lit(rf"(?is)<({row})\b[^>]*>"), F.lit(1))).alias("n"), (-c["open"]).alias("order"), c["body"].alias("body")))
    rows = F.transform(F.array(F.array_max(found)["body"]), lambda b: F.transform(_elements(b, row, container), lambda r: F.transform(
        _elements(r["body"], cell, row), lambda c: F.struct(F.lower(c["tag"]).alias("tag"), plain_text(c["body"]).alias("text")))))
    return F.when(F.size(found) > 0, F.get(rows, F.lit(0)))


def block_rows(pages: DataFrame, ids: list[str], html: str, container: str = "table", row: str = "tr",
               cell: str = "t[dh]") -> DataFrame:
    """(ids, row_no, cells) of the largest block of each page, empty rows left out. Nothing is shuffled."""
    made = pages.select(*ids, F.explode(F.array(container_rows(F.col(html), container, row, cell))).alias("__rows"))
    rows = made.select(*ids, F.posexplode_outer("__rows").alias("row_no", "__cells"))
    return rows.filter(F.size("__cells") > 0).select(*ids, "row_no", F.transform("__cells", lambda c: c["text"]).alias("cells"))


def table_records(pages: DataFrame, ids: list[str], html: str) -> DataFrame:
    """(ids, row_no, record map) of the largest table: stacked header rows become one header, repeated ones go.

    A header row holds <th> cells only and stands before the first data row. Header and rows come from one reading of the page.
    """
    made = pages.select(*ids, F.explode(F.array(container_rows(F.col(html)))).alias("__rows")).filter(F.col("__rows").isNotNull())

    def has_data(r: Column) -> Column:
        return F.exists(r, lambda c: c["tag"] == "td")

    data_from = F.array_position(F.transform("__rows", has_data), F.lit(True)).cast("int")
    texts = F.transform(F.filter(F.slice("__rows", F.lit(1), F.greatest(data_from - 1, F.lit(0))), lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: c["text"]))
    headed = made.select(*ids, "__rows", F.explode(F.array(texts)).alias("__heads"))
    width = F.array_max(F.transform("__heads", F.size))
    header = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.trim(F.array_join(F.transform("__heads", lambda c: F.coalesce(F.get(c, i), F.lit(""))), " ")))
    named = headed.select(*ids, "__rows", "__heads", F.explode(F.array(F.when(width > 0, header))).alias("header"))
    rows = named.select(*ids, "header", "__heads", F.posexplode("__rows").alias("row_no", "__cells"))
    cells = F.transform("__cells", lambda c: c["text"])
    body = rows.filter(has_data(F.col("__cells")) & ~F.array_contains("__heads", cells) & (cells != F.col("header")))
    full = F.transform("header", lambda h, i: F.struct(h, F.get(cells, i)))
    return body.select(*ids, "row_no", F.map_from_entries(full).alias("record"))

"""Paragraphs out of positioned page elements: lines, columns, line kinds, paragraphs, words put together.

Elements are rows (page, column, top, left, right, size, kind, text).  Lines, kinds
and paragraphs run over windows: those of lines inside a column of a page, the others inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaria.functions import preserve
from lexaria.functions.batches import column_of

#: Distance of tops up to which elements are on one line, and of a gap that is a space.
SAME_LINE, GAP = 4.0, 2.0


def _line_starts(tops: Column) -> Column:
    """Of sorted tops, those at which a line begins: a line has all tops within SAME_LINE of its first."""
    new = lambda starts, top: (F.size(starts) == 0) | (top - F.element_at(starts, -1) > SAME_LINE)
    return F.aggregate(tops, F.array().cast("array<double>"), lambda starts, top: F.when(new(starts, top), F.concat(starts, F.array(top))).otherwise(starts))


def _joined(parts: Column) -> Column:
    """Texts of parts from left to right, with a space where there is a gap and neither side has one."""

    def piece(part: Column, i: Column) -> Column:
        last = F.get(parts, i - 1)
        gap = (i > 0) & (part["left"] - last["right"] > GAP) & ~last["text"].endswith(" ") & ~part["text"].startswith(" ")
        return F.concat(F.when(gap, " ").otherwise(""), part["text"])

    return F.array_join(F.transform(parts, piece), "")


def _main_size(parts: Column) -> Column:
    """The size that most characters of a line have; of equal ones the one further left."""
    chars = lambda size: F.aggregate(F.filter(parts, lambda p: p["size"].eqNullSafe(size)), F.lit(0), lambda n, p: n + F.length(F.trim(p["text"])))
    sizes = F.array_distinct(F.transform(parts, lambda p: p["size"]))
    return F.array_max(F.transform(sizes, lambda size, i: F.struct(chars(size).alias("n"), (-i).alias("place"), size.alias("size"))))["size"]


def page_lines(elements: DataFrame) -> DataFrame:
    """doc, page, col, top, left, size, bold, kinds, text: the lines of each page, from windows over its columns; a text printed twice at one place counts once."""
    place = ["doc", "page", "col"]
    tops = F.array_sort(F.collect_set(F.col("top").cast("double")).over(Window.partitionBy(*place)))
    rows = elements.select(*place, "top", "left", "right", "size", "kind", "text").withColumn("starts", _line_starts(tops))
    rows = rows.withColumn("line", F.array_max(F.filter("starts", lambda s: s <= F.col("top")))).drop("starts")
    part = F.struct("left", "right", "text", "size", F.col("top").alias("own"))
    lines = rows.groupBy(*place, F.col("line").alias("top")).agg(
        F.min("left").alias("left"), F.array_sort(F.collect_set(part)).alias("parts"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )
    lines = lines.select(*place, "top", "left", _main_size(F.col("parts")).alias("size"), F.col("kinds").eqNullSafe(F.array(F.lit("bold"))).alias("bold"), "kinds", F.trim(_joined(F.col("parts"))).alias("text"))
    odd = F.col("text").rlike("[" + "".join(preserve.ACCENTS) + "]")
    return lines.withColumn("text", F.when(odd, column_of(preserve.fix_accents, "string")("text")).otherwise(F.col("text")))


def line_kinds(lines: DataFrame, body: float, title: float) -> DataFrame:
    """Lines with their kind: title (large, on the first page), heading (bold or numbered), abstract, body, or end (from the references on).

    What holds from a line on is the last marker at or before it.
    """
    w = Window.partitionBy("doc").orderBy("page", "col", "top").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lower("text")
    marker = F.when(low.rlike("^abstract"), "abstract").when(low.rlike(r"^(\d+\.?\s+)?(references|bibliography)$"), "end").when(
        F.col("text").rlike(r"^\d+(\.\d+)*\.?\s+\p{Lu}") & F.col("bold"), "body"
    )
    state = F.coalesce(F.last(marker, True).over(w), F.lit("front"))
    drawn = F.array_contains("kinds", "figure") | (F.size(F.array_except("kinds", F.array(F.lit("math")))) == 0) if "kinds" in lines.columns else F.lit(False)
    kind = F.when(state == "end", "end").when(drawn, "drop").when(
        (F.col("page") == 1) & (state == "front") & (F.col("size") >= title), "title"
    ).when(F.col("bold") | low.rlike("^abstract$"), "heading").when(state == "abstract", "abstract").when((state == "body") & (F.abs(F.col("size") - body) <= 1), "body")
    return lines.withColumn("kind", F.coalesce(kind, F.lit("drop")))


def column_edge(lines: DataFrame) -> DataFrame:
    """doc, col, edge: the most frequent left of a column's body lines, the smaller of equals."""
    c = lines.filter("kind IN ('body', 'abstract')").groupBy("doc", "col", F.round("left").alias("l")).agg(F.count("*").alias("n"))
    return c.groupBy("doc", "col").agg(F.max(F.struct("n", (-F.col("l")).alias("low"))).alias("b")).select("doc", "col", (-F.col("b.low")).alias("edge"))


def paragraphs(lines: DataFrame, indent: float = 5.0) -> DataFrame:
    """doc, place, text: body lines put together; a paragraph starts after another kind, or where a line is indented against its column's edge.

    A line that ends in a hyphen goes on without a space.
    """
    rows = lines.join(column_edge(lines), ["doc", "col"], "left")
    w = Window.partitionBy("doc").orderBy("page", "col", "top")
    kept = F.col("kind").isin("body", "abstract")
    start = F.when(
        ~F.coalesce(F.lag(kept).over(w), F.lit(False)) | (F.lag("kind").over(w) != F.col("kind")) | (F.col("left") - F.coalesce("edge", "left") > indent),
        1
    ).otherwise(0)
    rows = rows.withColumns({"kept": kept, "start": start}).filter("kept")
    rows = rows.withColumn("place", F.sum("start").over(Window.partitionBy("doc").orderBy("page", "col", "top")))
    parts = rows.groupBy("doc", "place").agg(F.array_sort(F.collect_list(F.struct("page", "col", "top", "text"))).alias("x"))
    return parts.select("doc", F.col("place").cast("long").alias("place"), _dehyphenated(F.transform("x", lambda r: r["text"])).alias("text"))


def _dehyphenated(texts: Column) -> Column:
    """Lines joined by spaces, words broken by a hyphen put together."""
    return F.regexp_replace(F.regexp_replace(F.array_join(texts, "\n"), r"([a-z])-\n([a-z])", "$1$2"), "\n", " ")


def attributed_cases(cases: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Cases whose target stands exactly at its offsets; any other fails the read, with its id."""
    at = F.substring(F.col("text"), F.col(start) + 1, F.col(end) - F.col(start))
    good = (F.col(start) >= 0) & (F.col(end) <= F.length("text")) & (at == F.col("target")) & F.col("source").isNotNull()
    return cases.withColumn(
        "target",
        F.when(F.coalesce(good, F.lit(False)), F.col("target")).otherwise(
            F.raise_error(F.concat(F.lit("case "), F.col("id").cast("string"), F.lit(" isn't at its offsets or has no source")))
        )
    )


def numbered_heading(text: str) -> bool:
    return bool(re.match(r"\d+(\.\d+)*\.?\s+[A-Z]", text))

"""Positioned text out of XML that a PDF tool made: pages, fonts and pieces of text as rows of elements.

Files are cut at their pages by Spark's XML source, so a long document is read by
several tasks.  Two schemas are read of each page: one with the attributes of the text
elements, one with what they hold (mark-up inside them included); both lists have the elements
in the order of the page and are zipped.  A font may be declared on an earlier page, so
fonts are joined by document and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTES = "_number long, _width double, fontspec array<struct<_id:string,_size:double,_family:string>>, text array<struct<_top:double,_left:double,_width:double,_font:string>>"
_CONTENT = "_number long, text array<string>"
# How families of fonts begin, or what their names hold, by kind.
FIGURE, MATH, BOLD = ("DejaVu",), ("CMMI", "CMR", "CMSY", "CMEX"), ("Medi", "Bold")


def kind_of(family: Column) -> Column:
    """figure, math, bold or plain."""
    name = F.substring_index(family, "+", -1)
    starts = lambda heads: F.greatest(*(name.startswith(h) for h in heads), F.lit(False))
    return F.when(starts(FIGURE), "figure").when(starts(MATH), "math").when(name.rlike("|".join(BOLD)), "bold").otherwise("plain")


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("mode", "FAILFAST").schema(schema).load(path)
    return read.select(F.col("_metadata.file_path").alias("doc"), "*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, col, top, left, right, size, kind, text of every element that isn't blank; doc is the file's path.

    An element right of a page's middle is in column 1. One whose font was never declared has no size and is plain.
    """
    pages, held = _pages(spark, path, _ATTRIBUTES), _pages(spark, path, _CONTENT)
    fonts = pages.select("doc", F.explode("fontspec").alias("f")).select("doc", F.col("f._id").alias("font"), F.col("f._size").alias("size"), kind_of(F.col("f._family")).alias("kind"))
    fonts = fonts.dropDuplicates(["doc", "font"])
    both = pages.select("doc", "_number", "_width", F.col("text").alias("place")).join(held.select("doc", "_number", "text"), ["doc", "_number"])
    rows = both.select("doc", F.col("_number").alias("page"), (F.col("_width") / 2).alias("middle"), F.explode(F.arrays_zip("place", "text")).alias("e"))
    bare = F.regexp_replace("e.text", r"</?(?:a|b|i|u|sub|sup)(?:\s[^>]*)?>", "")
    left = F.col("e.place._left")
    rows = rows.select(
        "doc", "page", (left > F.col("middle")).cast("long").alias("col"), F.col("e.place._top").alias("top"), left.alias("left"),
        (left + F.col("e.place._width")).alias("right"), F.col("e.place._font").alias("font"), bare.alias("text")
    )
    return rows.filter(F.btrim("text") != "").join(fonts, ["doc", "font"], "left").select(
        "doc", "page", "col", "top", "left", "right", "size", F.coalesce("kind", F.lit("plain")).alias("kind"), "text"
    )

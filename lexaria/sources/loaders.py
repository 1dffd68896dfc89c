"""Scans of text formats, strict and lenient."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaria.functions import preserve
from lexaria.functions.batches import column_of


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, anything else that is no such object is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same, but a missing file has no rows and bad lines are left out."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_tsv(spark: SparkSession, path: str, names: dict[int, str], least: int) -> DataFrame:
    """Lines cut at tabs, quotes as they are; lines with fewer fields than least are left out."""
    fields = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(fields) >= least).select(*(fields[i].alias(n) for i, n in names.items()))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header that must have these columns."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df


# Elements that begin and end blocks, that hide what they hold, and that hold nothing.
BLOCK = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "section", "dd", "dt", "center", "font_break"}
HIDDEN = {"table", "style", "script", "sup", "ix:header", "math", "figure", "noscript"}
VOID = {"br", "img", "hr", "meta", "link", "input"}


class _Events(HTMLParser):
    """A page as a list of (kind, name or text, attributes): kinds are 'open', 'close' and 'text'."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict[str, str]]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


def blocks_of(page: str, only_p: bool = False, skip_classes: tuple[str, ...] = ()) -> list[str]:
    """Texts between the tags of block elements; what lies in hidden elements is left out.

    An end tag closes the innermost open element, whatever its name; where paragraphs
    alone are asked for, more of them must have begun than ended.
    """
    events, avoid = _Events(page).events, set(skip_classes)
    # whether each open element hides its text, the page itself first
    path, shown = [False], []
    for kind, name, attributes in events:
        shown.append(not path[-1])
        if kind == "open" and name not in VOID:
            styled = "display:none" in re.sub(" ", "", attributes.get("style", "")).lower()
            path.append(path[-1] or name in HIDDEN or styled or bool(avoid & set(attributes.get("class", "").split())))
        elif kind == "close" and name not in VOID and len(path) > 1:
            path.pop()
    step = {("open", "p"): 1, ("close", "p"): -1}
    depth = accumulate(step.get(e[:2], 0) for e in events)
    cuts = accumulate(kind != "text" and name in BLOCK and (kind == "open" or name not in VOID) for kind, name, _ in events)
    blocks: dict[int, list[str]] = {}
    for (kind, text, _), block, see, inside in zip(events, cuts, shown, depth, strict=True):
        if kind == "text" and see and (inside > 0 or not only_p):
            blocks.setdefault(block, []).append(text)
    return [x for parts in blocks.values() if (x := preserve.clean("".join(parts)))]


def html_blocks(html: Column, only_p: bool = False, skip_classes: tuple[str, ...] = ()) -> Column:
    """Blocks of text of a page, of paragraphs only if asked; elements of the classes given are left out."""
    return column_of(lambda page: blocks_of(page, only_p, skip_classes), "array<string>")(F.coalesce(html, F.lit("")))

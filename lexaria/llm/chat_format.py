"""Chat formatting with Spark expressions only.

Rows are collected per conversation and sorted by turn (ties by role, then
text).  Adjacent rows of one role are merged into one block by array functions: the
places where the role changes cut the sorted array into slices, and each slice is
aggregated into its role and texts.  Control strings inside texts and roles are
escaped, so the block can be split into the very same rows again:

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_next|>TEXT ...]<|im_end|>\\n

Escaping: a backslash is doubled, ``<|`` becomes ``<\\|``.  No control string
can then come from a text.  ``mask`` has one struct for each row whose text counts for
the loss: where the escaped text begins and how long it is, in bytes of the formatted
text's UTF-8 (a cut by bytes needs no walk from the start), and its code points.  The
loss text is cut out of the formatted text by this mask alone.

Definitions: null roles and texts are empty strings; a null turn sorts first; a
null conversation id is a conversation of its own; repeated rows all stay; an
empty table gives an empty result; whole texts are formatted.  Only the four named
columns are read; others may have any name.  All steps but the sort are linear in the
bytes of a conversation; it is one value of the result, so its rows meet in one
task by definition (collect_list combines on the map side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """df with a value worked out once: behind a generator the optimizer doesn't put it into the lambdas that use it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


#: Sizes added up at a time when positions are worked out.
RUN = 256


def _starts(sizes: Column) -> Column:
    """Sum of the sizes before each place; by runs, so that long arrays don't cost their square."""
    zero, add = F.lit(0).cast("long"), lambda a, x: a + x
    runs = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))
    whole = F.transform(runs, lambda g: F.aggregate(F.slice(sizes, g * RUN + 1, RUN), zero, add))
    before = F.transform(runs, lambda g: F.aggregate(F.slice(whole, F.lit(1), g), zero, add))
    place = lambda i: F.floor(i / RUN).cast("int")
    # the array of runs is a variable of the outer lambda, so that it is made once
    return F.flatten(
        F.transform(
            F.array(before),
            lambda b: F.transform(sizes, lambda _, i: F.get(b, place(i)) + F.aggregate(F.slice(sizes, place(i) * RUN + 1, i % RUN), zero, add))
        )
    )


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """conv_id, formatted, mask: one row for each conversation."""
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    grouped = rows.select(F.col(conv_col).alias("conv_id"), one.alias("r")).groupBy("conv_id").agg(F.collect_list("r").alias("t"))
    turns = _once(grouped, F.sort_array("t"), "t", "conv_id")
    # where blocks begin, and the end of the last
    changes = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | ~F.get("t", i - 1)["role"].eqNullSafe(F.get("t", i)["role"]))
    cut = _once(turns, F.concat(changes, F.array(F.size("t"))), "cut", "conv_id", "t")

    def block(i: Column, k: Column) -> Column:
        own = F.slice("t", i + 1, F.get("cut", k + 1) - i)
        return F.struct(F.get("t", i)["role"].alias("role"), F.transform(own, lambda x: escape(x["text"])).alias("texts"))

    blocks = _once(cut, F.transform(F.slice("cut", F.lit(1), F.size("cut") - 1), block), "b", "conv_id")

    def pieces(b: Column) -> Column:
        """What stands before each text of a block, and the text."""
        head = F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
        return F.transform(
            b["texts"], lambda x,
            i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("before"), x.alias("body"),
                F.when(i == F.size(b["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"), (b["role"] == loss_role).alias("loss")
            )
        )

    parts = _once(blocks, F.flatten(F.transform("b", pieces)), "p", "conv_id")
    sized = _once(
        parts, F.transform("p", lambda x: F.octet_length(x["before"]) + F.octet_length(x["body"]) + F.octet_length(x["after"])), "sizes", "conv_id",
        "p"
    )
    placed = _once(
        sized,
        F.zip_with(
            "p", _starts(F.col("sizes")), lambda x,
            s: F.struct(
                (s + F.octet_length(x["before"])).alias("start"), F.octet_length(x["body"]).alias("bytes"), F.length(x["body"]).alias("chars"),
                x["loss"].alias("loss")
            )
        ),
        "m", "conv_id", "p"
    )
    return placed.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["body"], x["after"])), "").alias("formatted"),
        F.transform(
            F.filter("m", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["bytes"].alias("bytes"), x["chars"].alias("chars"))
        ).alias("mask"),
    )


def _literally(s: str) -> str:
    return r"\Q" + s + r"\E"


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (the texts under the mask), read back from format_chats' output."""

    def rows(two: Column) -> Column:
        """The rows of a block cut into role and texts; both are made once, as elements of arrays."""
        role = unescape(F.substring(F.get(two, F.lit(0)), len(START) + 1, 1 << 30))
        texts = F.split(F.get(two, F.lit(1)), _literally(NEXT))
        return F.flatten(F.transform(F.array(role), lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text")))))

    blocks = F.split("formatted", _literally(END))
    turns = F.flatten(F.transform(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.split(b, _literally(SEP))), rows))
    # the bytes are a variable of the outer lambda, so that each cut copies its own part only
    cut = lambda raw: F.transform("mask", lambda m: unescape(F.substring(raw, (m["start"] + 1).cast("int"), m["bytes"]).cast("string")))
    loss = F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), cut))
    return formatted.select(
        "conv_id", "formatted", F.explode(F.array(F.struct(turns.alias("turns"), loss.alias("loss")))).alias("x")
    ).select("conv_id", "formatted", "x.turns", "x.loss")


def chat_digest(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what parse_chats read."""
    lossy = F.array_join("loss", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lossy).cast("long").alias("loss_chars"),
        F.sha2(lossy, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

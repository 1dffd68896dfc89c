"""Tables out of lines of text: each parser takes a DataFrame of lines (line number, value), wherever these come from.

``read_lines`` numbers a file's lines in order.  Quotes are data; fields are cut at
tabs; lines that a format can't use are left out, or fail the read where it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value of one text file (plain or compressed); numbers follow the order of the file.

    Spark reads a file's splits in order, so a line's number is the lines of the
    splits before it plus its place in its own: only one count a split is collected.
    """
    rows = spark.read.text(path).select("value", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    sizes = sorted((r["__p"], r.n) for r in rows.groupBy("__p").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    start = F.lit(0)
    for p, n in before.items():
        start = F.when(F.col("__p") == p, n).otherwise(start)
    return rows.select((start + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("line"), "value")


def fields(lines: DataFrame, least: int = 1, exactly: int | None = None) -> DataFrame:
    """line, f (fields) of the lines that aren't blank and have enough fields, or exactly so many."""
    f = lines.filter(F.trim("value") != "").select("line", F.split("value", "\t", -1).alias("f"))
    return f.filter(F.size("f") == exactly if exactly else F.size("f") >= least)


def _number(x: Column) -> Column:
    return F.expr("try_cast(x AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")


def complex_words(lines: DataFrame) -> DataFrame:
    """id, sentence, start, end, target, binary, probability: lines of eleven fields or more."""
    f = fields(lines, 11)
    return f.select(
        F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(1)).alias("sentence"), F.get("f", F.lit(2)).cast("int").alias("start"),
        F.get("f", F.lit(3)).cast("int").alias("end"), F.get("f", F.lit(4)).alias("target"),
        F.get("f", F.lit(9)).cast("double").cast("int").alias("binary"), F.get("f", F.lit(10)).cast("double").alias("probability")
    )


def ranked_substitutes(lines: DataFrame, keep_target: bool = False) -> DataFrame:
    """line, sentence, target, ranked (word, n): substitutes of all annotators, trimmed, blank ones left out, most frequent first, then by word."""
    f = fields(lines, 3).select(
        "line", F.trim(F.get("f", F.lit(0))).alias("sentence"), F.trim(F.get("f", F.lit(1))).alias("target"),
        F.filter(F.transform(F.slice("f", 3, F.size("f")), lambda w: F.trim(w)), lambda w: w != "").alias("w")
    )
    if not keep_target:
        f = f.withColumn("w", F.filter("w", lambda w: w != F.col("target")))
    ranked = F.transform(F.array_distinct("w"), lambda x: F.struct((-F.size(F.filter("w", lambda y: y == x))).alias("n"), x.alias("word")))
    return f.select(
        "line", "sentence", "target",
        F.transform(F.array_sort(ranked), lambda r: F.struct(r["word"].alias("word"), (-r["n"]).alias("n"))).alias("ranked")
    )


def word_complexities(lines: DataFrame) -> DataFrame:
    """id, sentence, target, complexity: lines of five fields or more (the second is the language)."""
    f = fields(lines, 5)
    return f.select(
        F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(2)).alias("sentence"), F.get("f", F.lit(3)).alias("target"),
        F.get("f", F.lit(4)).cast("double").alias("complexity")
    )


def single_words(lines: DataFrame, expected: int | None = None) -> DataFrame:
    """id, corpus, sentence, token, complexity: every line after the header has five fields, and there are as many as expected, else the read fails."""
    rows = lines.filter("line > 0 AND trim(value) <> ''").select("line", F.split("value", "\t", -1).alias("f"))
    checked = rows.withColumn(
        "f",
        F.when(F.size("f") == 5, F.col("f")).otherwise(
            F.raise_error(F.concat(F.lit("not five fields in line "), F.col("line").cast("string"))).cast("array<string>")
        )
    )
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows where {expected} were expected")
    return checked.select(
        *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("id", "corpus", "sentence", "token"))),
        F.get("f", F.lit(4)).cast("double").alias("complexity")
    )


def aligned(original: DataFrame, references: list[DataFrame]) -> DataFrame:
    """line, original, references: line i of the original with line i of each reference; references that are too short are left out for a line."""
    out = original.select("line", F.trim("value").alias("original"))
    for i, r in enumerate(references):
        out = out.join(r.select("line", F.trim("value").alias(f"r{i}")), "line", "left")
    return out.select("line", "original", F.array_compact(F.array(*(f"r{i}" for i in range(len(references))))).alias("references"))


def parallel(left: DataFrame, right: DataFrame) -> DataFrame:
    """line, left, right of two files that must have equally many lines."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} lines against {m}")
    return left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), "line")


def lexicon(lines: DataFrame, scale: str) -> DataFrame:
    """word, value of a rescaled lexicon: 'concreteness' (word, type, 0-100 value, after a header, as 1 + v / 25) or 'age' (word, grade, as grade + 5).

    Lines of other shapes and values that are no numbers are left out; of repeated words the last line wins.
    """
    if scale == "concreteness":
        f, value = fields(lines.filter("line > 0"), exactly=3), F.get("f", F.lit(2)).try_cast("double") / 25.0 + 1.0
    elif scale == "age":
        f, value = fields(lines, exactly=2), F.get("f", F.lit(1)).try_cast("double") + 5.0
    else:
        raise ValueError(f"no scale {scale!r}")
    rows = f.select("line", F.lower(F.get("f", F.lit(0))).alias("word"), value.alias("value")).filter("value IS NOT NULL")
    return rows.groupBy("word").agg(F.max_by("value", "line").alias("value"))


def paraphrase_rules(lines: DataFrame) -> DataFrame:
    """complex, simple, complexity, quality: phrases in lower case, lines without a number left out, sides swapped where the complexity is negative."""
    f = fields(lines, 3).select(
        *(F.lower(F.trim(F.get("f", F.lit(i)))).alias(c) for i, c in enumerate("ab")), F.get("f", F.lit(2)).try_cast("double").alias("c"),
        F.get("f", F.lit(3)).alias("q")
    )
    f = f.withColumn("quality", F.col("q").try_cast("double")).filter("c IS NOT NULL AND (q IS NULL OR quality IS NOT NULL)")
    swap = F.col("c") < 0
    return f.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("complex"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("simple"),
        F.abs("c").alias("complexity"), "quality"
    )


def sentence_splits(lines: DataFrame, stride: int = 1, limit: int | None = None) -> DataFrame:
    """line, source, first, second of 'source <tab> first <::::> second': every stride-th line, up to a limit; other shapes are left out."""
    f = lines.filter(F.col("line") % stride == 0).select("line", F.split("value", "\t", -1).alias("f")).filter(F.size("f") == 2)
    f = f.select("line", F.get("f", F.lit(0)).alias("source"), F.split(F.get("f", F.lit(1)), "<::::>").alias("p")).filter(F.size("p") == 2)
    out = f.select("line", "source", F.trim(F.get("p", F.lit(0))).alias("first"), F.trim(F.get("p", F.lit(1))).alias("second"))
    return out.orderBy("line").limit(limit) if limit is not None else out


def labelled_pairs(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is 0 or 1; any other label fails the read."""
    return df.withColumn(
        label,
        F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(
            F.raise_error(F.concat(F.lit("label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")
        )
    )


def sentence_difficulty(lines: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """text, difficulty: the mean of a line's two last fields; texts whose normal form another split has are left out."""
    f = lines.select(
        F.regexp_extract("value", r"^(.*)\t([^\t]*)\t([^\t]*)$", 1).alias("text"),
        *(F.regexp_extract("value", r"^(.*)\t([^\t]*)\t([^\t]*)$", i).try_cast("double").alias(c) for i, c in ((2, "a"), (3, "b")))
    )
    out = f.filter("a IS NOT NULL AND b IS NOT NULL").select("text", ((F.col("a") + F.col("b")) / 2.0).alias("difficulty"))
    if other is None:
        return out
    norm = lambda d: d.withColumn("__n", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    return norm(out).join(norm(other).select("__n").distinct(), "__n", "left_anti").drop("__n")


def ranked_words(lines: DataFrame) -> DataFrame:
    """sentence, target, rank, word of lines whose fields after the target (and its place) are 'rank:word'; the target's key decides the half, by hash."""
    f = fields(lines, 4).select(
        F.get("f", F.lit(0)).alias("sentence"), F.get("f", F.lit(1)).alias("target"), F.explode(F.slice("f", 4, F.size("f"))).alias("x")
    ).filter(F.col("x").rlike("^[0-9]+:."))
    return f.select(
        "sentence", "target", F.split("x", ":", 2)[0].cast("int").alias("rank"), F.split("x", ":", 2)[1].alias("word"),
        F.when(F.crc32(F.lower("target")) % 2 == 0, "dev").otherwise("test").alias("half")
    )


def substitution_items(documents: DataFrame) -> DataFrame:
    """target_id, context, offset, target, substitute, share: rows of the JSON texts (value) that hold dictionaries of contexts, targets, substitutes and labels, joined by id.

    Substitutes of several words or with other characters than letters are left out,
    and targets that don't stand at their offset.
    """
    schema = "contexts MAP<STRING, STRUCT<context: STRING>>, targets MAP<STRING, STRUCT<context_id: STRING, offset: INT, target: STRING>>, substitutes MAP<STRING, STRUCT<target_id: STRING, substitute: STRING>>, substitute_labels MAP<STRING, ARRAY<STRING>>"
    j = documents.select(F.from_json("value", schema).alias("j"))
    contexts = j.select(F.explode("j.contexts").alias("context_id", "c")).select("context_id", "c.context")
    targets = j.select(F.explode("j.targets").alias("target_id", "t")).select("target_id", "t.context_id", "t.offset", "t.target")
    subs = j.select(F.explode("j.substitutes").alias("sid", "s")).select(
        "sid", "s.target_id", F.trim("s.substitute").alias("substitute")
    ).filter(F.col("substitute").rlike(r"^\p{L}+$"))
    labels = j.select(F.explode("j.substitute_labels").alias("sid", "l")).select(
        "sid", (F.size(F.filter("l", lambda x: x == "TRUE")) / F.size("l").cast("double")).alias("share")
    )
    at = targets.join(contexts, "context_id").filter("substring(context, offset + 1, length(target)) = target AND NOT contains(target, ' ')")
    return at.join(subs, "target_id").join(labels, "sid").select("target_id", "context", "offset", "target", "substitute", "share")


def blocks(text: Column) -> Column:
    """Array of (key, value) of a text cut at lines of asterisks: blocks of two lines, of equal keys the first."""
    parts = F.transform(
        F.split(text, r"(?m)^\*{5,}[ \t]*\r?$\n?"), lambda b: F.filter(F.transform(F.split(b, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    )
    two = F.transform(F.filter(parts, lambda b: F.size(b) == 2), lambda b: F.struct(b[0].alias("key"), b[1].alias("value")))
    keys = F.transform(two, lambda x: x["key"])
    return F.filter(two, lambda x, i: F.array_position(keys, x["key"]) == i + 1)


def expected_phrases(text: Column) -> Column:
    """Map from phrase to its replacements of 'a => b | c ; d => e'; parts without an arrow are left out, repeated phrases unite."""
    pairs = F.transform(
        F.filter(F.split(text, ";"), lambda p: p.contains("=>")),
        lambda p: F.struct(
            F.lower(F.trim(F.split(p, "=>")[0])).alias("k"), F.transform(F.split(F.split(p, "=>")[1], r"\|"), lambda x: F.lower(F.trim(x))).alias("v")
        )
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k,
                F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])), lambda x: x != "")))
            )
        )
    )


def paragraphs(text: Column, kind: str) -> Column:
    """Paragraphs of a text: 'text' cut at blank lines; 'rfc' the same from section 1 on, without page lines."""
    if kind == "rfc":
        text = F.regexp_replace(text, r"(?m)^(?:.*\[Page \d+\]|RFC \d+ .*\d{4})[ \t]*\r?$", "")
        text = F.regexp_replace(F.regexp_extract(text, r"(?s)(?:^|\n)(1\.  ?\S.*)$", 1), "\f", "")
    elif kind != "text":
        raise ValueError(f"no kind {kind!r}")
    return F.filter(F.transform(F.split(text, r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.regexp_replace(F.trim(p), r"\s+", " ")), lambda p: p != "")


def cells(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """config, id and the fields of every folder/config/id.json."""
    at = F.input_file_name()
    return spark.read.schema(schema).json(f"{folder}/*/*.json", multiLine=True).select(
        F.regexp_extract(at, r"([^/]+)/[^/]+\.json$", 1).alias("config"), F.regexp_extract(at, r"([^/]+)\.json$", 1).alias("id"), "*"
    )


def panel(rows: DataFrame, locked: DataFrame, id_col: str = "id", text_col: str = "text", prefix: str = "ose-") -> DataFrame:
    """rows, if no id repeats and none is locked by id, by hash of its text, or by prefix; else an error that says how many."""
    twice = rows.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"{twice} ids repeat")
    if n := locked_rows(rows, locked, id_col, text_col, prefix).count():
        raise ValueError(f"{n} rows are locked")
    return rows


def locked_rows(rows: DataFrame, locked: DataFrame, id_col: str = "id", text_col: str = "text", prefix: str = "ose-") -> DataFrame:
    """Rows that a locked list (id, sha256) names by id or by the hash of the text, or whose id has the prefix and is locked without it: a semi join for each way, united."""
    key = rows.withColumn("__i", F.col(id_col).cast("string")).withColumn("__h", F.sha2(text_col, 256)).withColumn(
        "__b", F.when(F.col("__i").startswith(prefix), F.substring("__i", len(prefix) + 1, 1 << 20))
    )
    ids = locked.select(F.col("id").cast("string").alias("__l")).filter("__l is not null").distinct()
    hashes = locked.select(F.col("sha256").alias("__l")).filter("__l is not null").distinct()
    ways = [
        key.join(ids, key["__i"] == ids["__l"], "left_semi"), key.join(hashes, key["__h"] == hashes["__l"], "left_semi"),
        key.join(ids, key["__b"] == ids["__l"], "left_semi")
    ]
    return ways[0].unionByName(ways[1]).unionByName(ways[2]).dropDuplicates([id_col]).drop("__i", "__h", "__b")


def sentences_of(df: DataFrame, column: str) -> DataFrame:
    """The sentences of a column, one a row, white space cut; empty ones left out."""
    from lexaria.functions.text import sentences

    return df.select(F.explode(sentences(F.col(column))).alias("sentence"))


def inflections(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """form, lemma, tag of lines of three fields, with those of the overrides (same columns) in place of a form's own."""
    own = fields(lines, exactly=3).select(*(F.lower(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(("form", "lemma"))), F.get("f", F.lit(2)).alias("tag"))
    return own.join(overrides.select("form").distinct(), "form", "left_anti").unionByName(overrides.select("form", "lemma", "tag"))


def numbered(df: DataFrame, order: str, value: Column) -> DataFrame:
    """Lines out of rows: line (0 first, in the order of a unique column) and value, for tables that stand for files."""
    return df.select((F.row_number().over(Window.partitionBy().orderBy(order)) - 1).cast("long").alias("line"), value.alias("value"))

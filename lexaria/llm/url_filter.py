"""URL filter: path rules, then a blocked Bloom filter in front of an exact join.

The listed URLs are made canonical and put into a Bloom filter of 512-bit
blocks: a key sets one bit in each of the eight 64-bit words of one block.  The
filter is a table of blocks, built by ``bit_or`` aggregation.  A URL without a
rule looks up its block; only possible hits go on to the exact join on the
canonical URL, which removes false positives.  So the shuffle carries hits, not
pages.  While the list is small (its rows and bytes are counted) both tables are
broadcast and pages are read once and never shuffled; beyond that the table of blocks
is joined by a shuffle of the pages that no rule decides, what it says is written, and hits alone go on to the join.

Definitions: a null URL or one without ``://`` has empty host, path and
canonical form, fits no rule and is never listed.  Of several rules that fit the one
with the longest host and path wins, of equally long ones the first given.  Repeated
list entries count once; repeated pages are judged one by one.  An empty list blocks
nothing; an empty table gives an empty result.  URLs of any length are judged whole.
Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.scratch import BROADCAST_BYTES, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, KEYS_PER_BLOCK = 8, 32


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without trailing slashes, sorted query without tracking parameters; no scheme or fragment."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(ref|fbclid|gclid|utm_[a-z]+)(=|$)")))
    base = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    name = verdict = None
    for action, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name = F.when(fits, F.lit(at + start)) if name is None else name.when(fits, F.lit(at + start))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def _place(key: Column, blocks: int) -> list[Column]:
    """Block number and the mask of each word."""
    bits = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(_one_bit(bits, i).alias(f"m{i}") for i in range(WORDS))]


def _one_bit(bits: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """block, w0 .. w7 for the keys given."""
    placed = keys.select(*_place(F.col(key_col), blocks))
    return placed.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; listed URLs without a rule are blocked."""
    keys = listed.select(canonical(F.col(listed_col)).alias("canon")).filter("canon != ''").distinct()
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length("canon") + 32).alias("bytes")).first()
    blocks = max(1, -(-size.n // KEYS_PER_BLOCK))
    small = (size.bytes or 0) <= BROADCAST_BYTES
    table = bloom_blocks(keys, "canon", blocks)
    url = F.col("u")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    open_ = F.col("rule").isNull() & (F.col("canon") != "")
    names = ["page_id", "host", "path", "rule", "verdict"]
    hit = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)))
    exact = keys.select(F.col("canon").alias("probe"), F.lit(True).alias("on_list"))
    said = F.coalesce("verdict", F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict")

    def probed(some: DataFrame, filter_: DataFrame) -> DataFrame:
        """Rows with what has to be looked up in the list: the canonical URL of a possible hit."""
        placed = some.select(*names, "canon", *_place(F.when(open_, F.col("canon")), blocks))
        probe = F.when(open_ & F.coalesce(hit, F.lit(False)), F.col("canon"))
        return placed.join(filter_, "block", "left").select(*names, probe.alias("probe"))

    if small:
        return probed(rows, F.broadcast(table)).join(F.broadcast(exact), "probe", "left").select("page_id", "host", "path", "rule", said)
    # rows that a rule decides, or that have no URL, have no block and needn't meet the filter: they would all meet in one task
    decided = rows.filter(~open_).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    passed = Scratch(pages.sparkSession, "url_filter").table(probed(rows.filter(open_), table))
    found = passed.filter("probe is not null").join(exact, "probe", "left").select("page_id", "host", "path", "rule", said)
    clear = passed.filter("probe is null").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return found.unionByName(clear).unionByName(decided)

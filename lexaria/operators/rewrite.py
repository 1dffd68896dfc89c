"""Rule-based rewriting: text to text, with the rules as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary(tokens: Column, rules: dict[str, str]) -> Column:
    """Replace whole tokens; the map is a literal, so nothing is shuffled. Tokens without a rule stay."""
    table = F.create_map(*(F.lit(x) for pair in sorted(rules.items()) for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))

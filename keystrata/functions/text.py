"""Query-string parsing and JSON rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_params(requests: DataFrame, id_col: str = "request_id", query_col: str = "query", body_col: str = "body") -> DataFrame:
    """(id, name, value): URL-decoded parameters of every request; the last of equal names wins.

    The body serves where the query string is null. Pairs without ``=`` or with an empty name are
    left out; ``+`` is a blank.
    """
    rows = requests.select(id_col, F.posexplode(F.split(F.coalesce(query_col, body_col), "&")).alias("at", "pair"))
    eq = F.instr("pair", "=")
    rows = rows.where(eq > 1).select(id_col, "at", F.url_decode(F.substring(F.col("pair"), F.lit(1), eq - 1)).alias("name"), F.url_decode(F.substring(F.col("pair"), eq + 1, F.length("pair"))).alias("value"))
    return rows.groupBy(id_col, "name").agg(F.max_by("value", "at").alias("value"))


def json_pair(key: Column, value: Column) -> Column:
    """``{"key":...,"value":...}`` with all control characters escaped."""
    return F.to_json(F.struct(key.alias("key"), value.alias("value")))

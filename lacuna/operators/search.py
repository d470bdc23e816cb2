"""Search over the catalog; pages are in ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_catalog(names: DataFrame, text: str) -> DataFrame:
    """Apps whose latest name contains the text, whatever the case, or whose id is the text."""
    return names.where(F.contains(F.lower("name"), F.lit(text.lower())) | (F.col("app_id").cast("string") == text))


def cohort_listing(summary: DataFrame, name_part: str, id_part: str, most: int) -> DataFrame:
    """app_id, name, availability, player_count, place: fresh first, larger counts first, then by id."""
    found = summary.where(F.contains(F.lower("name"), F.lit(name_part.lower())) | F.contains(F.col("app_id").cast("string"), F.lit(id_part)))
    top = found.orderBy(F.when(F.col("availability") == "fresh", 0).otherwise(1), F.coalesce("player_count", F.lit(0)).desc(), "app_id").limit(most)
    order = "row_number() OVER (ORDER BY CASE WHEN availability = 'fresh' THEN 0 ELSE 1 END, coalesce(player_count, 0) DESC, app_id)"
    return top.select("app_id", "name", "availability", "player_count", F.expr(order).cast("bigint").alias("place"))

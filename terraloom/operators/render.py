"""Records as JSON, as sentences and as prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIENCES = ("academic", "investor", "farmer", "policy")
TEMPLATE = (
    "Describe the study area for the audience named below, using only the statistics given.\n\n"
    "Statistics:\n{summary_data}\n\nAudience: {audience}\n\n"
    "Cover extent, terrain, land cover and vegetation, in this order. Keep every number as it is given. "
    "Write 140 to 170 words of plain text and add nothing that the statistics do not support."
)
NUMBER = r"-?\d+(?:\.\d+)?"


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def shortest(value: Column) -> Column:
    """A number without trailing zeros: 1500.0 as 1500."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def context_json(context: DataFrame) -> DataFrame:
    """aoi_id, json: the record as {"summary": {dem, ndvi, landcover}, "narrative": ...}; a missing narrative is left out."""
    narrative = [F.col("narrative")] if "narrative" in context.columns else []
    return context.select("aoi_id", F.to_json(F.struct(F.struct("dem", "ndvi", "landcover").alias("summary"), *narrative)).alias("json"))


def summary_text(context: DataFrame) -> DataFrame:
    """aoi_id, text: the narrative if there is one, else a sentence for each part that has data."""
    dem, veg, cover = F.col("dem"), F.col("ndvi"), F.col("landcover")
    has_dem, has_veg = dem["mean"].isNotNull(), veg["mean"].isNotNull()
    parts = F.transform(F.map_entries(cover["classes"]), lambda e: F.concat(e["key"], F.lit(" ("), fixed(e["value"], 2), F.lit("%)")))
    lines = F.concat_ws(
        " ",
        F.when(has_dem, F.concat(F.lit("Elevation: averages around "), fixed(dem["mean"], 0), F.lit(" m (range: "), shortest(dem["min"]), F.lit("–"), shortest(dem["max"]), F.lit(" m, Standard deviation of "), fixed(dem["std"], 1), F.lit(")."))),
        F.when(has_dem, F.concat(F.lit("Terrain: "), dem["terrain_type"], F.lit("."))),
        F.when(has_veg, F.concat(F.lit("Vegetation health: NDVI ≈ "), fixed(veg["mean"], 2), F.lit(" (scale: -1 to +1, where higher values indicate denser vegetation)."))),
        F.when(has_veg, F.concat(F.lit("NDVI method: "), veg["method"], F.lit("."))),
        F.when(has_veg, F.concat(F.lit("Note: "), veg["warning"], F.lit("."))),
        F.when(F.size(parts) > 0, F.concat(F.lit("Land cover composition: "), F.array_join(parts, ", "), F.lit("."))),
    )
    lines = F.when(lines == "", "No summary available.").otherwise(lines)
    if "narrative" in context.columns:
        lines = F.coalesce(F.nullif(F.trim("narrative"), F.lit("")), lines)
    return context.select("aoi_id", lines.alias("text"))


def prompts(context: DataFrame, audiences: tuple[str, ...] = AUDIENCES, template: str = TEMPLATE) -> DataFrame:
    """aoi_id, audience, prompt, error: a prompt for each area and audience; an audience that isn't known gives an error."""
    data = F.to_json(F.struct("dem", "ndvi", "landcover"), {"pretty": "true"})
    rows = context.withColumn("audience", F.explode(F.array(*map(F.lit, audiences))))
    known = F.col("audience").isin(*AUDIENCES)
    filled = F.replace(F.replace(F.lit(template), F.lit("{summary_data}"), data), F.lit("{audience}"), F.col("audience"))
    return rows.select("aoi_id", "audience", F.when(known, filled).alias("prompt"), F.when(~known, "Unknown audience").alias("error"))


def check_narratives(df: DataFrame, low: int = 140, high: int = 170) -> DataFrame:
    """df (summary, narrative) plus n_words, right_length, missing_numbers (of the summary), plain_text and passed."""
    text = F.trim("narrative")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)))
    missing = F.array_sort(F.array_except(numbers(F.col("summary")), numbers(text)))
    out = df.withColumns(
        {
            "n_words": F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+"))),
            "missing_numbers": missing,
            "plain_text": ~text.rlike(r"(?m)^\s*(#|[-*] |```)|\*\*"),
        }
    )
    out = out.withColumn("right_length", F.col("n_words").between(low, high))
    return out.withColumn("passed", F.col("right_length") & (F.size("missing_numbers") == 0) & F.col("plain_text"))

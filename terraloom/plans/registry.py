"""Names of the registered queries of the geospatial engine, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.plans import oracles
from terraloom.plans import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        q.aoi_parse, q.aoi_normalize, q.aoi_features, q.aoi_bbox, q.bbox_polygon, q.aoi_area, q.aoi_area_guard, q.aoi_resolve,
        q.scene_search, q.scene_topk, q.scene_guard, q.first_item, q.aoi_uncovered, q.clip_center, q.clip_touched, q.clip_wide, q.cover_outline, q.scene_search_wide, q.scene_table_search,
        q.dem_stats, q.terrain_class, q.landcover_pct, q.landcover_label, q.landcover_dominant, q.landcover_map,
        q.scene_cube, q.solar_day_mosaic, q.cloud_mask, q.ndvi_scene, q.ndvi_median, q.ndvi_stats, q.ndvi_quartiles_approx, q.coarse_quantiles, q.price_quantiles, q.ndvi_fallback, q.ndvi_fallback_clipped,
        q.ndvi_resolved, q.regrid, q.regrid_fine, q.cube_aligned, q.terrain_rollup, q.context_covered, q.context_json, q.summary_text, q.narrative_prompt, q.narrative_qa,
        q.geojson_export, q.place_search, q.latest_shape, q.debounce, q.stream_requests, q.stream_debounce, q.live_requests, q.live_shapes,
    )
    return {"context": q.context_, "context_store": q.context_store_, "geojson_files": q.geojson_files_} | {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()

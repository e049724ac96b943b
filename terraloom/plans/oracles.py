"""DuckDB SQL of the registered queries, over the given tables."""

from __future__ import annotations

from terraloom.operators.zonal import CLASSES
from terraloom.sources.fixtures import AS_OF, with_views

_CLASS_ROWS = ", ".join(f"({k}, '{v}')" for k, v in CLASSES.items())

#: Named parts that several queries share; each may use those before it.
#: Statistics of the coarse index from the stored integers, scaled once.
_COARSE = """sum(raw) / count(raw) * 0.0001e0 as mean, min(raw) * 0.0001e0 as min, max(raw) * 0.0001e0 as max,
    sqrt(greatest(sum(raw::bigint * raw) / count(raw) - (sum(raw) / count(raw)) * (sum(raw) / count(raw)), 0)) * 0.0001e0 as std"""

PARTS = {
    "box": """select aoi_id, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_aoi_vertex where ring = 0 group by aoi_id""",
    "area": """select *, ((maxx - minx) * 111.32e0) * ((maxy - miny) * 111.32e0) as km2 from box""",
    "search": """select aoi_id, scene_id, dt, cloud_cover from box b join fx_scene s on b.minx <= s.maxx and b.maxx >= s.minx and b.miny <= s.maxy and b.maxy >= s.miny
        where s.collection = 'sentinel-2-l2a' and cast(dt as date) between date '{as_of}' - 90 and date '{as_of}' and cloud_cover < 30""",
    "center": """select aoi_id, r, c, min(lon) as lon, min(lat) as lat from fx_cell join fx_aoi_edge on true group by aoi_id, r, c
        having sum(case when (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0e0) + x1 then 1 else 0 end) % 2 = 1""",
    "slab": """select aoi_id, r, c, lon - 0.005e0 as w, lon + 0.005e0 as e, lat - 0.005e0 as s, lat + 0.005e0 as n, x1, y1, x2 - x1 as dx, y2 - y1 as dy from fx_cell join fx_aoi_edge on true""",
    "met": """select distinct aoi_id, r, c from (select *,
          case when dx = 0 then (case when w <= x1 and x1 <= e then 0e0 else 2e0 end) else least((w - x1) / nullif(dx, 0e0), (e - x1) / nullif(dx, 0e0)) end as x_in,
          case when dx = 0 then (case when w <= x1 and x1 <= e then 1e0 else -1e0 end) else greatest((w - x1) / nullif(dx, 0e0), (e - x1) / nullif(dx, 0e0)) end as x_out,
          case when dy = 0 then (case when s <= y1 and y1 <= n then 0e0 else 2e0 end) else least((s - y1) / nullif(dy, 0e0), (n - y1) / nullif(dy, 0e0)) end as y_in,
          case when dy = 0 then (case when s <= y1 and y1 <= n then 1e0 else -1e0 end) else greatest((s - y1) / nullif(dy, 0e0), (n - y1) / nullif(dy, 0e0)) end as y_out
        from slab) t where greatest(0e0, x_in, y_in) <= least(1e0, x_out, y_out)""",
    "touched": """select aoi_id, r, c from center union select aoi_id, r, c from met""",
    "elevation": """select aoi_id, avg(v) as mean, min(v) as min, max(v) as max, stddev_pop(v) as std from (
          select a.aoi_id, case when d.elevation <> -32768 then d.elevation end as v from fx_aoi a left join center k on a.aoi_id = k.aoi_id left join fx_dem d on d.r = k.r and d.c = k.c) t group by aoi_id""",
    "cover": """select aoi_id, code, n, round(n / sum(n) over (partition by aoi_id) * 100, 2) as pct, first_at from (
          select aoi_id, code, count(*) as n, min(k.r * 1000 + k.c) as first_at from center k join fx_lc l on l.r = k.r and l.c = k.c where code <> 0 group by aoi_id, code) t""",
    "class": f"""select * from (values {_CLASS_ROWS}) as v(code, label)""",
    "named": """select aoi_id, coalesce(label, 'Unknown (' || code || ')') as label, code, n, pct, first_at from cover left join class using (code)""",
    "dominant": """select aoi_id, arg_max(label, pct * 10000000 - first_at) as dominant_class, max(pct) as dominant_percentage, count(*) as n_classes from named group by aoi_id""",
    "mosaic": """select solar_day, r, c, arg_min(b04, k) filter (where b04 <> 0) as b04, arg_min(b08, k) filter (where b08 <> 0) as b08, arg_min(scl, k) filter (where scl <> 0) as scl from (
          select p.*, cast(dt + to_seconds(cast(floor((minx + maxx) / 2 / 15 * 3600) as bigint)) as date) as solar_day, epoch(dt) * 100000 + s.scene_id as k
          from fx_scene_px p join fx_scene s using (scene_id) {only}) t group by solar_day, r, c""",
    "composite": """select r, c, median((b08 - b04::double) / (b08 + b04 + 1e-8)) as ndvi from mosaic where scl in (4, 5, 6, 7, 11) group by r, c""",
    "veg": """select t.aoi_id, avg(ndvi) as mean, min(ndvi) as min, max(ndvi) as max, stddev_pop(ndvi) as std, quantile_cont(ndvi, 0.25) as p25, quantile_cont(ndvi, 0.75) as p75,
          any_value(n_scenes) as scene_count from touched t join area using (aoi_id) join composite using (r, c)
          join (select aoi_id, count(distinct scene_id) as n_scenes from search group by aoi_id) f using (aoi_id)
          where ndvi > -1 and ndvi < 1 and n_scenes >= 2 and km2 <= {limit} group by t.aoi_id""",
    "quarter": """select m.r, m.c, case when raw > -2000 then raw end as raw from fx_modis m
          join (select month, min(half) as half from fx_modis where month in (1, 4, 7, 10) group by month) f using (month, half)""",
    "coarse": f"select {_COARSE} from quarter",
    "terrain": """select *, round(max - min, 1) as elevation_range_m, case when max - min < 50 then 'relatively flat' when max - min < 300 then 'moderately undulating'
          when max - min is not null then 'highly variable or mountainous' end as terrain_type from elevation""",
    "flat": """select a.aoi_id, round(t.mean, 6) as dem_mean, round(t.std, 6) as dem_std, elevation_range_m, terrain_type,
          round(coalesce(v.mean, k.mean), 6) as ndvi_mean, round(v.p75, 6) as ndvi_p75, coalesce(scene_count, 0) as scene_count,
          case when v.mean is not null then 'median_composite_optimized' else 'modis_fallback' end as ndvi_method,
          dominant_class, dominant_percentage, coalesce(n_classes, 0) as n_classes
        from fx_aoi a left join terrain t using (aoi_id) left join veg v using (aoi_id) left join dominant d using (aoi_id), coarse k""",
    "request": """select aoi_id * 4 + variant as request_id, aoi_id, variant from fx_aoi, (values (0), (1), (2), (3)) as v(variant)""",
    "ring": """select aoi_id, count(distinct ring) as n_rings, count(*) as n_points from fx_aoi_vertex group by aoi_id""",
    "drawn": """select *, south + 0.03e0 as north, west + 0.03e0 as east from fx_draw""",
    "tile": """select aoi_id, collection from box b join fx_tile t on b.minx <= t.maxx and b.maxx >= t.minx and b.miny <= t.maxy and b.maxy >= t.miny""",
    "lacking": """select a.aoi_id, case when bool_or(collection = 'nasadem') then null else 'nasadem' end as no_dem, case when bool_or(collection = 'esa-worldcover') then null else 'esa-worldcover' end as no_cover
        from fx_aoi a left join tile t using (aoi_id) group by a.aoi_id""",
    "audience": """select * from (values ('academic'), ('investor'), ('farmer'), ('policy'), ('poet')) as v(audience)""",
    "burst": """select session_id, ts, event_id, sum(starts) over (partition by session_id order by ts, event_id rows unbounded preceding) as burst_no from (
          select session_id, ts, event_id, case when ts > lag(ts) over (partition by session_id order by ts, event_id) + interval 6 hours then 1 else 0 end as starts from fx_draw) t""",
    "fired": """select session_id, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as fired_at, arg_max(event_id, epoch_us(ts)::hugeint * 100000000 + event_id) as event_id, count(*) as n_events
        from burst group by session_id, burst_no""",
    "asked": """select place_id as query_id, lower(substr(split_part(display_name, ' ', 2), 1, (2 + place_id % 3)::int)) as q from fx_place""",
    "found": """select distinct query_id, place_id, display_name, lat, lon from asked a join (select *, unnest(string_split(lower(display_name), ' ')) as word from fx_place) p on starts_with(word, q) where length(q) >= 3""",
    "grid": """select *, floor((lon - 36.6e0) / 0.025e0)::bigint as gc, floor((-1.1e0 - lat) / 0.025e0)::bigint as gr from fx_dem""",
    "spoken": """select o_orderkey, 'key ' || (o_orderkey % 100) || ', class ' || o_orderpriority[1] as summary,
          'Area ' || (o_orderkey % 100) || ' of ' || o_orderpriority || case when o_orderkey % 2 = 0 then repeat(' word', 140) else '' end as narrative from orders""",
}

PARTS |= {
    "wide_edge": """select a.aoi_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from fx_wide_vertex a join fx_wide_vertex b on a.aoi_id = b.aoi_id and a.ring = b.ring and b.i = a.i + 1""",
    "wide_inside": """select aoi_id, px from fx_wide_px join wide_edge on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0e0) + x1 group by aoi_id, px having count(*) % 2 = 1""",
    "wide_cell": """select aoi_id, cx, cy, cx * 0.5e0 - 5e-7 as w, cx * 0.5e0 + 0.5000005e0 as e, cy * 0.5e0 - 5e-7 as s, cy * 0.5e0 + 0.5000005e0 as n from (select aoi_id, unnest(range(floor(min(x) / 0.5e0)::bigint, floor(max(x) / 0.5e0)::bigint + 1)) as cx, min(y) as low, max(y) as high from fx_wide_vertex group by aoi_id) t, lateral (select unnest(range(floor(low / 0.5e0)::bigint, floor(high / 0.5e0)::bigint + 1)) as cy) u""",
    "wide_met": """select distinct aoi_id, cx, cy from (select *,
          case when dx = 0 then (case when w <= x1 and x1 <= e then 0e0 else 2e0 end) else least((w - x1) / nullif(dx, 0e0), (e - x1) / nullif(dx, 0e0)) end as x_in,
          case when dx = 0 then (case when w <= x1 and x1 <= e then 1e0 else -1e0 end) else greatest((w - x1) / nullif(dx, 0e0), (e - x1) / nullif(dx, 0e0)) end as x_out,
          case when dy = 0 then (case when s <= y1 and y1 <= n then 0e0 else 2e0 end) else least((s - y1) / nullif(dy, 0e0), (n - y1) / nullif(dy, 0e0)) end as y_in,
          case when dy = 0 then (case when s <= y1 and y1 <= n then 1e0 else -1e0 end) else greatest((s - y1) / nullif(dy, 0e0), (n - y1) / nullif(dy, 0e0)) end as y_out
        from (select *, x2 - x1 as dx, y2 - y1 as dy from wide_cell join wide_edge using (aoi_id)) p) t where greatest(0e0, x_in, y_in) <= least(1e0, x_out, y_out)""",
    "wide_whole": """select aoi_id, cx, cy from (select * from wide_cell anti join wide_met using (aoi_id, cx, cy)) c join wide_edge using (aoi_id)
        where (y1 > cy * 0.5e0 + 0.25e0) <> (y2 > cy * 0.5e0 + 0.25e0) and cx * 0.5e0 + 0.25e0 < (x2 - x1) * (cy * 0.5e0 + 0.25e0 - y1) / nullif(y2 - y1, 0e0) + x1
        group by aoi_id, cx, cy having count(*) % 2 = 1""",
    "wide_box": """select aoi_id, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_wide_vertex where ring = 0 group by aoi_id union all select aoi_id + 100, minx, miny, maxx, maxy from box""",
}

_ELEVATION = "round(mean, 6) as mean, round(min, 6) as min, round(max, 6) as max, round(std, 6) as std"

QUERIES = {
    "context": "select * from flat",
    "context_json": "select * from flat",
    "context_covered": """select a.aoi_id, case when bad is null then dem_mean end as dem_mean, case when bad is null then dominant_class end as dominant_class, true as no_ndvi,
        case when bad is not null then 'No data coverage for this area' end as error from flat a join (select aoi_id, coalesce(no_dem, no_cover) as bad from lacking) l using (aoi_id)""",
    "aoi_parse": """select request_id, case variant when 0 then 'Feature' when 1 then 'FeatureCollection' when 2 then 'Polygon' end as type, case when variant = 1 then 2 else 0 end as n_features,
        case when variant = 3 then 'Invalid JSON' end as error from request""",
    "aoi_normalize": """select request_id, case when variant < 2 then 'Polygon' end as geometry, case when variant < 2 then n_rings else 0 end as n_rings, case when variant < 2 then n_points else 0 end as n_points,
        case variant when 2 then 'Unsupported GeoJSON type' when 3 then 'Invalid JSON' end as error from request join ring using (aoi_id)""",
    "aoi_features": "select request_id, variant + 1 as n_features, variant as last_no from request where variant < 2",
    "aoi_bbox": "select aoi_id, minx, miny, maxx, maxy, maxy as north, miny as south, maxx as east, minx as west from box",
    "bbox_polygon": """select aoi_id, i, case when i in (1, 2) then maxx else minx end as x, case when i in (2, 3) then maxy else miny end as y from box, (values (0), (1), (2), (3), (4)) as v(i)""",
    "aoi_area": "select aoi_id, round(km2, 6) as area_km2 from area",
    "aoi_area_guard": "select aoi_id, round(km2, 6) as area_km2, case when km2 > 50 then 'area above limit' end as skip_reason from area",
    "aoi_resolve": "select aoi_id, case when aoi_id % 3 = 0 then n_points else 5 end as n_points, minx, miny, maxx, maxy from box join ring using (aoi_id) where aoi_id % 3 = 0 or aoi_id % 2 = 0",
    "scene_search": "select aoi_id, scene_id, cast(cast(dt as date) as varchar) as day, cloud_cover from search",
    "scene_topk": "select aoi_id, rank, scene_id from (select *, row_number() over (partition by aoi_id order by cloud_cover, dt desc, scene_id) as rank from search) t where rank <= 8",
    "scene_guard": "select aoi_id, count(distinct scene_id) as scene_count from search where cloud_cover < 4 group by aoi_id having count(distinct scene_id) >= 2",
    "first_item": "select aoi_id, month(dt) as month, arg_max(scene_id, epoch(dt) * 100000 - scene_id) as scene_id from search group by aoi_id, month(dt)",
    "aoi_uncovered": "select aoi_id, coalesce(no_dem, no_cover) as missing, 'No data coverage for this area' as error from lacking where coalesce(no_dem, no_cover) is not null",
    "clip_center": "select aoi_id, r, c from center",
    "clip_touched": "select aoi_id, r, c from touched",
    "clip_wide": "select aoi_id, px from wide_inside",
    "cover_outline": """select aoi_id, coalesce(n, 0) as n_inside, coalesce(k, 0) as whole_cells from (select distinct aoi_id from fx_wide_vertex) a
        left join (select aoi_id, count(*) as n from wide_inside group by aoi_id) i using (aoi_id) left join (select aoi_id, count(*) as k from wide_whole group by aoi_id) w using (aoi_id)""",
    "scene_search_wide": "select aoi_id, scene_id from wide_box b join fx_footprint s on b.minx <= s.maxx and b.maxx >= s.minx and b.miny <= s.maxy and b.maxy >= s.miny",
    "dem_stats": f"select aoi_id, {_ELEVATION}, case when mean is null then 'No valid elevation pixels' end as error from elevation",
    "terrain_class": "select aoi_id, elevation_range_m, terrain_type from terrain",
    "landcover_pct": "select aoi_id, code, n, pct from cover",
    "landcover_label": "select aoi_id, code, label, pct from named",
    "landcover_dominant": "select a.aoi_id, dominant_class, dominant_percentage, case when dominant_class is null then 'No valid landcover pixels' end as error from fx_aoi a left join dominant using (aoi_id)",
    "landcover_map": "select aoi_id, label, pct from named",
    "scene_cube": "select scene_id, r, c, b04, b08, scl from fx_scene_px",
    "solar_day_mosaic": "select cast(solar_day as varchar) as solar_day, r, c, coalesce(b04, 0) as b04, coalesce(b08, 0) as b08, coalesce(scl, 0) as scl from mosaic",
    "cloud_mask": "select scl, count(*) as n from fx_scene_px where scl in (4, 5, 6, 7, 11) group by scl",
    "ndvi_scene": "select scene_id, r, c, round((b08 - b04::double) / (b08 + b04 + 1e-8), 9) as ndvi from fx_scene_px where scl in (4, 5, 6, 7, 11)",
    "ndvi_median": "select r, c, round(ndvi, 9) as ndvi from composite",
    "ndvi_stats": f"select aoi_id, {_ELEVATION}, round(p25, 6) as p25, round(p75, 6) as p75, scene_count, 20 as resolution_m, 'median_composite_optimized' as method from veg",
    "ndvi_quartiles_approx": "select aoi_id, true as within, true as same_mean from veg",
    "coarse_quantiles": "select month, " + ", ".join(f"round(quantile_cont(raw::double, {p / 100}), 6) as p{p}" for p in (10, 25, 50, 75, 90, 100)) + " from fx_modis where raw > -2000 group by month",
    "price_quantiles": "select l_returnflag, round(min(v), 4) as least, round(quantile_cont(v, 0.01), 4) as p1, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.999), 4) as p999 from (select l_returnflag, (l_extendedprice * l_quantity)::double as v from lineitem) t group by l_returnflag",
    "ndvi_fallback": f"select {_ELEVATION}, 500 as resolution_m, 'modis_fallback' as method from coarse",
    "ndvi_fallback_clipped": f"select aoi_id, {_ELEVATION} from (select aoi_id, {_COARSE} from center join quarter using (r, c) group by aoi_id) t where mean is not null",
    "ndvi_resolved": """select a.aoi_id, round(coalesce(v.mean, k.mean), 6) as mean, round(p25, 6) as p25, coalesce(scene_count, 0) as scene_count, case when v.mean is null then 500 else 20 end as resolution_m,
        case when v.mean is null then 'modis_fallback' else 'median_composite_optimized' end as method,
        case when v.mean is null then 'Coarse resolution (500m) - use smaller areas for better accuracy' end as warning from fx_aoi a left join veg v using (aoi_id), coarse k""",
    "regrid": """select gr as "row", gc as col, elevation from (select *, row_number() over (partition by gr, gc order by
        round((lon - (36.6e0 + (gc + 0.5e0) * 0.025e0)) * (lon - (36.6e0 + (gc + 0.5e0) * 0.025e0)) + (lat - (-1.1e0 - (gr + 0.5e0) * 0.025e0)) * (lat - (-1.1e0 - (gr + 0.5e0) * 0.025e0)), 12), r, c) as k from grid) t where k = 1""",
    "summary_text": """select f.aoi_id, coalesce(terrain_type, '') as terrain, ndvi_method as method,
        case when ndvi_method = 'modis_fallback' then 'Note: Coarse resolution (500m) - use smaller areas for better accuracy' else '' end as note,
        coalesce(printf('%.0f', dem_mean), '') as elevation, coalesce(parts, '') as cover from flat f left join (
          select aoi_id, string_agg(label || ' (' || printf('%.2f', pct) || '%)', ', ' order by label) as parts from named group by aoi_id) n using (aoi_id)""",
    "narrative_prompt": "select aoi_id, audience, audience <> 'poet' as names_audience, case when audience = 'poet' then 'Unknown audience' end as error from fx_aoi, audience",
    "narrative_qa": """select o_orderkey, n_words, n_words between 140 and 170 as right_length, n_missing, true as plain_text, n_words between 140 and 170 and n_missing = 0 as passed from (
        select o_orderkey, len(regexp_split_to_array(trim(narrative), '\\s+')) as n_words,
          len([x for x in list_distinct(regexp_extract_all(summary, '-?\\d+(?:\\.\\d+)?')) if not list_contains(regexp_extract_all(narrative, '-?\\d+(?:\\.\\d+)?'), x)]) as n_missing from spoken) t""",
    "geojson_export": """select session_id, count(*) as n_features, round(arg_min(west, event_id), 6) as west, round(arg_min(south, event_id), 6) as south from drawn
        where action <> 'deleted' and event_id % 5 <> 0 group by session_id""",
    "place_search": """select query_id, rank, place_id, lat::double as lat, lon::double as lon from (select *, row_number() over (partition by query_id order by display_name, place_id) as rank from found) t where rank <= 5""",
    "latest_shape": """select session_id, case when action = 'created' then round(north, 6) else 0 end as north, case when action = 'created' then round(south, 6) else 0 end as south,
        case when action = 'created' then round(east, 6) else 0 end as east, case when action = 'created' then round(west, 6) else 0 end as west, action = 'deleted' as is_empty
        from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as k from drawn where action in ('created', 'deleted')) t where k = 1""",
    "debounce": "select * from fired",
    "stream_requests": "select event_id as request_id, (user_id % 25)::int as aoi_id, terrain_type from events left join terrain on terrain.aoi_id = (user_id % 25)",
}

_NEAR = "round((lon - x) * (lon - x) + (lat - y) * (lat - y), 12)"


def _nearest(x0: str, y0: str, step: str, rows: int, cols: int, pixels: str, value: str, reach: str) -> str:
    grid = f"select r as tr, c as tc, {x0} + (c + 0.5e0) * {step} as x, {y0} - (r + 0.5e0) * {step} as y from (select unnest(range({rows})) as r) a, (select unnest(range({cols})) as c) b"
    met = f"select tr, tc, arg_min({value}, [{_NEAR}, r, c]) as {value} from ({grid}) g join {pixels} on {_NEAR} <= {reach} * {reach} group by tr, tc"
    return f"""select tr as "row", tc as col, {value} from ({grid}) g left join ({met}) m using (tr, tc)"""


QUERIES |= {
    "regrid_fine": _nearest("36.61e0", "-1.12e0", "0.0037e0", 70, 80, "(select * from fx_dem where r % 3 <> 1) p", "elevation", "0.02e0"),
    "cube_aligned": f"""select * from ({_nearest("36.6e0", "-1.1e0", "0.015e0", 20, 20, "fx_dem", "elevation", "0.08e0")}) a
        join ({_nearest("36.6e0", "-1.1e0", "0.015e0", 20, 20, "(select * from fx_lc where r % 4 = 0 and c % 4 = 0) p", "code", "0.08e0")}) b using ("row", col)""",
    "terrain_rollup": f"""select coalesce(region, -1) as region, coalesce(aoi_id, -1) as aoi_id, level, n, {_ELEVATION} from (
        select region, aoi_id, 2 - grouping(region) - grouping(aoi_id) as level, count(*) as n, avg(v) as mean, min(v) as min, max(v) as max, stddev_pop(v) as std from (
          select aoi_id % 4 as region, aoi_id, elevation as v from center join fx_dem using (r, c) where elevation <> -32768) p group by rollup (region, aoi_id)) t""",
    "context_store": "select aoi_id, elevation_range_m, terrain_type from terrain",
    "geojson_files": QUERIES["geojson_export"],
    "scene_table_search": """select aoi_id, scene_id from wide_box b join fx_footprint s on b.minx <= s.maxx and b.maxx >= s.minx and b.miny <= s.maxy and b.maxy >= s.miny
        where aoi_id < 100 and scene_id % 5 <> 0 and scene_id % 120 <= 90 and scene_id % 100 < 30""",
    "live_requests": QUERIES["stream_requests"],
    "live_shapes": QUERIES["latest_shape"],
}

#: The limit on the area in square kilometres, where it isn't 50.
LIMITS = {"ndvi_stats": 100, "ndvi_quartiles_approx": 100}


def _parts(sql: str) -> list[str]:
    names, wanted, todo = list(PARTS), set(), [sql]
    while todo:
        words = "".join(c if c.isalnum() or c == "_" else " " for c in todo.pop()).split()
        for name in names:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(PARTS[name])
    return [n for n in names if n in wanted]


def sql() -> dict[str, str]:
    out = {}
    for name, text in QUERIES.items():
        parts = ", ".join(f"{p} as materialized ({PARTS[p]})" for p in _parts(text))
        parts = parts.replace("{as_of}", AS_OF).replace("{limit}", str(LIMITS.get(name, 50)))
        # Only scenes that the search found go into a composite for areas.
        parts = parts.replace("{only}", "where scene_id in (select scene_id from search)" if "veg" in _parts(text) else "")
        out[name] = with_views(text, parts)
    return out

"""Tables derived from the given ones, in SQL that Spark and DuckDB read alike, so that each operator can be compared.

Areas come from nation, pixels and scenes from lineitem, drawing events from events, places from part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("nation", "lineitem", "events", "part", "orders", "customer")

VIEWS = {
    "fx_aoi": """select n_nationkey as aoi_id, n_nationkey % 4 as kind, 36.6613e0 + 0.011e0 * (n_nationkey * 7 % 25) as x0, -1.1387e0 - 0.011e0 * (n_nationkey * 11 % 25) as y0, 0.0107e0 + 0.0046e0 * (n_nationkey % 8) as h from nation""",
    "fx_shape": """select * from (values
(0,0,0,-1e0,0e0),(0,0,1,0e0,-1e0),(0,0,2,1e0,0e0),(0,0,3,0e0,1e0),(0,0,4,-1e0,0e0),
(1,0,0,-1e0,-1e0),(1,0,1,1e0,-1e0),(1,0,2,1e0,1e0),(1,0,3,-1e0,1e0),(1,0,4,-1e0,-1e0),
(2,0,0,-1e0,-1e0),(2,0,1,1e0,-1e0),(2,0,2,1e0,1e0),(2,0,3,-1e0,1e0),(2,0,4,-1e0,-1e0),
(2,1,0,-0.4e0,-0.4e0),(2,1,1,-0.4e0,0.4e0),(2,1,2,0.4e0,0.4e0),(2,1,3,0.4e0,-0.4e0),(2,1,4,-0.4e0,-0.4e0),
(3,0,0,-1e0,-1e0),(3,0,1,1e0,-1e0),(3,0,2,1e0,0e0),(3,0,3,0e0,0e0),(3,0,4,0e0,1e0),(3,0,5,-1e0,1e0),(3,0,6,-1e0,-1e0)
) as v(kind, ring, i, dx, dy)""",
    "fx_aoi_vertex": """select aoi_id, ring, i, x0 + h * dx as x, y0 + h * dy as y from fx_aoi join fx_shape on fx_aoi.kind = fx_shape.kind""",
    "fx_aoi_edge": """select a.aoi_id, a.ring, a.i, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from fx_aoi_vertex a join fx_aoi_vertex b on a.aoi_id = b.aoi_id and a.ring = b.ring and b.i = a.i + 1""",
    "fx_cell": """select r, c, 36.60e0 + (c + 0.5e0) * 0.01e0 as lon, -1.10e0 - (r + 0.5e0) * 0.01e0 as lat from (select distinct l_orderkey % 40 as r, l_partkey % 40 as c from lineitem) t""",
    "fx_dem": """select r, c, lon, lat, cast(case when (r * 5 + c * 3) % 17 = 0 then -32768 else 1500 + r * c % 7 + (case when c < 14 then 0 when c < 27 then r * 4 % 97 else r * 31 % 611 end) end as double) as elevation from fx_cell""",
    "fx_lc": """select r, c, lon, lat, cast(case (r * 7 + c * 13 + r * c) % 13 when 0 then 0 when 1 then 10 when 2 then 20 when 3 then 30 when 4 then 40 when 5 then 50 when 6 then 60 when 7 then 80 when 8 then 90 when 9 then 95 when 10 then 100 when 11 then 70 else 77 end as int) as code from fx_cell""",
    "fx_scene_px": """select scene_id, r, c, min(b04) as b04, min(b08) as b08, min(scl) as scl from (select ((l_orderkey * 7 + l_linenumber * 13 + l_suppkey * 3) % 180) * 2 + l_linenumber % 2 as scene_id, l_orderkey % 40 as r, l_partkey % 40 as c, 200 + l_partkey * 17 % 2800 as b04, 400 + cast(floor(l_extendedprice) as bigint) % 5000 as b08, (l_linenumber + l_partkey + cast(floor(l_quantity) as bigint)) % 12 as scl from lineitem) t where scene_id % 3 = 0 or (scene_id % 3 = 1 and c < 20) or (scene_id % 3 = 2 and c >= 20) group by scene_id, r, c""",
    "fx_scene": """select scene_id, 'sentinel-2-l2a' as collection, timestamp '2024-01-01 10:00:00' + interval 1 day * (scene_id / 2 - scene_id % 2 * 0.5e0) as dt, cast(scene_id * 37 % 100 as double) as cloud_cover, case when scene_id % 3 = 2 then 36.80e0 else 36.60e0 end as minx, -1.50e0 as miny, case when scene_id % 3 = 1 then 36.80e0 else 37.00e0 end as maxx, -1.10e0 as maxy from (select distinct scene_id from fx_scene_px) t""",
    "fx_modis": """select month, half, r, c, case when (r + c + month) % 19 = 0 then -3000 when (r + c + month) % 23 = 0 then -2000 else (r * 61 + c * 37 + month * 101 + half * 13) % 11000 - 1000 end as raw from fx_cell cross join (select * from (values (1),(2),(4),(7),(9)) as m(month)) m cross join (select * from (values (1),(2)) as h(half)) h""",
    "fx_draw": """select event_id, ts, user_id as session_id, case event_type when 'view' then 'created' when 'click' then 'edited' when 'error' then 'deleted' end as action, 36.60e0 + floor(value) % 40 * 0.01e0 as west, -1.50e0 + floor(value) % 37 * 0.01e0 as south from events where event_type in ('view', 'click', 'error')""",
    "fx_place": """select p_partkey as place_id, p_name as display_name, cast(-1 - p_partkey % 50 as string) as lat, cast(36 + p_partkey % 3 as string) as lon from part""",
    "fx_wide_px": """select distinct l_orderkey as px, 20e0 + (l_orderkey * 7919 % 6007) * 0.005e0 as lon, -15e0 + (l_orderkey * 104729 % 5003) * 0.006e0 as lat from lineitem""",
    "fx_wide_vertex": """select a.aoi_id, ring, i, 35e0 + 0.9e0 * (a.aoi_id % 5 - 2) + 14e0 * h * 25 / (1 + a.aoi_id % 7) * dx as x, 0.3e0 * (a.aoi_id % 3) + 14e0 * h * 25 / (1 + a.aoi_id % 7) * dy as y from fx_aoi a join fx_shape on a.kind = fx_shape.kind""",
    "fx_footprint": """select o_orderkey as scene_id, x - w as minx, y - w / 3 as miny, x + w as maxx, y + w / 3 as maxy from (select o_orderkey, o_orderkey * 7919 % 360 - 180e0 as x, o_orderkey * 104729 % 170 - 85e0 as y,
case o_orderkey % 7 when 0 then 0.01e0 when 1 then 0.3e0 when 2 then 0.5e0 when 3 then 4e0 when 4 then 17e0 when 5 then 60e0 else 180e0 end as w from orders) t""",
    "fx_tile": """select * from (values ('T0','nasadem',36.60e0,-1.50e0,36.80e0,-1.10e0),('T1','nasadem',36.80e0,-1.50e0,37.00e0,-1.10e0),('W0','esa-worldcover',36.60e0,-1.50e0,36.75e0,-1.10e0),('W1','esa-worldcover',36.78e0,-1.50e0,36.85e0,-1.10e0)) as t(tile_id, collection, minx, miny, maxx, maxy)""",
}

PIXEL = 0.01
AS_OF = "2024-06-29"


def needed(sql: str) -> list[str]:
    """The derived tables that a query names, with those that they need, in order."""
    names = list(VIEWS)
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in wanted and _names(text, name):
                wanted.add(name)
                todo.append(VIEWS[name])
    return [n for n in names if n in wanted]


def _names(sql: str, table: str) -> bool:
    words = "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()
    return table in words


def with_views(sql: str, more: str = "") -> str:
    """The query with the derived tables before it, as DuckDB reads it; more holds further named queries."""
    parts = [f"{n} as ({VIEWS[n]})" for n in needed(sql + " " + more)]
    parts += [more] if more else []
    return f"with {', '.join(parts)} {sql}" if parts else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table over the Parquet files of a folder."""
    sql = f"select * from {name}"
    parts = [f"{n} as ({VIEWS[n]})" for n in needed(sql)]
    given = [f"{g} as (select * from parquet.`{sf_dir}/{g}.parquet`)" for g in GIVEN if any(_names(p, g) for p in [*parts, sql])]
    return spark.sql(f"with {', '.join([*given, *parts])} {sql}")

"""SQL twins of the views in ``sources.tables`` and a small WITH builder."""

from __future__ import annotations

from ..sources import tables as t

_GRID_DAY = ("CAST(DATE '2025-01-01' + CAST(date_diff('day', DATE '1995-01-01', "
             "CAST(l_shipdate AS DATE)) % 365 AS INTEGER) AS DATE)")
_ZONE = ("CAST(l_suppkey // 20 AS INTEGER) AS zone, CAST(l_partkey % 20 AS INTEGER) AS r, "
         "CAST(l_suppkey % 20 AS INTEGER) AS c")
_SHIP = "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"


def _pick(values, index):
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


VIEWS = {
    "ice_cells": f"""SELECT {_GRID_DAY} AS day, CAST(l_partkey % 20 AS INTEGER) AS r,
        CAST(l_suppkey AS INTEGER) AS c,
        avg(CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END) AS sic
        FROM lineitem GROUP BY 1, 2, 3""",
    "current_cells": f"""SELECT {_GRID_DAY} AS day, CAST(l_partkey % 20 AS INTEGER) AS r,
        CAST(l_suppkey AS INTEGER) AS c, avg(l_discount * 10 - 0.5) AS u, avg(l_tax * 10 - 0.4) AS v
        FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2, 3""",
    "products": f"""SELECT {_GRID_DAY} AS day, CAST(l_partkey % 20 AS INTEGER) AS r,
        CAST(l_suppkey AS INTEGER) AS c, avg(l_quantity * 2.2) AS a, avg(l_discount * 1000) AS b,
        max(l_linenumber) AS flags FROM lineitem GROUP BY 1, 2, 3""",
    "sightings": """SELECT user_id AS iceberg_id, event_type AS sensor, CAST(ts AS DATE) AS day,
        -60 - (user_id * 7 % 170) / 10.0 - (event_id % 5) / 10.0 AS lat,
        (user_id * 29 % 360) - 180 + (event_id % 5) / 5.0 AS lon,
        CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END END AS flag,
        event_id AS src,
        CASE WHEN event_id % 7 <> 0 THEN k / 10.0 - 5 END AS wind_u,
        CASE WHEN event_id % 7 <> 0 THEN value / 50 END AS wind_v,
        CASE WHEN event_id % 5 <> 0 THEN (k % 10) / 20.0 - 0.2 END AS cur_u,
        CASE WHEN event_id % 5 <> 0 THEN (k % 13) / 30.0 - 0.2 END AS cur_v,
        CASE WHEN k % 20 > 0 THEN (k % 20) * CAST(1.852 AS DOUBLE) END AS size_km
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "observations": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY iceberg_id, sensor, day ORDER BY src DESC) AS rn FROM sightings) WHERE rn = 1""",
    "bergs": """SELECT CAST(c_nationkey % 4 AS INTEGER) AS bucket, c_custkey AS iceberg_id,
        -70 + (c_custkey * 37 % 1000) / 100.0 AS lat, (c_custkey * 53 % 2000) / 100.0 AS lon,
        CAST(c_nationkey + 15 AS DOUBLE) AS radius_km FROM customer""",
    "cell_geo": """SELECT r, c, -70 + r * CAST(0.1 AS DOUBLE) AS lat, c * CAST(0.2 AS DOUBLE) AS lon FROM (SELECT DISTINCT
        CAST(l_partkey % 100 AS INTEGER) AS r,
        CAST((l_suppkey * 7 + l_linenumber) % 100 AS INTEGER) AS c FROM lineitem)""",
    "polygons": f"""SELECT CAST(p AS INTEGER) AS polygon_id,
        CASE WHEN p % 50 = 0 THEN 'W' WHEN p % 97 = 0 THEN 'L' ELSE 'I' END AS POLY_TYPE,
        CASE WHEN p % 50 = 0 THEN '00' ELSE {_pick(t.CT_PICKS, 'p + s')} END AS CT,
        CASE WHEN p % 6 = 0 THEN '-9' ELSE {_pick(t.PARTIAL_PICKS, 's')} END AS CA,
        CASE WHEN p % 6 = 0 OR p % 3 = 0 THEN '-9' ELSE {_pick(t.PARTIAL_PICKS[:3], 'p')} END AS CB,
        CASE WHEN p % 6 = 0 OR p % 3 <> 1 OR s % 2 = 0 THEN '-9' ELSE '10' END AS CC,
        CASE WHEN p % 50 = 0 THEN '-9' ELSE {_pick(t.STAGE_PICKS, 'p')} END AS SA,
        CASE WHEN (p % 3 = 0 AND s % 4 <> 0) OR p % 6 = 0 THEN '-9'
             ELSE {_pick(t.STAGE_PICKS[:5], 'p + s')} END AS SB,
        CASE WHEN p % 3 <> 1 OR s % 2 = 0 OR p % 6 = 0 THEN '-9'
             ELSE {_pick(t.STAGE_PICKS[:5], 's')} END AS SC,
        CASE WHEN s % 5 = 0 THEN '98' ELSE '-9' END AS SO
        FROM (SELECT p_partkey AS p, p_size AS s FROM part)""",
    "cell_polygon_area": f"""SELECT {_ZONE}, CAST(l_partkey % 50 AS INTEGER) AS polygon_id,
        sum(l_quantity) / 800.0 AS area_share FROM lineitem GROUP BY 1, 2, 3, 4""",
    "cost_cells": f"""SELECT {_ZONE}, CAST({_SHIP} % {t.BUCKETS} AS INTEGER) AS bucket,
        CASE WHEN min(l_quantity) > 2 THEN avg(l_quantity * 2) END AS sic,
        avg(l_discount * 10 - 0.5) AS u, avg(l_tax * 10 - 0.4) AS v,
        sum(l_linenumber) % 11 = 0 AS shelf,
        (CAST(l_partkey % 20 AS INTEGER) * 7 + CAST(l_suppkey % 20 AS INTEGER) * 3) % 23 = 0 AS land
        FROM lineitem GROUP BY ALL""",
    "route_points": f"""SELECT l_orderkey AS route_id, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS seq, {_ZONE} FROM lineitem""",
}

# which views a view is itself built on
_USES = {"observations": ["sightings"]}


def define(name: str, body: str, uses: list[str] = ()) -> None:
    """Add a shared step that several SQL twins read."""
    VIEWS[name] = body
    _USES[name] = list(uses)


def using(names: str, body: str, also: str = "") -> str:
    """``WITH`` the named views (and what they need), then ``also``, in front of ``body``."""
    order: list[str] = []
    def add(n):
        for dep in _USES.get(n, ()):
            add(dep)
        if n not in order:
            order.append(n)
    for n in names.split():
        add(n)
    members = [f"{n} AS ({VIEWS[n]})" for n in order] + ([also] if also else [])
    return "WITH " + ",\n".join(members) + "\n" + body


def gc_m(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    """Great-circle metres."""
    dl = f"((({lon_b} - {lon_a}) + 540.0) % 360.0 + 360.0) % 360.0 - 180.0"
    return (f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat_b} - {lat_a}) / 2), 2) + "
            f"cos(radians({lat_a})) * cos(radians({lat_b})) * pow(sin(radians({dl}) / 2), 2))))")

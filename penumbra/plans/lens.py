"""Deterministic views that turn the sample tables into walking data, in SQL that Spark and DuckDB both read.

Each view names the tables or views that it needs as {braces}. Spark gets DataFrames for them, the
SQL that results are checked against gets common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[list[str], str]] = {
    "nodes": (["part"], """SELECT p_partkey AS id, p_partkey % 50 AS gx, CAST(floor(p_partkey / 5e1) AS BIGINT) AS gy, 37.49e0 + CAST(floor(p_partkey / 5e1) AS BIGINT) * 4.5e-4 AS lat, 127.02e0 + (p_partkey % 50) * 5.65e-4 AS lon,
        (127.02e0 + (p_partkey % 50) * 5.65e-4 - 127.032e0) * (111320e0 * cos(radians(37.498e0))) AS x, (37.49e0 + CAST(floor(p_partkey / 5e1) AS BIGINT) * 4.5e-4 - 37.498e0) * 110540e0 AS y,
        p_size AS size, p_type AS type, p_brand AS brand FROM {part}"""),
    "edges": (["nodes"], """SELECT a.id * 2 + CASE WHEN b.id = a.id + 50 THEN 1 ELSE 0 END AS edge_id, a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length,
        a.type = 'PROMO' AS covered, a.size % 13 = 0 AS steps, a.brand = 'Brand#7' AS fallback, CASE WHEN a.size % 10 = 0 THEN 'forward' WHEN a.size % 10 = 5 THEN 'backward' ELSE 'both' END AS direction, a.id % 997 AS way_id
        FROM {nodes} AS a JOIN (SELECT *, id - 50 AS beside FROM {nodes} UNION ALL SELECT *, id - 1 AS beside FROM {nodes}) AS b ON b.beside = a.id WHERE b.id = a.id + 50 OR b.gy = a.gy"""),
    "buildings": (["nodes"], """SELECT id, x + 8e0 AS x0, x + 24e0 + size % 6 AS x1, y + 8e0 AS y0, y + 24e0 + size % 5 AS y1, CASE WHEN size % 3 = 0 THEN CAST(size AS DOUBLE) WHEN size % 3 = 1 THEN size * 3.3e0 ELSE 12e0 END AS height,
        size % 3 <> 0 AS estimated, size % 3 = 2 AS missing FROM {nodes} WHERE size % 4 <> 0"""),
    "gps": (["events"], """SELECT event_id, user_id, ts, 37.498e0 + ((event_id * 7919) % 1000 - 500) * 2e-6 AS lat, 127.032e0 + ((event_id * 104729) % 1000 - 500) * 1e-6 AS lon, CAST((event_id * 31) % 60 AS DOUBLE) AS acc FROM {events}"""),
    "weather": (["events"], """SELECT event_id, ts, value / 1e1 AS feels, value / 4e1 AS uv, event_id % 24 BETWEEN 6 AND 18 AS is_day, CAST(event_id % 100 AS INT) AS code, CAST((event_id % 3) * 30 AS INT) AS offset_minutes FROM {events}"""),
    "feedback": (["events"], """SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'good' WHEN 'view' THEN 'mid' WHEN 'error' THEN 'bad' ELSE 'none' END AS verdict, CASE WHEN event_id % 4 = 0 THEN '=' WHEN event_id % 4 = 1 THEN '-' ELSE '' END || props AS memo,
        CAST(event_id % 37 AS VARCHAR(9)) AS path_key FROM {events}"""),
    "requests": (["nodes"], """SELECT id AS request_id, id AS start, (id * 7 + 101) % (SELECT count(*) FROM {nodes}) AS goal FROM {nodes} WHERE id % 10 = 0"""),
    "places": (["customer"], """SELECT 'osm-node-' || c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'station' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_mktsegment = 'FURNITURE' THEN 'store' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'food' ELSE 'cafe' END AS kind,
        CASE WHEN c_custkey % 3 = 0 THEN 'Market ' WHEN c_custkey % 3 = 1 THEN 'Garden-' ELSE 'Old Mill ' END || CAST(c_custkey % 200 AS VARCHAR(9)) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'Street ' || CAST(c_nationkey AS VARCHAR(9)) END AS address,
        CASE WHEN c_custkey % 5 = 0 THEN 'Gate ' || CAST(c_custkey % 31 AS VARCHAR(9)) END AS alias, 37.49e0 + (c_custkey % 17) * 1e-3 AS lat, 127.02e0 + (c_custkey % 23) * 1e-3 AS lon, c_custkey AS seq FROM {customer}"""),
    "summaries": (["nodes"], """SELECT id AS request_id, m.mode, 60e0 * (1 + (id * 3 + m.k) % 40) + id % 59 AS time_sec, CAST(75 * (1 + (id * 3 + m.k) % 45) AS DOUBLE) AS length_m, 60e0 * ((id * 5 + m.k * 7) % 30) + id % 53 AS sun_sec, ((id + m.k) % 11) / 1e1 AS shade_ratio, id || ':' || m.k AS path_key
        FROM {nodes} CROSS JOIN (SELECT 'shortest' AS mode, 0 AS k UNION ALL SELECT 'balanced', 1 UNION ALL SELECT 'maxShade', 2) AS m"""),
    "segments": (["events"], """SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(CAST(floor(value) AS BIGINT) % 40 AS DOUBLE) AS meters, event_type = 'signup' AS connector, event_type = 'view' AS covered, event_type = 'error' AS steps,
        (event_id % 101) / 1e2 AS shade, 37.49e0 + (event_id % 97) * 1e-4 AS lat, 127.02e0 + (event_id % 89) * 1e-4 AS lon FROM {events}"""),
    "tags": (["orders"], """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'footway' WHEN '2-HIGH' THEN ' Steps' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'PRIMARY' ELSE 'motorway' END AS highway,
        CASE WHEN o_orderkey % 7 = 0 THEN 'private' WHEN o_orderkey % 7 = 1 THEN 'yes' END AS access, CASE WHEN o_orderkey % 5 = 0 THEN 'designated' WHEN o_orderkey % 5 = 1 THEN 'no' END AS foot,
        CASE o_orderstatus WHEN 'F' THEN 'no' WHEN 'O' THEN 'separate' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'both' END END AS sidewalk, CASE WHEN o_orderkey % 11 = 0 THEN 'yes' WHEN o_orderkey % 11 = 1 THEN '-1' WHEN o_orderkey % 11 = 2 THEN 'odd' END AS oneway_foot,
        CASE WHEN o_orderkey % 13 = 0 THEN 'forward' WHEN o_orderkey % 13 = 1 THEN 'yes' WHEN o_orderkey % 13 = 2 THEN 'no' END AS conveying, CASE WHEN o_orderkey % 17 = 0 THEN 'no' END AS foot_backward, CASE WHEN o_orderkey % 19 = 0 THEN 'mountain_hiking' WHEN o_orderkey % 19 = 1 THEN 'alpine_hiking' END AS sac_scale,
        CASE WHEN o_orderkey % 23 = 0 THEN 'yes' END AS locked, CASE WHEN o_orderkey % 29 = 0 THEN 'yes' WHEN o_orderkey % 29 = 1 THEN 'no' END AS tunnel,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS VARCHAR(9)) || ' m' WHEN o_orderkey % 3 = 1 THEN '12.5ft' END AS height, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR(9)) END AS levels FROM {orders}"""),
    "ways": (["lineitem"], """SELECT l_orderkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM {lineitem}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the sample data, or a view over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    made = spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})
    # A node is a few bytes in its file but many in memory, so Spark must not choose to broadcast all of them.
    return made.hint("merge") if name == "nodes" else made


def with_views(*names: str) -> str:
    """WITH clause that defines the views, and what they need, as lens_<name>."""
    order: list[str] = []

    def visit(name):
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"lens_{n} AS ({VIEWS[n][1].format(**{m: f'lens_{m}' if m in VIEWS else m for m in VIEWS[n][0]})})" for n in order]
    return "WITH " + ", ".join(parts)

"""Domain relations derived from the driver's tables by integer arithmetic that Spark and DuckDB share."""

from __future__ import annotations

LON, LAT = 8.5285, 52.0180
#: A metre in degrees at the area's latitude, near enough to lay out test geometry.
EAST, NORTH = 1 / 68_500, 1 / 111_260

IMAGES = f"""SELECT event_id AS id, user_id AS sequence, event_id AS ord, ts AS captured_at, {LON} + (event_id * 7919 % 10000) / 1000000.0 AS lon,
  {LAT} + (event_id * 104729 % 12000) / 1000000.0 AS lat, (event_id * 7919 % 10000) * 0.0685 AS x, (event_id * 104729 % 12000) * 0.11126 AS y,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id * 37 % 360 AS DOUBLE) END AS heading, event_id % 11 = 0 AS is_pano,
  CASE WHEN event_id % 17 = 0 THEN 'fisheye' WHEN event_id % 5 = 0 THEN NULL ELSE 'perspective' END AS camera_type,
  event_id % 3 = 0 AS on_foot, event_id % 10 AS quality, (event_id % 150) / 100.0 AS focal, event_id * 31 % 40 AS sfm_shift, event_id % 29 AS road_gap FROM {{events}}"""

#: Anchors on a lattice of 40 m; views are scattered by less than 4 m, and every 23rd lies apart.
DETECTIONS = f"""SELECT id, frame_id, image_id, feature_index, type, confidence, permanence, usable, height_cm, captured_at, source, mx, my,
  {LON} + mx * {EAST} AS lon, {LAT} + my * {NORTH} AS lat FROM (
  SELECT event_id AS id, 'f' || CAST(event_id {{div}} 2 AS STRING) AS frame_id, 'i' || CAST(event_id {{div}} 3 AS STRING) AS image_id, event_id % 2 AS feature_index,
    CASE event_id * 7919 % (n {{div}} 5 + 1) % 8 WHEN 0 THEN 'stairs' WHEN 1 THEN 'raised_curb' WHEN 2 THEN 'curb_ramp' WHEN 3 THEN 'rough_surface'
      WHEN 4 THEN 'narrow' WHEN 5 THEN 'obstacle' WHEN 6 THEN 'steep' ELSE 'construction' END AS type,
    (30 + event_id * 13 % 70) / 100.0 AS confidence, CASE WHEN event_id % 19 = 0 THEN 'temporary' WHEN event_id % 7 = 0 THEN NULL ELSE 'permanent' END AS permanence,
    event_id % 31 <> 0 AS usable, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 25 END AS height_cm, ts AS captured_at,
    CASE WHEN event_type = 'error' THEN 'fallback' WHEN event_type = 'view' THEN 'model' ELSE 'box_bottom' END AS source,
    event_id * 7919 % (n {{div}} 5 + 1) % 50 * 40 + (event_id * 31 % 9 - 4) * 0.97 + CASE WHEN event_id % 23 = 0 THEN 20 ELSE 0 END AS mx,
    event_id * 7919 % (n {{div}} 5 + 1) {{div}} 50 * 40 + (event_id * 17 % 9 - 4) * 0.97 AS my
  FROM {{events}}, (SELECT count(*) AS n FROM {{events}}) c) d"""

#: A walking lattice of 40 columns, 40 m apart; every customer stands for a crossing.
NODES = "SELECT c_custkey AS node, c_custkey % 40 * 40.0 AS x, c_custkey {div} 40 * 40.0 AS y, c_mktsegment AS segment FROM {customer}"
#: A node has one edge to the east and one to the north at most, which numbers them without a window.
EDGES = f"""SELECT edge, u, v, 40.0 AS length, surface, (u * 3 + v) % 17 = 0 AS steps, (u + v * 5) % 29 = 0 AS wheelchair_no, x1, y1, x2, y2 FROM (
  SELECT a.node * 2 AS edge, a.node AS u, b.node AS v, a.segment AS surface, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ({NODES}) a JOIN ({NODES}) b ON b.node = a.node + 1 WHERE a.node % 40 <> 39
  UNION ALL SELECT a.node * 2 + 1, a.node, b.node, a.segment, a.x, a.y, b.x, b.y FROM ({NODES}) a JOIN ({NODES}) b ON b.node = a.node + 40) e"""

FEEDBACK = """SELECT event_id AS id, 'b' || CAST(user_id % 50 AS STRING) AS barrier_id, CASE WHEN event_type IN ('click', 'view') THEN 'confirm' ELSE 'reject' END AS verdict,
  ts AS created_at, 'h' || CAST(user_id % 11 AS STRING) AS ip_hash FROM {events}"""

#: Images with what a search tells of them; times in milliseconds over some seven years, positions also as first reported.
META = f"""SELECT id, ord, CASE WHEN id % 10 <> 3 THEN CAST(floor(x / 40) AS BIGINT) * 100 + CAST(floor(y / 40) AS BIGINT) END AS sequence, 1500000000000 + id * 86400000 % 220000000000 AS captured_at, lon, lat, x, y, x + sfm_shift * 0.45 AS raw_x, y + sfm_shift * 0.2 AS raw_y,
  heading, is_pano, camera_type, on_foot, quality * 1.0 AS quality, focal FROM ({IMAGES}) i0"""
NOW_S = 1_720_000_000
#: Major roads in the images' metres, a nation each.
ROADS = "SELECT n_nationkey AS edge, n_nationkey * 37 % 700 * 1.0 AS x1, n_nationkey * 211 % 1300 * 1.0 AS y1, n_nationkey * 37 % 700 + 90.0 AS x2, n_nationkey * 211 % 1300 + 60.0 AS y2 FROM {nation}"
#: Views of the detections' anchors: cameras stand where DETECTIONS has them and look one way per anchor.
VIEWS = f"""SELECT id, frame_id, image_id, feature_index, type, confidence AS raw_confidence, permanence, usable, height_cm, captured_at, lon, lat, id * 7919 % (n {{div}} 5 + 1) % 360 * 1.0 AS heading, 70.0 AS fov,
  1600 AS width, 1200 AS height, 300 AS ymin, 400 + id % 20 AS xmin, CASE WHEN source = 'fallback' THEN 480 ELSE 732 + id % 5 END AS ymax, 600 - id % 20 AS xmax, CASE WHEN source = 'model' THEN 7.5 + id % 4 * 0.25 WHEN id % 3 = 0 THEN 0.0 END AS model_m
  FROM ({DETECTIONS}) d1, (SELECT count(*) AS n FROM {{events}}) c1"""

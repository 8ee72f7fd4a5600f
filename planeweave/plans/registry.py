"""Registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def rd(expr: str, digits: int = 6) -> str:
    """SQL twin of ``numeric.rnd``."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


# SQL twins of the raster views in sources/views.py.
R1 = """r1 AS (
  SELECT 'emb_' || (vec_id // 512) AS image_id, CAST(vec_id // 64 AS INTEGER) AS page, 0 AS channel,
         CAST(vec_id % 64 AS INTEGER) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""

R2 = """r2c AS (
  SELECT 'li_' || (l_orderkey // 32768) AS image_id, CAST(l_orderkey // 4096 AS INTEGER) AS page,
         CAST(l_linenumber % 3 AS INTEGER) AS channel, CAST(l_orderkey % 64 AS INTEGER) AS y,
         CAST(l_partkey % 64 AS INTEGER) AS x, avg(l_quantity) AS value
  FROM lineitem GROUP BY ALL),
r2 AS (
  SELECT p.image_id, p.page, CAST(c.i AS INTEGER) AS channel, CAST(yy.i AS INTEGER) AS y,
         CAST(xx.i AS INTEGER) AS x, coalesce(v.value, CAST('NaN' AS DOUBLE)) AS value
  FROM (SELECT DISTINCT image_id, page FROM r2c) p
  CROSS JOIN range(3) c(i) CROSS JOIN range(64) yy(i) CROSS JOIN range(64) xx(i)
  LEFT JOIN r2c v ON v.image_id = p.image_id AND v.page = p.page AND v.channel = c.i AND v.y = yy.i AND v.x = xx.i)"""

ROWS = """rws AS (
  SELECT 'img_' || l_suppkey AS image_id, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS roi_id,
         o_orderpriority AS "group", l_linestatus AS line_status, l_linenumber AS channel,
         l_quantity AS area, l_extendedprice AS mean, l_discount AS std
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ROIS = """rois AS (
  SELECT *, CASE kind
    WHEN 'polygon' THEN [x, y, x + width, y + 1.25, x + width * 0.75, y + height, x + width * 0.5, y + height * 0.5, x + 0.5, y + height + 1]
    WHEN 'line' THEN [x, y, x + width, y + height]
    WHEN 'polyline' THEN [x, y, x + width, y + 2, x + width, y + height, x + 1, y + height + 2]
    WHEN 'point' THEN [x, y, x + width, y + height, x + 2.5, y - 1.5] END AS points
  FROM (
    SELECT s_suppkey AS roi_id, 'emb_' || ((s_suppkey % pl.n) // 8) AS image_id, CAST(s_suppkey % pl.n AS INTEGER) AS page,
           ['rect','ellipse','polygon','line','polyline','point'][s_suppkey % 6 + 1] AS kind,
           CAST(s_suppkey * 7 % 50 AS DOUBLE) + 0.25::DOUBLE AS x, CAST(s_suppkey * 11 % 50 AS DOUBLE) + 0.5::DOUBLE AS y,
           CAST(4 + s_suppkey % 13 AS DOUBLE) AS width, CAST(5 + s_suppkey % 9 AS DOUBLE) AS height,
           CAST(s_suppkey % 3 AS DOUBLE) * 15 AS angle, CAST(1 + s_suppkey % 3 AS INTEGER) AS line_width
    FROM supplier CROSS JOIN (SELECT max(vec_id) // 64 + 1 AS n FROM embeddings) pl))"""

# 256-bin histogram of every float-stack plane, all bins present.
HIST = R1 + """,
rng AS (SELECT image_id, page, min(value) AS lo, max(value) AS hi FROM r1 WHERE isfinite(value) GROUP BY ALL),
hb AS (
  SELECT r1.image_id, r1.page,
         CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(255, CAST(floor((value - lo) * (256.0::DOUBLE / (hi - lo))) AS INTEGER))) END AS bin
  FROM r1 JOIN rng USING (image_id, page) WHERE isfinite(value)),
h AS (
  SELECT g.image_id, g.page, g.lo, g.hi, CAST(b.i AS INTEGER) AS bin, coalesce(c.n, 0) AS n
  FROM rng g CROSS JOIN range(256) b(i)
  LEFT JOIN (SELECT image_id, page, bin, count(*) AS n FROM hb GROUP BY ALL) c
    ON c.image_id = g.image_id AND c.page = g.page AND c.bin = b.i)"""

NAMES = """fn AS (
  SELECT page_id, '/data/' || lang || '/' || lang || '_' || num || '_' || page_id || ext AS path,
         CASE WHEN page_id % 10 = 3 THEN 'dicom' WHEN page_id % 10 = 7 THEN 'bogus' END AS hint
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]*)', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS num,
        ['.tif','.PNG','.npy','.fits','','.dcm','.czi','.xyz','.tar.nd2'][page_id % 9 + 1] AS ext FROM pages))"""


def number_text_sql(v: str) -> str:
    fixed = f"regexp_replace(printf('%.6f', {v}), '\\.?0+$', '')"
    expo = f"regexp_replace(printf('%.5e', {v}), 'e([+-])0([0-9])', 'e\\1\\2')"
    return f"""(CASE WHEN {v} IS NULL THEN '' WHEN isnan({v}) THEN 'NaN' WHEN isinf({v}) THEN CASE WHEN {v} > 0 THEN 'Inf' ELSE '-Inf' END
      WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR)
      WHEN {v} <> 0 AND (abs({v}) < 1e-4 OR abs({v}) >= 1e10) THEN {expo} ELSE {fixed} END)"""

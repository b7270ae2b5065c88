"""Satellite-shaped views over the relational test tables. One SQL text serves Spark and the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # dense series: one pixel per supplier; near infrared always exceeds red, so no mean falls on an exact zero index
    "px_series": """
        SELECT CAST(l_suppkey AS INT) AS pixel_id, CAST(FLOOR(l_suppkey / 2304) AS INT) AS tile_id,
               CAST(FLOOR((l_suppkey % 2304) / 48) AS INT) AS y, CAST(l_suppkey % 48 AS INT) AS x,
               CAST(l_shipdate AS DATE) AS obs_date, l_tax * 0.5 AS blue, l_discount AS green, l_tax AS red,
               0.1 + l_quantity / 100 AS nir, l_discount * 2 AS swir1,
               CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 32 ELSE 64 END AS fmask
        FROM $lineitem""",
    # 48 x 48 tiles: one pixel per part
    "px_raster": """
        SELECT CAST(FLOOR(l_partkey / 2304) AS INT) AS tile_id, CAST(FLOOR((l_partkey % 2304) / 48) AS INT) AS y,
               CAST(l_partkey % 48 AS INT) AS x, CAST(l_shipdate AS DATE) AS obs_date,
               l_discount AS green, l_tax AS red, l_quantity / 100 AS nir
        FROM $lineitem""",
    # one value per pixel of those tiles
    "px_image": """
        SELECT CAST(FLOOR(l_partkey / 2304) AS INT) AS tile_id, CAST(FLOOR((l_partkey % 2304) / 48) AS INT) AS y,
               CAST(l_partkey % 48 AS INT) AS x, MAX(l_discount) AS green, MIN(l_tax) AS red, MAX(l_quantity / 100) AS nir,
               MAX(CAST(l_quantity AS INT)) AS label
        FROM $lineitem GROUP BY 1, 2, 3""",
    "observations": """
        SELECT CAST(user_id AS INT) AS pixel_id, event_type AS band, CAST(ts AS DATE) AS obs_date, value / 100 AS value
        FROM $events""",
    "granules": """
        SELECT concat('HLS.', CASE WHEN o_orderkey % 2 = 0 THEN 'HLSS30' ELSE 'HLSL30' END, '.T16PDV.',
                      CAST(YEAR(o_orderdate) AS STRING), lpad(CAST(DAYOFYEAR(o_orderdate) AS STRING), 3, '0'),
                      'T', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), '.v2.0') AS granule_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'HLSS30' ELSE 'HLSL30' END AS product,
               CAST(-89.35 + (o_custkey % 62) * 0.1 AS DOUBLE) AS min_lon,
               CAST(-89.25 + (o_custkey % 62) * 0.1 AS DOUBLE) AS max_lon,
               CAST(13.0 + (o_custkey % 35) * 0.1 AS DOUBLE) AS min_lat,
               CAST(13.1 + (o_custkey % 35) * 0.1 AS DOUBLE) AS max_lat,
               ROUND(o_totalprice % 100, 2) AS cloud_cover, o_orderdate AS begin_ts
        FROM $orders""",
    # nested metadata of the same granules
    "granule_json": """
        SELECT o_orderkey, concat('{"umm":{"GranuleUR":"G', CAST(o_orderkey AS STRING),
               '","TemporalExtent":{"RangeDateTime":{"BeginningDateTime":"', CAST(CAST(o_orderdate AS DATE) AS STRING),
               'T00:00:00.000Z"}},"AdditionalAttributes":[{"Name":"PROCESSING","Values":["x"]},',
               '{"Name":"CLOUD_COVERAGE","Values":["', CAST(ROUND(o_totalprice % 100, 2) AS STRING), '"]}]}}') AS metadata
        FROM $orders""",
    # asset links of each granule, blank-separated; every fifth granule lacks its near-infrared asset
    "granule_links": """
        SELECT CONCAT('G', CAST(o_orderkey AS STRING)) AS granule_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'HLSS30' ELSE 'HLSL30' END AS product,
               CONCAT('h/g.B01.tif h/g.B02.tif h/g.B03.tif h/g.B04.tif ',
                      CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'h/g.B8A.tif ' ELSE 'h/g.B05.tif ' END,
                      CASE WHEN o_orderkey % 2 = 0 THEN 'h/g.B11.tif ' ELSE 'h/g.B06.tif ' END,
                      'h/g.Fmask.tif h/copy.B02.tif') AS link_text
        FROM $orders""",
    "tokens": """
        SELECT vec_id, CAST(FLOOR(vec_id / 576) AS INT) AS tile_id, CAST(FLOOR((vec_id % 576) / 24) AS INT) AS tok_row,
               CAST(vec_id % 24 AS INT) AS tok_col, embedding, label
        FROM $embeddings""",
    "predictions": """
        SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 1 AS INT) AS label,
               CAST(CAST(l_quantity AS INT) % 7 AS INT) AS predicted, l_discount AS loss
        FROM $lineitem""",
    "reference_points": """
        SELECT n_nationkey AS ref_id, step,
               0.45 + 0.25 * SIN((step - n_nationkey % 13) / 2) + 0.01 * FLOOR(n_nationkey / 13) AS vi
        FROM (SELECT n_nationkey, $steps AS step FROM $nation)""",
    "patch_files": """
        SELECT s_suppkey, s_acctbal, concat('t', CAST(s_nationkey AS STRING), '_20231patch_',
               lpad(CAST(s_suppkey AS STRING), 6, '0'), '.nc') AS file_name
        FROM $supplier""",
    "scene_files": """
        SELECT concat('t', CAST(l_suppkey % 48 AS STRING), '_', CAST(YEAR(l_shipdate) AS STRING),
                      CAST(l_linenumber AS STRING), 'patch_', lpad(CAST(l_suppkey AS STRING), 6, '0'), '.nc') AS file_name
        FROM $lineitem""",
    "metrics_rows": """
        SELECT CAST(DAY(ts) AS INT) AS epoch, event_id AS iter, event_type AS name, value FROM $events""",
    # monthly classes per pixel: three of four pixels are mostly crops
    "class_map": """
        SELECT CAST(l_suppkey AS INT) AS pixel_id, CAST(FLOOR(l_suppkey / 2304) AS INT) AS tile_id,
               CAST(FLOOR((l_suppkey % 2304) / 48) AS INT) AS y, CAST(l_suppkey % 48 AS INT) AS x,
               CAST(l_shipdate AS DATE) AS obs_date,
               CAST(CASE WHEN l_linenumber <= 4 THEN 11 + l_suppkey % 4 ELSE CAST(l_quantity AS INT) % 21 + 1 END AS INT) AS class
        FROM $lineitem""",
    # stage days per pixel and month, 0 and missing included
    "stage_days": """
        SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS INT) AS pixel_id, CAST(l_shipdate AS DATE) AS first_date,
               CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity < 5 THEN 0.0 ELSE l_quantity * 2 END AS greenup,
               CASE WHEN l_discount > 0.09 THEN NULL ELSE l_discount * 1500 END AS maturity,
               CASE WHEN l_tax < 0.01 THEN NULL ELSE l_tax * 2000 END AS senescence,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 25.0 END AS dormancy
        FROM $lineitem""",
}

_STEPS = {"spark": "explode(sequence(0, 12))", "sql": "UNNEST(RANGE(0, 13))"}


class Tables:
    """Lazy access to the Parquet tables of one scale factor and to the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("$steps", _STEPS["spark"])
        used = [t for t in TABLES if f"${t}" in text]
        text = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = text.replace(f"${t}", f"{{{t}}}")
        return self._sql(text, used)

    def _sql(self, text: str, used: list[str]) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def to_sql(text: str) -> str:
    """Expand ``$view`` and ``$table`` names for the SQL engine."""
    for name in sorted(VIEWS, key=len, reverse=True):
        text = re.sub(rf"\${name}\b", lambda _: f"({VIEWS[name]})", text)
    text = text.replace("$steps", _STEPS["sql"])
    return re.sub(r"\$(\w+)", r"\1", text)

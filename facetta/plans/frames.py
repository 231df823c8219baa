"""Frame scoring on frames made from line items: an order is an image of 32 x 32 pixels, a line a frame.

The prediction of a frame is the true one moved by tax and discount, with an angle of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetta.plans import tasks as T

SIDE, WIDE, HIGH = 32, 6, 5


def frame_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the rasterised frames, the sum of angle errors and the number of frame pairs of every order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_discount")])

    def frame(left, top, angle):
        corners = F.array(*[F.array(left + a, top + b) for a, b in ((0, 0), (WIDE, 0), (WIDE, HIGH), (0, HIGH))])
        return F.struct((angle * 360).alias("angle"), corners.alias("corners"))

    def pair(line):
        x, y = line.l_linenumber * 3.0, F.floor(line.l_quantity / 4).cast("double")
        dx, dy = (F.floor(F.round(line[c] * 100) / n).cast("double") for c, n in (("l_tax", 2), ("l_discount", 3)))
        return F.struct(frame(x, y, line.l_discount).alias("gt"), frame(x + dx, y + dy, line.l_tax).alias("pred"))

    # lines are gathered, not their frames, which are ten times as wide; a line's two frames stay together: line numbers repeat within an order
    orders = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax", "l_discount"))).alias("lines"))
    orders = orders.select("sample_id", F.transform("lines", pair).alias("pairs"))
    orders = orders.select("sample_id", F.col("pairs.gt").alias("gt"), F.col("pairs.pred").alias("pred"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    found = T.frame_rows(orders)
    return found.select(F.col("sample_id").alias("img"), F.round("jaccard", 6).alias("jaccard"), F.round("angle_error", 4).alias("angle_error"), "n_angles")


QUERIES = {"frame_score": frame_score}
_PIXELS = f"(SELECT DISTINCT img, x + i AS x, y + j AS y FROM (SELECT *, unnest(range({WIDE + 1})) AS i FROM (SELECT *, unnest(range({HIGH + 1})) AS j FROM {{boxes}})))"
_GT = "(SELECT l_orderkey AS img, l_linenumber * 3 AS x, CAST(floor(l_quantity / 4) AS INT) AS y FROM lineitem)"
_PRED = "(SELECT l_orderkey AS img, l_linenumber * 3 + CAST(floor(round(CAST(l_tax AS DOUBLE) * 100) / 2) AS INT) AS x, CAST(floor(l_quantity / 4) AS INT) + CAST(floor(round(CAST(l_discount AS DOUBLE) * 100) / 3) AS INT) AS y FROM lineitem)"
ORACLES = {
    "frame_score": f"""WITH a AS {_PIXELS.replace("{boxes}", _GT)}, b AS {_PIXELS.replace("{boxes}", _PRED)},
 n AS (SELECT img, count(*) AS na FROM a GROUP BY img), m AS (SELECT img, count(*) AS nb FROM b GROUP BY img), c AS (SELECT img, count(*) AS nc FROM a JOIN b USING (img, x, y) GROUP BY img),
 e AS (SELECT l_orderkey AS img, sum(degrees(acos(greatest(-1, least(1, abs(cos(d)) * abs(cos(t)) + sin(d) * sin(t)))))) AS err, count(*) AS k FROM (SELECT l_orderkey, radians(CAST(l_discount AS DOUBLE) * 360) AS d, radians(CAST(l_tax AS DOUBLE) * 360) AS t FROM lineitem) GROUP BY 1)
 SELECT img, round(coalesce(nc, 0) / CAST(na + nb - coalesce(nc, 0) AS DOUBLE), 6) AS jaccard, round(err, 4) AS angle_error, k AS n_angles FROM n JOIN m USING (img) JOIN e USING (img) LEFT JOIN c USING (img)"""
}

"""Scoring and checking queries: an order is an image, its lines are boxes; results of retrieval are damaged on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetta.operators import retrieval as R
from facetta.operators import scoring as S
from facetta.plans import retrieval

K, UNKNOWN = 10, 1_000_000_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("n"), *[F.col(f"l_{c}").cast("double").alias(c[0]) for c in ("quantity", "discount", "tax")])


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gt and pred: a box for each line, moved by its discount, and left out of the prediction where that is 0."""
    x, d = F.col("n") * 10.0, F.round(F.col("d") * 100)
    box = lambda by: F.array(x + by, F.col("q") + by, x + 20 + by, F.col("q") + 30 + by)
    pair = F.struct("n", "q", "d", box(F.lit(0.0)).alias("gt"), F.when(d > 0, box(d)).alias("pred"))
    rows = _lines(spark, sf_dir).groupBy("sample_id").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return rows.select("sample_id", F.col("x.gt").alias("gt"), F.filter(F.col("x.pred"), lambda b: b.isNotNull()).alias("pred"))


def box_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.box_scores(S.box_matches(_boxes(spark, sf_dir)))
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("prec", "recall", "f1", "mean_iou")])


def textbox_raster_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.raster_iou(_boxes(spark, sf_dir)).select("sample_id", F.round("iou", 6).alias("iou"))


def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in neighbour lists of which some are cut, have an item twice, mix -1 with items, are missing or nobody's."""
    queries, rows = retrieval.gallery(spark, sf_dir)
    near = R.knn(queries, rows, K).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "db_id"))).alias("x"))
    kind, ids = F.pmod(F.floor(F.col("query_id") / 100), F.lit(7)), F.col("x.db_id")
    damaged = F.when(kind == 0, F.slice(ids, 1, K - 1)).when(kind == 1, F.concat(F.slice(ids, 1, K - 1), F.slice(ids, 1, 1))).when(kind == 2, F.concat(F.array(F.lit(-1).cast("long")), F.slice(ids, 1, K - 1))).when(kind == 3, F.array(F.lit(-1).cast("long"))).otherwise(ids)
    lists = near.where(kind != 4).select(F.when(kind == 5, F.col("query_id") + UNKNOWN).otherwise(F.col("query_id")).alias("query_id"), F.array(damaged).alias("lists"))
    return S.list_violations(lists, queries.select(F.col("vec_id").alias("query_id")), K)


def frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in frames of which some lack a corner or a coordinate, or have an angle out of range."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    full = F.array(point("q", "d"), point("d", "q"), point("t", "q"), point("q", "t"))
    corners = F.when(F.col("q") == 7, F.slice(full, 1, 3)).when(F.col("q") == 11, F.concat(F.slice(full, 1, 3), F.array(F.array("q")))).otherwise(full)
    rows = _lines(spark, sf_dir).groupBy("sample_id").agg(F.collect_list(F.struct((F.col("q") * 4 - 10).alias("angle"), corners.alias("corners"))).alias("frames"))
    return S.frame_violations(rows)


def polar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rho and theta of a line through two points, and where it meets the line through two others."""
    rows = _lines(spark, sf_dir)
    n, q, d, t = F.col("n") + 0.1371, F.col("q") - 0.0713, F.col("d"), F.col("t")  # results are no halves of the last place
    rho, theta = S.polar_line(n, q, n * 2 + 1, d * 100)
    x, y = S.polar_crossing(rho, theta, *S.polar_line(q, t * 100, q + 2, n))
    part = lambda c, name: F.round(c, 4).alias(name)
    return rows.select("sample_id", "n", part(rho, "rho"), part(theta, "theta"), part(x, "x"), part(y, "y"))


def box_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between the lower edges of two quadrangles, and of the first against a given angle."""
    q, d, t = (F.col(c) for c in "qdt")
    box = lambda by: F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(40.0), by * 10), F.array(F.lit(41.0), by * 30 + q + 5), F.array(F.lit(1.0), q + 4))
    part = lambda c, name: F.round(c, 5).alias(name)
    return _lines(spark, sf_dir).select("sample_id", "n", part(S.edge_angles(box(d), box(t)), "between"), part(S.edge_against(box(d), q), "against"))


QUERIES = {"box_prf": box_prf, "textbox_raster_iou": textbox_raster_iou, "submission_check": submission_check, "frame_check": frame_check, "polar_lines": polar_lines, "box_angles": box_angles}

_L = "l AS (SELECT l_orderkey AS sample_id, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, round(CAST(l_discount AS DOUBLE) * 100) AS mv FROM lineitem)"
_POLAR = lambda x1, y1, x2, y2: f"atan2(({x1}) - ({x2}), ({y2}) - ({y1}))"
_EDGE = lambda by: f"(CASE WHEN {by} * 30 + q + 5 >= q + 4 THEN {_POLAR('41', f'{by} * 30 + q + 5', '1', 'q + 4')} ELSE {_POLAR('1', 'q + 4', '41', f'{by} * 30 + q + 5')} END)"
ORACLES = {
    "box_prf": f"""WITH RECURSIVE {_L}, z AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n, q, d) AS k FROM l), o AS (SELECT sample_id, g, p, w * h / (1200 - w * h) AS iou FROM (SELECT a.sample_id, a.k AS g, b.k AS p, greatest(0, 20 - abs(a.n * 10 - b.n * 10 - b.mv)) AS w, greatest(0, 30 - abs(a.q - b.q - b.mv)) AS h FROM z a JOIN z b USING (sample_id) WHERE b.mv > 0) WHERE w * h / (1200 - w * h) >= 0.5),
 m AS (SELECT sample_id, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT sample_id FROM o) UNION ALL
   SELECT sample_id, list_append(gs, g), list_append(ps, p), total + iou FROM (SELECT m.*, o.g, o.p, o.iou, row_number() OVER (PARTITION BY m.sample_id ORDER BY round(o.iou, 9) DESC, o.g, o.p) AS k FROM m JOIN o ON o.sample_id = m.sample_id WHERE NOT list_contains(m.gs, o.g) AND NOT list_contains(m.ps, o.p)) WHERE k = 1),
 e AS (SELECT sample_id, max(len(gs)) AS tp, max(total) AS iou FROM m GROUP BY 1), s AS (SELECT CAST((SELECT sum(tp) FROM e) AS BIGINT) AS tp, CAST(count(*) FILTER (mv > 0) AS BIGINT) AS np, count(*) AS ng, (SELECT sum(iou) FROM e) AS iou FROM l),
 r AS (SELECT tp, np - tp AS fp, ng - tp AS fn, CAST(tp AS DOUBLE) / np AS prec, CAST(tp AS DOUBLE) / ng AS recall, iou / tp AS mean_iou FROM s)
 SELECT tp, fp, fn, round(prec, 6) AS prec, round(recall, 6) AS recall, round(2 * prec * recall / (prec + recall), 6) AS f1, round(mean_iou, 6) AS mean_iou FROM r""",
    "textbox_raster_iou": f"""WITH {_L}, g AS (SELECT DISTINCT sample_id, x + unnest(range(21)) AS x, y FROM (SELECT sample_id, n * 10 AS x, CAST(q AS INT) + unnest(range(31)) AS y FROM l)), p AS (SELECT DISTINCT sample_id, x + unnest(range(21)) AS x, y FROM (SELECT sample_id, n * 10 + CAST(mv AS INT) AS x, CAST(q + mv AS INT) + unnest(range(31)) AS y FROM l WHERE mv > 0)),
 b AS (SELECT sample_id, count(*) AS c FROM g JOIN p USING (sample_id, x, y) GROUP BY 1) SELECT a.sample_id, round(coalesce(c, 0) / CAST(na + coalesce(np, 0) - coalesce(c, 0) AS DOUBLE), 6) AS iou FROM (SELECT sample_id, count(*) AS na FROM g GROUP BY 1) a LEFT JOIN (SELECT sample_id, count(*) AS np FROM p GROUP BY 1) e USING (sample_id) LEFT JOIN b USING (sample_id)""",
    "submission_check": """WITH k AS (SELECT (vec_id // 100) % 7 AS kind, CASE WHEN (SELECT count(*) FROM embeddings) > 10 THEN 1 ELSE 0 END AS enough FROM embeddings WHERE vec_id % 100 = 0)
 SELECT unnest(['missing', 'extra', 'empty', 'single', 'length', 'rejection', 'repeats']) AS rule, unnest([sum(CASE WHEN kind IN (4, 5) THEN 1 ELSE 0 END), sum(CASE WHEN kind = 5 THEN 1 ELSE 0 END), 0, 0, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END), sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END), sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END)])::BIGINT AS violations FROM k""",
    "frame_check": f"""WITH {_L}, s AS (SELECT sample_id, max(CASE WHEN q = 7 THEN 1 ELSE 0 END) AS a, max(CASE WHEN q = 11 THEN 1 ELSE 0 END) AS b, max(CASE WHEN q * 4 - 10 < 0 OR q * 4 - 10 > 180 THEN 1 ELSE 0 END) AS c FROM l GROUP BY 1) SELECT unnest(['corners', 'points', 'angle']) AS rule, unnest([sum(a), sum(b), sum(c)])::BIGINT AS violations FROM s""",
    "polar_lines": f"""WITH {_L}, z AS (SELECT sample_id, n AS line, n + CAST(0.1371 AS DOUBLE) AS n, q - CAST(0.0713 AS DOUBLE) AS q, d, t FROM l), a AS (SELECT *, {_POLAR('n', 'q', 'n * 2 + 1', 'd * 100')} AS t1, {_POLAR('q', 't * 100', 'q + 2', 'n')} AS t2 FROM z), b AS (SELECT *, n * cos(t1) + q * sin(t1) AS r1, q * cos(t2) + t * 100 * sin(t2) AS r2 FROM a)
 SELECT sample_id, line AS n, round(r1, 4) AS rho, round(t1, 4) AS theta, round(CASE WHEN abs(sin(t2 - t1)) > 1e-12 THEN (r1 * sin(t2) - r2 * sin(t1)) / sin(t2 - t1) END, 4) AS x, round(CASE WHEN abs(sin(t2 - t1)) > 1e-12 THEN (r2 * cos(t1) - r1 * cos(t2)) / sin(t2 - t1) END, 4) AS y FROM b""",
    "box_angles": f"WITH {_L} SELECT sample_id, n, round(abs({_EDGE('d')} - {_EDGE('t')}), 5) AS between, round(abs(degrees(1.5 * pi() - abs({_EDGE('d')})) - q), 5) AS against FROM l",
}

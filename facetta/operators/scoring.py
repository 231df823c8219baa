"""Offline scores and checks of results: matched boxes, lists, frames, angles of lines, masks of boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetta.functions import kernels as K

#: Steps in which overlaps are compared when boxes are matched.
DIGITS = 9


def overlaps(gt: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Intersection over union of every true (x0, y0, x1, y1) with every predicted box; 0 where the union is empty."""
    a, b = gt[:, None, :], pred[None, :, :]
    w = np.maximum(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0)
    h = np.maximum(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = size(a) + size(b) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def matched(gt: list, pred: list, least: float = 0.5) -> list[float]:
    """Overlaps of the matched pairs: the largest first (ties: earlier true box, then earlier prediction), a box in one pair at most."""
    if not len(gt) or not len(pred):
        return []
    iou = overlaps(np.array([list(x) for x in gt], float), np.array([list(x) for x in pred], float))
    key, out = np.round(iou, DIGITS), []
    key[iou < least] = -1
    while (best := int(key.argmax())) >= 0 and key.flat[best] >= 0:
        i, j = divmod(best, key.shape[1])
        out.append(float(iou[i, j]))
        key[i, :] = key[:, j] = -1
    return out


def box_matches(both: DataFrame, least: float = 0.5) -> DataFrame:
    """sample_id, tp, fp, fn and iou (sum over the matched) of rows with gt and pred, arrays of boxes; null counts as none."""

    def run(frames):
        for part in frames:
            rows = []
            for at, gt, pred in part.itertuples(index=False):
                gt, pred = ([] if x is None else list(x) for x in (gt, pred))
                found = matched(gt, pred, least)
                rows.append((at, len(found), len(pred) - len(found), len(gt) - len(found), sum(found)))
            yield pd.DataFrame(rows, columns=["sample_id", "tp", "fp", "fn", "iou"])

    return both.select("sample_id", "gt", "pred").mapInPandas(run, "sample_id long, tp long, fp long, fn long, iou double")


def box_scores(matches: DataFrame) -> DataFrame:
    """tp, fp, fn, prec, recall, f1 and mean_iou of a set: counts accumulate over its images; null where nothing can be divided."""
    n = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou"))
    tp = F.col("tp").cast("double")
    n = n.withColumns({"prec": F.try_divide(tp, F.col("tp") + F.col("fp")), "recall": F.try_divide(tp, F.col("tp") + F.col("fn")), "mean_iou": F.try_divide(F.col("iou"), tp)})
    return n.select("tp", "fp", "fn", "prec", "recall", F.try_divide(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")).alias("f1"), "mean_iou")


def _rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and violations: rows for which a rule's column is true."""
    counted = rows.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(n) for n, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


def list_violations(lists: DataFrame, queries: DataFrame, k: int = 10, rejection: bool = True, single: bool = False) -> DataFrame:
    """Violations of the rules of a result: lists has query_id and lists (a list of items for each crop), queries query_id.

    missing: a query without a result; extra: a result of no query; empty: a result without a list; single: more than
    one list (where ``single``); length: a list without k items and not [-1]; rejection: -1 beside other items, or at
    all where there is no ``rejection``; repeats: an item twice in a list.
    """
    asked = queries.select("query_id").distinct().withColumn("asked", F.lit(True))
    rows = lists.join(asked, "query_id", "full").withColumn("n", F.size(F.coalesce("lists", F.array().cast("array<array<long>>"))))
    no = F.array_contains
    alone = lambda x: (F.size(x) == 1) & (x[0] == -1)
    rejected = (lambda x: no(x, -1) & (F.size(x) != 1)) if rejection else (lambda x: no(x, -1))
    return _rules(rows, {
        "missing": F.col("lists").isNull(), "extra": F.col("asked").isNull(), "empty": F.col("lists").isNotNull() & (F.col("n") == 0), "single": (F.col("n") > 1) & F.lit(single),
        "length": F.exists("lists", lambda x: (F.size(x) != k) & ~(alone(x) if rejection else F.lit(False))), "rejection": F.exists("lists", rejected), "repeats": F.exists("lists", lambda x: F.size(F.array_distinct(x)) != F.size(x)),
    })


def box_violations(boxes: DataFrame) -> DataFrame:
    """boxes without four coordinates, and boxes that end before they begin; a violation for each sample."""
    four = lambda b: F.size(b) == 4
    return _rules(boxes, {"coordinates": F.exists("boxes", lambda b: ~four(b)), "order": F.exists("boxes", lambda b: F.when(four(b), (b[2] < b[0]) | (b[3] < b[1])).otherwise(False))})


def frame_violations(frames: DataFrame) -> DataFrame:
    """Frames (angle, corners) without four corners, with corners of other than two coordinates, with an angle outside 0..180."""
    return _rules(frames, {
        "corners": F.exists("frames", lambda f: F.size(f["corners"]) != 4), "points": F.exists("frames", lambda f: F.exists(f["corners"], lambda p: F.size(p) != 2)), "angle": F.exists("frames", lambda f: (f["angle"] < 0) | (f["angle"] > 180)),
    })


# ---- lines and angles, as columns


def polar_line(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(rho, theta) of the line through two points in Hesse's normal form."""
    theta = F.atan2(x1 - x2, y2 - y1)
    return x1 * F.cos(theta) + y1 * F.sin(theta), theta


def polar_crossing(rho1: Column, theta1: Column, rho2: Column, theta2: Column) -> tuple[Column, Column]:
    """(x, y) where two lines meet; null for parallel lines."""
    d = F.sin(theta2 - theta1)
    part = lambda v: F.when(F.abs(d) > 1e-12, v / d)
    return part(rho1 * F.sin(theta2) - rho2 * F.sin(theta1)), part(rho2 * F.cos(theta1) - rho1 * F.cos(theta2))


def lower_edge(corners: Column) -> Column:
    """theta of the line through the two lowest corners (largest y; ties: the earlier corner)."""
    ranked = F.array_sort(F.transform(corners, lambda p, i: F.struct((-p[1]).alias("y"), i.alias("i"), p.alias("p"))))
    a, b = ranked[0]["p"], ranked[1]["p"]
    return polar_line(a[0], a[1], b[0], b[1])[1]


def edge_angles(a: Column, b: Column) -> Column:
    """The difference of the angles of two boxes' lower edges, in radians."""
    return F.abs(lower_edge(a) - lower_edge(b))


def edge_against(corners: Column, angle: Column) -> Column:
    """The difference between a box's angle, from its lower edge, and a given one, in degrees."""
    return F.abs(F.degrees(F.lit(1.5 * np.pi) - F.abs(lower_edge(corners))) - angle)


# ---- masks


def binary_mask(img: np.ndarray) -> np.ndarray:
    """0 and 1: a mask that holds other values is 1 where it is 255; colours become gray first."""
    x = K.gray(img)
    return x if np.isin(x, (0, 1)).all() else (x == 255).astype(np.uint8)


def raster_iou(both: DataFrame) -> DataFrame:
    """sample_id and iou of the pixels that true and predicted boxes cover, edges included; 0 where one side has none."""

    def run(frames):
        for part in frames:
            rows = []
            for at, gt, pred in part.itertuples(index=False):
                sides = [np.array([[int(v) for v in b] for b in ([] if x is None else x)], int).reshape(-1, 4) for x in (gt, pred)]
                value = 0.0
                if all(len(x) for x in sides):
                    on = np.zeros((2, max(x[:, 3].max() for x in sides) + 1, max(x[:, 2].max() for x in sides) + 1), bool)
                    for side, found in zip(on, sides):
                        for x0, y0, x1, y1 in found:
                            side[max(y0, 0) : y1 + 1, max(x0, 0) : x1 + 1] = True
                    either = int(on.any(axis=0).sum())
                    value = int(on.all(axis=0).sum()) / either if either else 0.0
                rows.append((at, value))
            yield pd.DataFrame(rows, columns=["sample_id", "iou"])

    return both.select("sample_id", "gt", "pred").mapInPandas(run, "sample_id long, iou double")

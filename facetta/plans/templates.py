"""Image, metric and text operators as relational plans.

Each plan is one SQL text for Catalyst. Names in braces are input relations: tables, or ``px``, the pixel relation
(vec_id, label, r, c, v) with v in 0..255. The same text with the other engine's spelling of a few array functions
is the oracle of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "px": "(SELECT vec_id, label, CAST(floor(p / 8) AS INT) AS r, CAST(p % 8 AS INT) AS c, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5D) AS INT) AS v FROM (SELECT vec_id, label, posexplode(embedding) AS (p, e) FROM {embeddings}))",
    "rgb": "(SELECT vec_id, r, c, ch, (v + 85 * ch) % 256 AS v FROM (SELECT vec_id, r, c, v, explode(array(0, 1, 2)) AS ch FROM {px}))",
    "dense256": "(SELECT vec_id, explode(sequence(0, 255)) AS bin FROM {embeddings})",
    "dense255": "(SELECT vec_id, explode(sequence(0, 254)) AS bin FROM {embeddings})",
    "near": "(SELECT vec_id, r + dr AS r, c + dc AS c, dr, dc, v FROM (SELECT vec_id, r, c, v, dr, explode(array(-1, 0, 1)) AS dc FROM (SELECT vec_id, r, c, v, explode(array(-1, 0, 1)) AS dr FROM {px})))",
    "levels": "(SELECT vec_id, r, c, v, explode(array(1, 2, 4)) AS lvl FROM {px})",
    "word_list": r"(SELECT doc_id, explode(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+)', 1)) AS word FROM {documents})",
    "turn_words": r"(SELECT conv_id, turn, explode(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+)', 1)) AS word FROM {conversations})",
    "turn_lines": "(SELECT conv_id, turn, i, line FROM (SELECT conv_id, turn, posexplode(split(text, '\\n')) AS (i, line) FROM {conversations} WHERE text <> ''))",
    "grams": "(SELECT w, n, substring(w, s, n) AS gram, cnt FROM (SELECT w, cnt, n, explode(sequence(1, length(w) - n + 1)) AS s FROM (SELECT w, cnt, explode(sequence(1, least(8, length(w)))) AS n FROM counted)))",
    "basis": "(SELECT u, x FROM (SELECT u, explode(sequence(0, 7)) AS x FROM (SELECT explode(sequence(0, 5)) AS u)))",
    "chars": "{col}",
}
#: The characters beyond ASCII that the tables hold; the other engine's edit distance counts bytes, so its texts get a control character for each.
BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
DUCK = {
    "px": "(SELECT vec_id, label, CAST(floor(p / 8) AS INT) AS r, CAST(p % 8 AS INT) AS c, CAST(floor((CAST(e AS DOUBLE) + 1) * CAST(127.5 AS DOUBLE)) AS INT) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS p FROM embeddings))",
    "rgb": "(SELECT vec_id, r, c, ch, (v + 85 * ch) % 256 AS v FROM (SELECT vec_id, r, c, v, unnest([0, 1, 2]) AS ch FROM {px}))",
    "dense256": "(SELECT vec_id, unnest(range(256)) AS bin FROM embeddings)",
    "dense255": "(SELECT vec_id, unnest(range(255)) AS bin FROM embeddings)",
    "near": "(SELECT vec_id, r + dr AS r, c + dc AS c, dr, dc, v FROM (SELECT vec_id, r, c, v, dr, unnest([-1, 0, 1]) AS dc FROM (SELECT vec_id, r, c, v, unnest([-1, 0, 1]) AS dr FROM {px})))",
    "levels": "(SELECT vec_id, r, c, v, unnest([1, 2, 4]) AS lvl FROM {px})",
    "word_list": r"(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')) AS word FROM documents)",
    "turn_words": r"(SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')) AS word FROM conversations)",
    "turn_lines": "(SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT conv_id, turn, string_split({chars:text}, chr(10)) AS ls FROM conversations WHERE text <> ''))",
    "grams": "(SELECT w, n, substring(w, s, n) AS gram, cnt FROM (SELECT w, cnt, n, unnest(range(1, length(w) - n + 2)) AS s FROM (SELECT w, cnt, unnest(range(1, least(8, length(w)) + 1)) AS n FROM counted)))",
    "basis": "(SELECT u, x FROM (SELECT u, unnest(range(8)) AS x FROM (SELECT unnest(range(6)) AS u)))",
    "chars": "translate({col}, '" + BEYOND + "', " + " || ".join(f"chr({i})" for i in [*range(1, 9), *range(11, 11 + len(BEYOND) - 8)]) + ")",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One Otsu threshold of each value list (g, v): background is v <= t, the first maximum wins.
OTSU = """SELECT g, min(v) AS t FROM (SELECT g, v, var, max(var) OVER (PARTITION BY g) AS best FROM (
  SELECT g, v, CASE WHEN n0 = n THEN 0 ELSE n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) END AS var FROM (
    SELECT g, v, CAST(sum(k) OVER (PARTITION BY g ORDER BY v) AS DOUBLE) AS n0, CAST(sum(k * v) OVER (PARTITION BY g ORDER BY v) AS DOUBLE) AS s0,
      CAST(sum(k) OVER (PARTITION BY g) AS DOUBLE) AS n, CAST(sum(k * v) OVER (PARTITION BY g) AS DOUBLE) AS s
    FROM (SELECT g, v, count(*) AS k FROM {values} GROUP BY g, v)))) WHERE round(var, 6) = round(best, 6) GROUP BY g"""


def filled(inner: str) -> str:
    """Closing of a mask (vec_id, r, c, m) by 3 columns, then 3 rows: maximum, then minimum."""
    out = inner
    for axis, over in (("r", "c"), ("c", "r")):
        for f in ("max", "min"):
            out = f"(SELECT vec_id, r, c, {f}(m) OVER (PARTITION BY vec_id, {axis} ORDER BY {over} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM {out})"
    return out


def histogram(groups: str, low: str, high: str, bins: int) -> str:
    """Bin number of v between low and high, the last bin closed."""
    return f"least(CAST(floor((v - {low}) * CAST({bins} AS DOUBLE) / ({high} - {low})) AS INT), {bins - 1})"


VARIANCE = f"""(SELECT s.vec_id, s.r, s.c, CASE WHEN rs > t AND cs > t THEN 1 ELSE 0 END AS m FROM (
  SELECT vec_id, r, c, CAST(floor(round(stddev_pop(v) OVER (PARTITION BY vec_id, r), 6)) AS INT) AS rs, CAST(floor(round(stddev_pop(v) OVER (PARTITION BY vec_id, c), 6)) AS INT) AS cs FROM {{px}}) s
  JOIN ({OTSU.replace("{values}", "(SELECT vec_id AS g, CAST(floor(round(stddev_pop(v), 6)) AS INT) AS v FROM {px} GROUP BY vec_id, r UNION ALL SELECT vec_id, CAST(floor(round(stddev_pop(v), 6)) AS INT) FROM {px} GROUP BY vec_id, c)")}) o ON s.vec_id = o.g)"""
LOCAL = "(SELECT vec_id, r, c, CASE WHEN round(stddev_pop(v) OVER (PARTITION BY vec_id, floor(r / 2), floor(c / 2)), 6) > 12.5 THEN 1 ELSE 0 END AS m FROM {px})"
MEANVAR = "(SELECT vec_id, r, c, CASE WHEN round(abs(v - rm) - rs, 6) > 0 AND round(abs(v - cm) - cs, 6) > 0 THEN 1 ELSE 0 END AS m FROM (SELECT vec_id, r, c, v, avg(v) OVER (PARTITION BY vec_id, r) AS rm, stddev_pop(v) OVER (PARTITION BY vec_id, r) AS rs, avg(v) OVER (PARTITION BY vec_id, c) AS cm, stddev_pop(v) OVER (PARTITION BY vec_id, c) AS cs FROM {px}))"
BORDER = "(SELECT p.vec_id, r, c, CASE WHEN round(v - bg, 6) > 0 THEN 1 ELSE 0 END AS m FROM {px} p JOIN (SELECT vec_id, (avg(CASE WHEN r = 0 THEN v END) + avg(CASE WHEN r = 7 THEN v END) + avg(CASE WHEN c = 0 THEN v END) + avg(CASE WHEN c = 7 THEN v END)) / 4 AS bg FROM {px} GROUP BY vec_id) b ON p.vec_id = b.vec_id)"
MASK_OUT = "SELECT vec_id, CAST(sum(m) AS BIGINT) AS area, CAST(sum(m * (r * 8 + c)) AS BIGINT) AS moment, min(CASE WHEN m = 1 THEN c END) AS x0, min(CASE WHEN m = 1 THEN r END) AS y0, max(CASE WHEN m = 1 THEN c END) AS x1, max(CASE WHEN m = 1 THEN r END) AS y1 FROM "
PAIRS = "(SELECT a.vec_id, a.r, a.c, CAST(a.v AS DOUBLE) AS v, CAST(b.v AS DOUBLE) AS w FROM {px} a JOIN {px} b ON b.vec_id = a.vec_id + 1 AND a.r = b.r AND a.c = b.c)"
BOXES = "(SELECT l_orderkey AS img, l_linenumber AS box, CAST(l_linenumber * 10 AS DOUBLE) AS x0, l_quantity AS y0, CAST(l_linenumber * 10 + 20 AS DOUBLE) AS x1, l_quantity + 30 AS y1, l_discount * 100 AS d FROM {lineitem})"
IOU = f"(SELECT img, box, other, w * h / (1200 - w * h) AS iou FROM (SELECT g.img, g.box, p.box AS other, greatest(0, least(g.x1, p.x1 + p.d) - greatest(g.x0, p.x0 + p.d)) AS w, greatest(0, least(g.y1, p.y1 + p.d) - greatest(g.y0, p.y0 + p.d)) AS h FROM {BOXES} g JOIN {BOXES} p ON g.img = p.img))"
MASKS = "(SELECT doc_id, quality AS gt, 1 - toxic AS pred FROM {labels})"
COUNTED = "SELECT word AS w, count(*) AS cnt FROM {word_list} GROUP BY word"
MULTISETS = """(SELECT conv_id, turn, word, count(*) AS k FROM {turn_words} GROUP BY conv_id, turn, word)"""
COMMON = f"""(SELECT a.conv_id, a.turn, a.n AS na, b.n AS nb, coalesce(s.common, 0) AS common FROM (SELECT conv_id, turn, count(*) AS n FROM {{turn_words}} GROUP BY conv_id, turn) a
  JOIN (SELECT conv_id, turn, count(*) AS n FROM {{turn_words}} GROUP BY conv_id, turn) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  LEFT JOIN (SELECT x.conv_id, x.turn, sum(least(x.k, y.k)) AS common FROM {MULTISETS} x JOIN {MULTISETS} y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.word = y.word GROUP BY x.conv_id, x.turn) s ON s.conv_id = a.conv_id AND s.turn = a.turn)"""

PLANS: dict[str, str] = {
    # histograms
    "hist_gray": """SELECT vec_id, bin, round((n - lo) / (hi - lo), 6) AS h FROM (SELECT vec_id, bin, n, min(n) OVER (PARTITION BY vec_id) AS lo, max(n) OVER (PARTITION BY vec_id) AS hi FROM (
        SELECT d.vec_id, d.bin, CAST(count(p.v) AS DOUBLE) AS n FROM {dense256} d LEFT JOIN {px} p ON p.vec_id = d.vec_id AND p.v = d.bin GROUP BY d.vec_id, d.bin)) WHERE bin > 0""",
    "hist_concat": """SELECT vec_id, ch, bin, round(n / (sum(n) OVER (PARTITION BY vec_id)), 6) AS h FROM (SELECT vec_id, ch, v AS bin, CAST(count(*) AS DOUBLE) AS n FROM {rgb} WHERE v > 0 GROUP BY vec_id, ch, v)""",
    "hist_moments": """SELECT vec_id, round(m, 6) AS mean, round(sqrt(m2), 6) AS std, round(CASE WHEN m2 > 0 THEN m3 / (m2 * sqrt(m2)) ELSE 0 END, 5) AS skew FROM (
        SELECT vec_id, max(m) AS m, avg((v - m) * (v - m)) AS m2, avg((v - m) * (v - m) * (v - m)) AS m3 FROM (SELECT vec_id, CAST(v AS DOUBLE) AS v, avg(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id) AS m FROM {px}) GROUP BY vec_id)""",
    "hist_threshold": """SELECT vec_id, v AS bin, round(count(*) / CAST(64 AS DOUBLE), 6) AS h FROM (SELECT vec_id, v, round(avg(v) OVER (PARTITION BY vec_id) + stddev_pop(v) OVER (PARTITION BY vec_id), 6) AS t FROM {px}) WHERE v <= t AND v > 0 GROUP BY vec_id, v""",
    "hist_cumulative": """SELECT vec_id, bin, CAST(coalesce(sum(CASE WHEN bin = 0 THEN 0 ELSE n END) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS h FROM (
        SELECT d.vec_id, d.bin, count(p.v) AS n FROM {dense256} d LEFT JOIN {px} p ON p.vec_id = d.vec_id AND p.v = d.bin GROUP BY d.vec_id, d.bin)""",
    "hist_exp": """SELECT vec_id, bin, round(x / (sum(x) OVER (PARTITION BY vec_id)), 9) AS h FROM (SELECT vec_id, bin, exp(n / max(n) OVER (PARTITION BY vec_id)) AS x FROM (
        SELECT d.vec_id, d.bin, CAST(count(p.v) AS DOUBLE) AS n FROM {dense256} d LEFT JOIN {px} p ON p.vec_id = d.vec_id AND p.v = d.bin GROUP BY d.vec_id, d.bin))""",
    "hist_local": """SELECT vec_id, i, j, bin, round(n / (sum(n) OVER (PARTITION BY vec_id, i, j)), 6) AS h FROM (SELECT vec_id, CAST(floor(r / 4) AS INT) AS i, CAST(floor(c / 4) AS INT) AS j, CAST(floor(v * 48 / CAST(256 AS DOUBLE)) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM {px} GROUP BY 1, 2, 3, 4)""",
    "hist_weighted": """SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, least(CAST(floor(round(p * 255 / max(p) OVER (PARTITION BY vec_id), 9)) AS INT), 254) AS bin FROM (SELECT vec_id, count(*) OVER (PARTITION BY vec_id, v) / CAST(64 AS DOUBLE) AS p FROM {px})) GROUP BY vec_id, bin""",
    "hist_pyramid": """SELECT vec_id, lvl, i, j, bin, round(n / (sum(n) OVER (PARTITION BY vec_id, lvl, i, j)), 6) AS h FROM (SELECT vec_id, lvl, CAST(floor(r * lvl / 8) AS INT) AS i, CAST(floor(c * lvl / 8) AS INT) AS j, CAST(floor(v * 40 / CAST(256 AS DOUBLE)) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM {levels} GROUP BY 1, 2, 3, 4, 5)""",
    "hist_joint3d": """SELECT vec_id, b0, b1, b2, count(*) AS n FROM (SELECT vec_id, r, c, max(CASE WHEN ch = 0 THEN CAST(floor(v * 3 / CAST(256 AS DOUBLE)) AS INT) END) AS b0, max(CASE WHEN ch = 1 THEN CAST(floor(v * 3 / CAST(256 AS DOUBLE)) AS INT) END) AS b1, max(CASE WHEN ch = 2 THEN CAST(floor(v * 3 / CAST(256 AS DOUBLE)) AS INT) END) AS b2 FROM {rgb} GROUP BY vec_id, r, c) GROUP BY vec_id, b0, b1, b2""",
    "hist_range": f"""SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, {histogram("vec_id", "lo", "hi", 16)} AS bin FROM (SELECT vec_id, v, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM {{px}}) WHERE hi > lo) GROUP BY vec_id, bin""",
    "image_normalize": """SELECT vec_id, r, c, round(CASE WHEN hi > lo THEN (v - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS x FROM (SELECT vec_id, r, c, v, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM {px})""",
    "gray_conversion": """SELECT vec_id, r, c, CAST(round(0.114D * max(CASE WHEN ch = 0 THEN v END) + 0.587D * max(CASE WHEN ch = 1 THEN v END) + 0.299D * max(CASE WHEN ch = 2 THEN v END), 0) AS INT) AS gray FROM {rgb} GROUP BY vec_id, r, c""",
    # noise, thresholds, masks
    "noise_estimate": """SELECT vec_id, round(sum(abs(x)) * sqrt(pi() / 2) / 216, 6) AS sigma FROM (SELECT vec_id, r, c, sum(v * (CASE WHEN dr = 0 AND dc = 0 THEN 4 WHEN dr = 0 OR dc = 0 THEN -2 ELSE 1 END)) AS x FROM {near} WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 GROUP BY vec_id, r, c) GROUP BY vec_id""",
    "noise_estimate_full": """SELECT vec_id, round(sum(abs(x)) * sqrt(pi() / 2) / 216, 6) AS sigma FROM (SELECT vec_id, r, c, sum(v * (CASE WHEN dr = 0 AND dc = 0 THEN 4 WHEN dr = 0 OR dc = 0 THEN -2 ELSE 1 END)) AS x FROM {near} GROUP BY vec_id, r, c) GROUP BY vec_id""",
    "otsu_threshold": f"""SELECT g AS vec_id, t FROM ({OTSU.replace("{values}", "(SELECT vec_id AS g, v FROM {px})")})""",
    "variance_mask": MASK_OUT + filled(VARIANCE) + " GROUP BY vec_id",
    "local_variance_mask": MASK_OUT + LOCAL + " GROUP BY vec_id",
    "combined_mask": MASK_OUT + filled(f"(SELECT a.vec_id, a.r, a.c, a.m * b.m AS m FROM {VARIANCE} a JOIN {LOCAL} b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = b.c)") + " GROUP BY vec_id",
    "meanvariance_mask": MASK_OUT + filled(MEANVAR) + " GROUP BY vec_id",
    "border_mask": MASK_OUT + filled(BORDER) + " GROUP BY vec_id",
    "morph_close": MASK_OUT + filled("(SELECT vec_id, r, c, CASE WHEN v > 135 THEN 1 ELSE 0 END AS m FROM {px})") + " GROUP BY vec_id",
    "text_erasure": """SELECT vec_id, CAST(sum(CASE WHEN v > 140 THEN 0 ELSE v END) AS BIGINT) AS kept, CAST(sum(CASE WHEN v > 140 THEN 1 ELSE 0 END) AS BIGINT) AS erased FROM {px} GROUP BY vec_id""",
    # texture
    "lbp8_hist": """SELECT vec_id, code, count(*) AS n FROM (SELECT q.vec_id, q.r, q.c, CAST(sum(CASE WHEN q.v >= p.v THEN (CASE WHEN dr = 1 AND dc = 1 THEN 1 WHEN dr = 1 AND dc = 0 THEN 2 WHEN dr = 1 AND dc = -1 THEN 4 WHEN dr = 0 AND dc = -1 THEN 8 WHEN dr = -1 AND dc = -1 THEN 16 WHEN dr = -1 AND dc = 0 THEN 32 WHEN dr = -1 AND dc = 1 THEN 64 WHEN dr = 0 AND dc = 1 THEN 128 ELSE 0 END) ELSE 0 END) AS INT) AS code
        FROM {near} q JOIN {px} p ON p.vec_id = q.vec_id AND p.r = q.r AND p.c = q.c WHERE q.r BETWEEN 1 AND 6 AND q.c BETWEEN 1 AND 6 GROUP BY q.vec_id, q.r, q.c) GROUP BY vec_id, code""",
    "dct_zigzag": """SELECT vec_id, i, round(x, 6) AS x FROM (SELECT p.vec_id, a.u * 10 + b.u AS uv, sum(v / CAST(255 AS DOUBLE) * cos(pi() * (2 * r + 1) * a.u / 16) * cos(pi() * (2 * c + 1) * b.u / 16)) * (CASE WHEN a.u = 0 THEN sqrt(0.125D) ELSE 0.5D END) * (CASE WHEN b.u = 0 THEN sqrt(0.125D) ELSE 0.5D END) AS x
        FROM {px} p JOIN {basis} a ON a.x = p.r JOIN {basis} b ON b.x = p.c WHERE a.u + b.u < 3 GROUP BY p.vec_id, a.u, b.u) JOIN (SELECT 0 AS i, 0 AS uv UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 10 UNION ALL SELECT 3, 20) z USING (uv)""",
    "haar_subbands": """SELECT vec_id, i, j, round((a + b + c0 + d) / CAST(2 AS DOUBLE), 6) AS ll, round((a - b + c0 - d) / CAST(2 AS DOUBLE), 6) AS lh, round((a + b - c0 - d) / CAST(2 AS DOUBLE), 6) AS hl, round((a - b - c0 + d) / CAST(2 AS DOUBLE), 6) AS hh FROM (
        SELECT vec_id, CAST(floor(r / 2) AS INT) AS i, CAST(floor(c / 2) AS INT) AS j, sum(CASE WHEN r % 2 = 0 AND c % 2 = 0 THEN v ELSE 0 END) AS a, sum(CASE WHEN r % 2 = 0 AND c % 2 = 1 THEN v ELSE 0 END) AS b, sum(CASE WHEN r % 2 = 1 AND c % 2 = 0 THEN v ELSE 0 END) AS c0, sum(CASE WHEN r % 2 = 1 AND c % 2 = 1 THEN v ELSE 0 END) AS d FROM {px} GROUP BY 1, 2, 3)""",
    # image metrics
    "psnr_pairs": f"SELECT vec_id, round(CASE WHEN avg((v - w) * (v - w)) = 0 THEN 100 ELSE 20 * log10(255 / sqrt(avg((v - w) * (v - w)))) END, 6) AS psnr FROM {PAIRS} GROUP BY vec_id",
    "mae_pairs": f"SELECT vec_id, round(sum(abs(v / 255 - w / 255)) / (count(*) + 1e-8), 6) AS mae FROM {PAIRS} GROUP BY vec_id",
    "ssim_pairs": f"""SELECT vec_id, round(avg((2 * mv * mw + 6.5025D) * (2 * cov + 58.5225D) / ((mv * mv + mw * mw + 6.5025D) * (vv + vw + 58.5225D))), 6) AS ssim FROM (
        SELECT vec_id, mv, mw, (49 / CAST(48 AS DOUBLE)) * (sv - mv * mv) AS vv, (49 / CAST(48 AS DOUBLE)) * (sw - mw * mw) AS vw, (49 / CAST(48 AS DOUBLE)) * (svw - mv * mw) AS cov FROM (
          SELECT vec_id, i, j, avg(v) AS mv, avg(w) AS mw, avg(v * v) AS sv, avg(w * w) AS sw, avg(v * w) AS svw FROM (SELECT * FROM {PAIRS}) p JOIN (SELECT 0 AS i, 0 AS j UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1) o ON p.r BETWEEN o.i AND o.i + 6 AND p.c BETWEEN o.j AND o.j + 6 GROUP BY vec_id, i, j)) GROUP BY vec_id""",
    "vector_metrics": f"""SELECT vec_id, round(sqrt(sum((v - w) * (v - w))), 6) AS euclid, round(sum(abs(v - w)), 6) AS l1, round(sum((v - w) * (v - w) / (v + w + 1e-8)), 6) AS chi2, round(sum(sqrt(v * w)), 6) AS hellinger, round(sum(least(v, w)), 6) AS intersection FROM {PAIRS} GROUP BY vec_id""",
    # mask and box metrics
    "mask_confusion": f"""SELECT round(acc, 9) AS accuracy, round(p, 9) AS prec, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-5), 9) AS f1 FROM (SELECT avg(CASE WHEN gt = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS acc, sum(gt * pred) / (sum(pred) + 1e-8) AS p, sum(gt * pred) / (sum(gt) + 1e-8) AS r FROM {MASKS})""",
    "pixel_prf_micro": f"""SELECT CAST(sum(gt * pred) AS BIGINT) AS tp, CAST(sum((1 - gt) * pred) AS BIGINT) AS fp, CAST(sum(gt * (1 - pred)) AS BIGINT) AS fn FROM {MASKS}""",
    "pr_curve": """SELECT bin, round(CAST(tp AS DOUBLE) / n, 6) AS prec, round(CAST(tp AS DOUBLE) / all_pos, 6) AS recall FROM (SELECT bin, sum(pos) OVER (ORDER BY bin DESC) AS tp, sum(k) OVER (ORDER BY bin DESC) AS n, sum(pos) OVER () AS all_pos FROM (
        SELECT bin, sum(quality) AS pos, count(*) AS k FROM (SELECT least(CAST(floor(d.n_chars / 64) AS INT), 255) AS bin, quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) GROUP BY bin))""",
    "box_iou": f"SELECT img, round(avg(best), 6) AS iou FROM (SELECT img, box, max(iou) AS best FROM {IOU} GROUP BY img, box) GROUP BY img",
    "textbox_score": """SELECT l_orderkey, l_linenumber, round(CASE WHEN w < 10 OR h < 10 OR h > w OR w >= 0.8D * 200 OR h >= 25 THEN 0 ELSE (fill + 50 * (w * h / 20000)) / 2 END, 6) AS score FROM (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS w, CAST(l_linenumber * 5 AS DOUBLE) AS h, 1 - l_discount AS fill FROM {lineitem})""",
    "angle_error": """SELECT l_orderkey, l_linenumber, round(degrees(acos(greatest(-1, least(1, abs(cos(a)) * abs(cos(b)) + sin(a) * sin(b))))), 4) AS err FROM (SELECT l_orderkey, l_linenumber, radians(l_discount * 360) AS a, radians(l_tax * 360) AS b FROM {lineitem})""",
    "frame_angle_normalise": """SELECT l_orderkey, l_linenumber, CASE WHEN a2 > 45 THEN a2 + 90 ELSE a2 END AS angle FROM (SELECT l_orderkey, l_linenumber, CASE WHEN a IN (0, 90, 180) THEN a ELSE 90 - a END AS a2 FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 3.5D) AS INT) AS a FROM {lineitem}))""",
    # text
    "word_vocab": f"""SELECT token, CAST(k - 1 AS INT) AS id, cnt FROM (SELECT w AS token, row_number() OVER (ORDER BY cnt DESC, w) AS k, cnt FROM ({COUNTED})) WHERE k <= 204""",
    "token_counts": """SELECT doc_id, count(*) AS n, count(DISTINCT word) AS n_distinct FROM {word_list} GROUP BY doc_id""",
    "bpe_ngram_counts": f"""WITH every AS ({COUNTED}), counted AS (SELECT w, cnt FROM (SELECT w, cnt, row_number() OVER (ORDER BY cnt DESC, w) AS k FROM every) WHERE k > 202) SELECT gram, cnt FROM (SELECT gram, cnt, row_number() OVER (ORDER BY cnt DESC, gram) AS k FROM (SELECT gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM {{grams}} GROUP BY gram)) WHERE k <= 512""",
    "text_jaccard_pairs": f"SELECT conv_id, turn, round(CAST(common AS DOUBLE) / (na + nb - common), 6) AS jaccard FROM {COMMON}",
    "text_bag_pairs": f"SELECT conv_id, turn, CAST(greatest(na - common, nb - common) AS BIGINT) AS bag FROM {COMMON}",
    "levenshtein_pairs": "SELECT a.conv_id, a.turn, levenshtein({chars:a.text}, {chars:b.text}) AS dist FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "ocr_line_distance": """SELECT p.conv_id, p.turn, coalesce(round(d.dist, 6), -1) AS dist FROM (SELECT a.conv_id, a.turn FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) p
        LEFT JOIN (SELECT a.conv_id, a.turn, avg(levenshtein(a.line, b.line)) AS dist FROM {turn_lines} a JOIN {turn_lines} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.i = b.i GROUP BY a.conv_id, a.turn) d ON d.conv_id = p.conv_id AND d.turn = p.turn""",
    "annotation_parse": """SELECT c_custkey, split_part(inner_text, ', ', 1) AS author, split_part(inner_text, ', ', 2) AS title FROM (SELECT c_custkey, replace(substring(line, 3, length(line) - 4), '''', '') AS inner_text FROM (SELECT c_custkey, concat('(''', c_name, ''', ''', c_mktsegment, ''')') AS line FROM {customer}))""",
}


def spelled(template: str, words: dict[str, str], tables: dict[str, str]) -> str:
    def put(m):
        name, _, arg = m[1].partition(":")
        if name in tables:
            return tables[name]
        return spelled(words[name].replace("{col}", arg).replace("{{", "\0").replace("}}", "\1"), words, tables).replace("\0", "{").replace("\1", "}")

    return re.sub(r"\{(\w+(?::[\w.]+)?)\}", put, template)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used: dict[str, DataFrame] = {}

    class Names(dict):
        def __contains__(self, key):
            return key in TABLES

        def __getitem__(self, key):
            used[key] = spark.read.parquet(f"{sf_dir}/{key}.parquet")
            return f"\2{key}\3"

    text = spelled(PLANS[name], SPARK, Names())
    text = text.replace("{", "{{").replace("}", "}}").replace("\2", "{").replace("\3", "}")
    return spark.sql(text, **used)


def oracle(name: str) -> str:
    return _plain(spelled(PLANS[name], DUCK, {t: t for t in TABLES}))


def _plain(text: str) -> str:
    """Doubles are spelled by casts."""
    return re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text)

"""Scores and checks by hand, text metrics and neighbours against loops, configurations with every name."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetta.functions import text_metrics as X
from facetta.functions.phonetic import editex, editex_many
from facetta.operators import images as I
from facetta.operators import scoring as S
from facetta.plans import catalog, scoring, tasks, texts
from tests.compare import compare, connect


def test_matching_by_hand():
    gt, pred = [(0, 0, 10, 10), (0, 0, 10, 8), (50, 50, 60, 60)], [(0, 0, 10, 9), (0, 0, 10, 10)]
    assert S.matched(gt, pred) == [1.0, pytest.approx(80 / 90)]
    assert S.matched(gt, []) == [] and S.matched([(0, 0, 0, 0)], [(0, 0, 0, 0)]) == []
    assert S.matched([(0, 0, 10, 10)] * 2, [(0, 0, 10, 10)]) == [1.0]


def test_box_scores_of_empty_sets(spark):
    rows = spark.createDataFrame([(1, None, [[0, 0, 1, 1]]), (2, [[0, 0, 1, 1]], None), (3, [], [])], "sample_id long, gt array<array<int>>, pred array<array<int>>")
    assert tuple(S.box_scores(S.box_matches(rows)).first()) == (0, 1, 1, 0.0, 0.0, None, None)
    assert tuple(S.box_scores(S.box_matches(rows.limit(0))).first()) == (0, 0, 0, None, None, None, None)
    assert {r.sample_id: r.iou for r in S.raster_iou(rows).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_list_rules_by_hand(spark):
    queries = spark.createDataFrame([(i,) for i in range(6)], "query_id long")
    good = list(range(3))
    lists = spark.createDataFrame([(0, [good]), (1, [[-1]]), (2, [good, [1, 1, 2]]), (3, [[-1, 2, 3]]), (4, []), (9, [good[:2]])], "query_id long, lists array<array<long>>")
    count = lambda **o: {r.rule: r.violations for r in S.list_violations(lists, queries, 3, **o).collect()}
    assert count() == {"missing": 1, "extra": 1, "empty": 1, "single": 0, "length": 1, "rejection": 1, "repeats": 1}
    assert count(single=True, rejection=False) == {"missing": 1, "extra": 1, "empty": 1, "single": 1, "length": 2, "rejection": 2, "repeats": 1}


def test_box_and_frame_rules_by_hand(spark):
    boxes = spark.createDataFrame([(1, [[0, 0, 1, 1]]), (2, [[0, 0, 1]]), (3, [[5, 0, 1, 1]]), (4, [])], "sample_id long, boxes array<array<int>>")
    assert {r.rule: r.violations for r in S.box_violations(boxes).collect()} == {"coordinates": 1, "order": 1}
    four = [[0.0, 0.0]] * 4
    frames = spark.createDataFrame([(1, [(10.0, four)]), (2, [(10.0, four[:3])]), (3, [(190.0, four)]), (4, [(0.0, [[1.0]] + four[:3])])], f"sample_id long, frames {tasks.FRAMES}")
    assert {r.rule: r.violations for r in S.frame_violations(frames).collect()} == {"corners": 1, "points": 1, "angle": 1}


def test_lines_and_edges_by_hand(spark):
    row = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    flat, upright = S.polar_line(*lit(0, 5, 10, 5)), S.polar_line(*lit(3, 0, 3, 9))
    x, y = S.polar_crossing(*flat, *upright)
    got = row.select(flat[0], flat[1], x, y, S.polar_crossing(*flat, *S.polar_line(*lit(0, 6, 10, 6)))[0]).first()
    assert list(got[:4]) == pytest.approx([-5.0, -math.pi / 2, 3.0, 5.0]) and got[4] is None
    box = lambda slope: F.array(*[F.array(*lit(a, b)) for a, b in ((0, 0), (10, 0), (10, 10 + slope), (0, 10))])
    assert row.select(S.edge_angles(box(0.1), box(10.0))).first()[0] == pytest.approx(math.atan(1) - math.atan(0.01))


def test_binary_mask():
    assert S.binary_mask(np.array([[0, 1], [1, 0]], np.uint8)).tolist() == [[0, 1], [1, 0]]
    assert S.binary_mask(np.array([[0, 255], [7, 0]], np.uint8)).tolist() == [[0, 1], [0, 0]]
    assert S.binary_mask(np.full((1, 1, 3), 255, np.uint8)).tolist() == [[1]]


def test_scoring_queries_match_their_oracles(spark, sf):
    con = connect(sf)
    oracles = catalog.oracle_sql()
    for name in [*scoring.QUERIES, "bpe_vocab", "bpe_encode", "bpe_roundtrip", "bpe_ngram_counts", "text_metrics", "text_jaccard_topk", "text_bag_topk", "levenshtein_pairs", "ocr_line_distance"]:
        assert compare(spark, con, sf, catalog.queries()[name], oracles[name]) == "", name


def slow_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_text_distances():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abcé ñ") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert X.levenshtein(a, b) == slow_levenshtein(a, b)
        x, y = Counter(a), Counter(b)
        assert X.bag(list(a), list(b)) == max(sum((x - y).values()), sum((y - x).values()))
        assert X.jaccard(list(a), list(b)) == (sum((x & y).values()) / sum((x | y).values()) if a + b else 1.0)


def test_editex_of_many_pairs():
    r = random.Random(3)
    pairs = [tuple("".join(r.choice("abcdhwkst zé") for _ in range(r.randint(0, 14))) for _ in range(2)) for _ in range(700)] + [("", ""), ("x", "")]
    assert editex_many(pairs, most=300) == editex_many(pairs) == [editex(a, b) for a, b in pairs]


def test_text_metrics_by_hand(spark):
    """The largest value over all fields for each prediction, summed, over the smaller number of lines and predictions."""
    schema = "sample_id long, gt array<array<string>>, pred array<string>, gt_tokens array<array<array<string>>>, pred_tokens array<array<string>>"
    rows = spark.createDataFrame([(1, [["ab", "xyz"], ["é"]], ["ab", "x"], [[["a", "b"], ["x"]], [["e"]]], [["a", "b"], ["x"]]), (2, [["a"]], [], [[["a"]]], []), (3, None, None, None, None)], schema)
    got = {(r.sample_id, r.metric): r.value for r in tasks.compared_texts(rows, [{"name": n} for n in ("text_levenshtein", "text_editex", "text_jaccard", "text_token_bag_dist", "iou")]).collect()}
    assert got[1, "text_levenshtein"] == (3 + 2) / 2 and got[1, "text_jaccard"] == 1.0 and got[1, "text_token_bag_dist"] == (2 + 2) / 2
    assert got[1, "text_editex"] == sum(max(editex(p, t) for t in ("ab", "xyz", "é")) for p in ("ab", "x")) / 2
    assert all(got[i, m] is None for i in (2, 3) for m in ("text_levenshtein", "text_jaccard")) and len(got) == 12


def slow_ssim(a, b):
    out = []
    for c in range(a.shape[2]):
        for i in range(a.shape[0] - 6):
            for j in range(a.shape[1] - 6):
                x, y = (z[i : i + 7, j : j + 7, c].astype(float).ravel() for z in (a, b))
                mx, my, vx, vy, xy = x.mean(), y.mean(), x.var(ddof=1), y.var(ddof=1), np.cov(x, y)[0, 1]
                out.append((2 * mx * my + 6.5025) * (2 * xy + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)))
    return np.mean(out)


def test_ssim(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, (11, 13, 3)).astype(np.uint8) for _ in range(2))
    assert tasks.ssim(a, b) == pytest.approx(slow_ssim(a, b)) and tasks.ssim(a, a) == pytest.approx(1)
    assert tasks.ssim(a[:5], b[:5]) is None
    image = lambda x: ("", *x.shape, 16, bytearray(x.tobytes()))
    rows = spark.createDataFrame([(1, image(a), image(b)), (2, image(a), image(b[:9])), (3, None, image(b))], f"sample_id long, gt {I.IMAGE}, pred {I.IMAGE}")
    got = {r.sample_id: r.value for r in tasks.compared(rows, [{"name": "ssim"}]).collect()}
    assert got == {1: pytest.approx(slow_ssim(a, b)), 2: None, 3: None}


def test_neighbours_against_loops(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("item_id", F.col("item_id").cast("string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    import re

    words = lambda t: Counter(re.findall(r"\w+|[^\w\s]+", (t or "").lower()))
    known = [(r.doc_id, words(r.text)) for r in docs.collect()]
    for kind in ("jaccard", "bag"):
        got = {(r.item_id, r.rnk): (r.doc_id, r.dist) for r in texts.token_neighbours(items, docs.repartition(5), kind).collect()}
        for r in items.collect():
            q, found = words(r.text), []
            for d, w in known:
                if common := (q & w).total():
                    n, m = q.total(), w.total()
                    found.append((round(1 - common / (n + m - common), 6) if kind == "jaccard" else max(n, m) - common, d))
            for i, (dist, d) in enumerate(sorted(found)[:10]):
                assert got[r.item_id, i + 1] == (d, pytest.approx(dist, abs=1e-6))


EVERY = """
tasks:
  - {name: denoising, datasets: [here], metrics: [psnr, ssim], preprocessing: [{name: channels_denoise_preprocessor, h: 3, template_window_size: 7, search_window_size: 21}]}
  - name: text_detection
    datasets: [here]
    ocr: fixed_ocr
    tokenizer: {name: bpe_tokenizer, vocab_size: 64}
    metrics: [iou, text_levenshtein, text_editex, text_jaccard, text_token_bag_dist]
    preprocessing: [{name: fixed_detector}]
  - name: retrieval
    datasets: [here]
    features_extractors: [{name: sift_features_extractor, n_keypoints: 20, max_size: 64, distance: {name: cosine, n_neighbors: 5}}]
    metrics: [{name: map, top_k: [1, 5]}, raw_accuracy]
  - name: retrieval_comb
    datasets: [here]
    tokenizer: {name: visual_codebook_tokenizer, k_size: 16, sample: 16, num_words: 4}
    features_extractors: [visual_codebook_extractor, hist_rgb_concat_extractor, {name: histogram_lab_extractor, sample: 8}]
    metrics: [{name: map, top_k: 1}]
"""


def test_a_configuration_with_every_kind_of_name(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    tasks.register("ocr", "fixed_ocr")(lambda img: "the text")
    monkeypatch.setitem(I.TEXTS, "fixed_detector", lambda img: I._box_mask(img.shape[:2], [(2, 2, 9, 6)]))
    tasks.register("preprocessing", "fixed_detector")(I.TEXTS["fixed_detector"])
    made = []
    for i in range(4):
        img = np.full((64, 96, 3), (40 * i, 250 - 50 * i, 90), np.uint8)
        img[8:40, 10:70] = rng.integers(0, 255, (32, 60, 3))
        made.append((i, ("", 64, 96, 3, 16, bytearray(img.tobytes()))))
    images = spark.createDataFrame(made, f"sample_id long, image {I.IMAGE}")
    data = {
        "images": images, "database": images, "clean": images,
        "correspondences": spark.createDataFrame([(i, 0, i) for i in range(4)], "query_id long, crop_pos int, db_id long"),
        "text_boxes": spark.createDataFrame([(i, [[0, 0, 5, 5]]) for i in range(4)], "sample_id long, boxes array<array<int>>"),
        "annotations": spark.createDataFrame([(i, 0, ["the text", f"of {i}"]) for i in range(4)], "sample_id long, line_no int, fields array<string>"),
    }
    found = tasks.load(EVERY)
    assert {m["name"] for t in found for m in t.metrics} == {"psnr", "ssim", "iou", "text_levenshtein", "text_editex", "text_jaccard", "text_token_bag_dist", "map", "raw_accuracy"}
    folders = tasks.run(spark, found, {"here": tasks.preloaded(data)}, str(tmp_path))
    means = [{r.metric: r.asDict().get("mean") for r in spark.read.json(f"{f}/report").collect()} for f in folders]
    assert set(means[0]) == {"psnr", "ssim"} and set(means[1]) == {"iou", "text_levenshtein", "text_editex", "text_jaccard", "text_token_bag_dist"}
    assert means[2] == {"map@1": 1.0, "map@5": 1.0, "raw_accuracy": 1.0} and means[3] == {"map@1": 1.0}
    assert spark.read.parquet(f"{folders[1]}/text_masks").count() == 4 and [r.value for r in spark.read.parquet(f"{folders[1]}/text_transcriptions").collect()] == ["the text"] * 4
    assert means[1]["text_levenshtein"] == slow_levenshtein("the text", "of 1") and means[1]["text_jaccard"] == 1.0


@pytest.mark.parametrize("text", ["tasks: [{name: masking, preprocessing: [{name: paint_mask_preprocessor, shade: 3}]}]", "tasks: [{name: retrieval, features_extractors: [{name: lbp_extractor, dots: 3}]}]"])
def test_unknown_parameters_are_errors(text):
    with pytest.raises(ValueError, match="unknown parameters"):
        tasks.load(text)


def test_every_name_resolves():
    """Names of extractors, metrics, distances, tokenizers and tasks."""
    for kind, names in {
        "features_extractor": "hist_grayscale_extractor hist_rgb_concat_extractor hist_moments_extractor hist_thr_extractor cum_hist_extractor exp_hist_extractor local_histogram_extractor weighted_local_histogram_extractor pyramid_local_histogram_extractor histogram_lab_extractor 3d_histogram_extractor visual_codebook_extractor random_features_extractor",
        "metric": "mae accuracy precision recall f1 iou psnr ssim raw_accuracy map euclidian_distance l1_distance chi2_distance hellinger_kernel_distance histogram_intersection_similarity text_levenshtein text_editex text_jaccard text_token_bag_dist",
        "distance": "cosine l1 jaccard_dist bag_dist", "tokenizer": "bpe_tokenizer visual_codebook_tokenizer", "task": "masking denoising text_detection retrieval retrieval_comb retrieval_distcomb visualize",
    }.items():
        for name in names.split():
            assert tasks.resolve(kind, name)

"""Sources, sinks and tasks on images written by the test."""

import json
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetta.operators import images as I
from facetta.plans import frames
from facetta.plans import tasks as T
from facetta.sources import images as S

RNG = np.random.default_rng(9)
#: Kernels have fixed sizes, so paintings stand well apart from the border; JPEG's colour blocks widen a mask by up to 16 pixels.
BOXES = {0: (120, 90, 359, 269), 1: (60, 120, 329, 299), 2: (180, 60, 419, 299)}
H, W = 360, 480


def picture(box, seed):
    img = np.full((H, W, 3), 200, np.uint8)
    x0, y0, x1, y1 = box
    img[y0 : y1 + 1, x0 : x1 + 1] = np.random.default_rng(seed).integers(0, 255, ((y1 - y0 + 1), (x1 - x0 + 1), 3))
    return img


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pictures")
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    for i, box in BOXES.items():
        (top / "made.png").write_bytes(S.png(picture(box, i)))
        io.write(io.read(file(str(top / "made.png"))), "jpg", file(str(top / f"{i:05d}.jpg")))
        mask = np.zeros((H, W), np.uint8)
        mask[box[1] : box[3] + 1, box[0] : box[2] + 1] = 255
        (top / f"{i:05d}.png").write_bytes(S.png(mask))
        (top / f"{i:05d}.txt").write_bytes("('Joan Miró', 'La masia')\nplain line\n".encode("latin-1"))
    (top / "made.png").unlink()
    (top / "gt_corresps.json").write_text(json.dumps([[0], [1], [2]]))
    (top / "text_boxes.pkl").write_bytes(pickle.dumps([[[1, 2, 3, 4]], [[[1, 2], [5, 2], [5, 6], [1, 6]]], []]))
    return str(top)


def test_sources(spark, folder):
    data = T.dataset(spark, folder, folder)
    assert set(data) == {"images", "masks", "correspondences", "text_boxes", "database", "annotations"}
    assert sorted(r.sample_id for r in data["images"].collect()) == [0, 1, 2]
    mask = data["masks"].where("sample_id = 1").first().image
    got = I.decode(mask.height, mask.width, mask.nChannels, bytes(mask.data))
    assert (got[120:300, 60:330] == 255).all() and got.astype(int).sum() == 255 * 180 * 270
    assert {tuple(r) for r in data["correspondences"].collect()} == {(i, 0, i) for i in range(3)}
    assert {r.sample_id: r.boxes for r in data["text_boxes"].collect()} == {0: [[1, 2, 3, 4]], 1: [[1, 2, 5, 6]], 2: []}
    lines = {(r.sample_id, r.line_no): r.fields for r in S.annotations(spark, folder).collect()}
    assert len(lines) == 6 and lines[2, 0] == ["Joan Miró", "La masia"] and lines[2, 1] == ["plain line"]
    assert S.samples(data["images"], masks=data["masks"]).where("masks is not null").count() == 3


def test_ground_truth_loads_no_classes():
    assert S.plain(pickle.dumps([[1], [-1]])) == [[1], [-1]]
    with pytest.raises(pickle.UnpicklingError):
        S.plain(pickle.dumps(np.float64(1)))


def test_png(spark):
    img = RNG.integers(0, 255, (5, 7, 3)).astype(np.uint8)
    row = spark.createDataFrame([(5, 7, 3, bytearray(img.tobytes())), (None, None, None, None)], "h int, w int, n int, d binary")
    files = [r.x for r in row.select(S.png_of("h", "w", "n", "d").alias("x")).collect()]
    assert bytes(files[0]) == S.png(img) and files[1] is None


def test_prediction_lists(spark):
    rows = [(1, c, r, 10 * c + r) for c in (0, 1) for r in (2, 1, 3)] + [(2, 0, 1, None)]
    got = {r.query_id: r.lists for r in S.predictions(spark.createDataFrame(rows, S.PREDICTIONS), 2).collect()}
    assert got == {1: [[1, 2], [11, 12]], 2: [[-1]]}
    assert {r.query_id: r.lists for r in S.predictions(spark.createDataFrame(rows, S.PREDICTIONS), 10, True).collect()}[1] == [[1, 2, 3]]


CONFIG = """
tasks:
  - name: masking
    datasets: [here]
    preprocessing: [{name: paint_mask_preprocessor}]
    metrics: [{name: f1}, {name: accuracy}, {name: precision}, {name: recall}, {name: mae}]
  - name: retrieval_comb
    datasets: [here]
    features_extractors: [grayscale_extractor, lbp_extractor]
    metrics: [{name: map, top_k: [1, 5]}]
    distance: {name: l1}
  - name: retrieval_distcomb
    datasets: [here]
    features_extractors: [lbp_extractor, dct_extractor]
    metrics: [{name: map, top_k: 1}]
  - name: retrieval
    datasets: [here]
    features_extractors: [lbp_extractor, dct_extractor]
    metrics: [{name: map, top_k: 1}]
"""


def test_tasks_from_a_configuration(spark, folder, tmp_path):
    tasks = T.load(CONFIG)
    assert tasks[1].metrics == [{"name": "map", "top_k": 1}, {"name": "map", "top_k": 5}] and tasks[1].distance == "l1"
    folders = T.run(spark, tasks, {"here": T.dataset(spark, folder, folder)}, str(tmp_path))
    means = [{r.metric: r["mean"] for r in spark.read.json(f"{f}/report").collect()} for f in folders]
    assert means[0]["f1"] > 0.75 and means[0]["recall"] > 0.99 and means[0]["mae"] < 0.2
    assert means[1] == {"map@1": 1.0, "map@5": 1.0} and means[2] == means[3] == {"map@1": 1.0}
    assert spark.read.parquet(f"{folders[2]}/result").count() == 9


def test_denoising_and_text(spark, folder):
    data = T.dataset(spark, folder)
    clean = {**data, "clean": data["images"]}
    found, metrics = T.denoising(T.Task("denoising", ["here"], [], [], [{"name": "psnr"}]), clean)
    assert {r.value for r in metrics.collect()} == {100.0}
    task = T.Task("text_detection", ["here"], ["paint_mask_preprocessor", "text_detector_wo_mask"])
    found, metrics = T.text_detection(task, data)
    for r in found.collect():
        x0, y0, x1, y1 = BOXES[r.sample_id]
        assert all(x0 - 40 <= b[0] <= b[2] <= x1 + 40 and y0 - 40 <= b[1] <= b[3] <= y1 + 40 for b in r.boxes)
    assert metrics.where("sample_id = 2").first().value == 0.0


def test_iou_by_hand(spark):
    frame = lambda rows: spark.createDataFrame(rows, "sample_id long, boxes array<array<int>>")
    got = T.box_iou(frame([(1, [[0, 0, 10, 10], [0, 0, 10, 10]]), (2, [[0, 0, 0, 0]]), (3, [])]), frame([(1, [[5, 0, 15, 10], [2, 2, 8, 8]])]))
    assert {r.sample_id: r.value for r in got.collect()} == {1: pytest.approx(0.36), 2: 0.0, 3: 0.0}


def test_metrics_by_hand(spark):
    row = spark.createDataFrame([(1, bytearray([1, 0, 1, 1, 0]), bytearray([1, 1, 0, 1, 0]))], "sample_id long, gt binary, pred binary")
    got = {r.metric: r.value for r in T.compared(row, [{"name": n} for n in ("precision", "recall", "f1", "accuracy")]).collect()}
    assert got == {"precision": pytest.approx(2 / 3), "recall": pytest.approx(2 / 3), "f1": pytest.approx(0.666662, abs=1e-6), "accuracy": 0.6}
    row = spark.createDataFrame([(1, bytearray([10, 20, 30, 40]), bytearray([12, 20, 30, 60])), (2, None, bytearray([1]))], "sample_id long, gt binary, pred binary")
    assert [r.value for r in T.compared(row, [{"name": "psnr"}]).orderBy("sample_id").collect()] == [pytest.approx(28.087590, abs=1e-6), None]


def test_unknown_names_are_errors():
    for text in ("tasks: [{name: nothing}]", "tasks: [{name: masking, preprocessing: [nothing]}]", "tasks: [{name: masking, metrics: [{name: nothing}]}]"):
        with pytest.raises(ValueError, match="unknown"):
            T.load(text)
    with pytest.raises(ValueError):
        T.masking(T.Task("masking", []), {})


SOURCES = """
tasks:
  - name: retrieval_distcomb
    datasets: [here]
    use_gt: true
    ocr: constant_ocr
    tokenizer: {name: word_tokenizer, feats_w: 0.5, distance: {name: bag_dist}}
    preprocessing: [text_detector_wo_mask]
    features_extractors:
      - {name: orb_features_extractor, norm: hamming, quality_thr: 0.9, matches_thr: 0.2}
      - {name: lbp_extractor, feats_w: 2, distance: {name: cosine, in_db_thr: 0.5}}
    metrics: [{name: map, top_k: 1}]
  - name: retrieval_distcomb
    datasets: [here]
    features_extractors: [{name: lbp_extractor, distance: {name: l1, in_db_thr: -1}}]
    metrics: [{name: map, top_k: 1}]
  - name: visualize
    datasets: [here]
    features_extractors: [grayscale_extractor]
  - name: retrieval_comb
    datasets: [here]
    inference_only: true
    preprocessing: [paint_mask_preprocessor]
    features_extractors: [lbp_extractor]
"""


def test_sources_votes_and_frames(spark, folder, tmp_path):
    T.register("ocr", "constant_ocr")(lambda img: "Joan")
    data = T.dataset(spark, folder, folder)
    # the gallery holds the true regions themselves
    regions = I.crops(data["images"], I.mask_regions(data["masks"])).select("sample_id", "image").persist()
    assert {r.sample_id: (r.image.width, r.image.height) for r in regions.collect()} == {i: (x1 - x0 + 1, y1 - y0 + 1) for i, (x0, y0, x1, y1) in BOXES.items()}
    folders = T.run(spark, T.load(SOURCES), {"here": {**data, "database": regions}}, str(tmp_path))
    mean = lambda f: {r.metric: r["mean"] for r in spark.read.json(f"{f}/report").collect()}
    result = {r.query_id: r.db_id for r in spark.read.parquet(f"{folders[0]}/result").where("rnk = 1").collect()}
    assert result == {0: 0, 1: 1, 2: 2} and mean(folders[0]) == {"map@1": 1.0}
    assert {tuple(map(tuple, r.lists)) for r in spark.read.parquet(f"{folders[1]}/result_w2").collect()} == {((-1,),)} and mean(folders[1]) == {"map@1": 0.0}
    plane = spark.read.parquet(f"{folders[2]}/result").collect()
    assert sorted(r.sample_id for r in plane) == [0, 1, 2] and abs(sum(r.pc1 for r in plane)) < 1e-6 and all(0 <= r.component < 8 for r in plane)
    found = {r.sample_id: r.frames for r in spark.read.parquet(f"{folders[3]}/frames").collect()}
    assert set(found) == {0, 1, 2} and all(len(f.corners) == 4 for x in found.values() for f in x)
    assert spark.read.parquet(f"{folders[3]}/result").where("rnk = 1").count() >= 3


def test_rejected_crop_is_right_where_truth_is_null(spark):
    found = spark.createDataFrame([(5 * T.CROPS, 1, None), (5 * T.CROPS + 1, 1, 8), (6 * T.CROPS, 1, 2), (6 * T.CROPS, 2, 3)], "query_id long, rnk int, db_id long")
    gt = spark.createDataFrame([(5, 0, None), (5, 1, 9), (6, 0, 3), (6, 1, 2)], "query_id long, crop_pos int, db_id long")
    result, metrics = T._scored_ranks(T.Task("retrieval", [], metrics=[{"name": "map", "top_k": 10}]), found, {"correspondences": gt})
    assert {r.sample_id: r.value for r in metrics.collect()} == {5: 0.5, 6: 0.5} and result.count() == 4


def test_frame_scores_by_hand(spark):
    square = lambda x0, y0, x1, y1: [[float(a), float(b)] for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    table = lambda rows: spark.createDataFrame(rows, f"sample_id long, frames {T.FRAMES}")
    gt = table([(1, [(0.0, square(0, 0, 9, 9))]), (2, []), (3, [(10.0, square(2, 2, 5, 5)), (90.0, square(10, 10, 12, 12))])])
    pred = table([(1, [(30.0, square(5, 0, 14, 9))]), (2, []), (3, [(170.0, square(2, 2, 5, 5))])])
    sizes = spark.createDataFrame([(i, 20, 20) for i in (1, 2, 3)], "sample_id long, height int, width int")
    got = {r.sample_id: (r.jaccard, r.angle_error, r.n_angles) for r in T.frame_scores(gt, pred, sizes).collect()}
    assert got[1] == (pytest.approx(50 / 150), pytest.approx(30.0), 1)
    assert got[2] == (1.0, 0.0, 0) and got[3] == (pytest.approx(16 / 25), pytest.approx(0.0, abs=1e-5), 1)


def _random_frames(rng, h, w):
    """Upright and turned quadrangles, triangles and frames without corners; on pixels, between, beyond the border and as lines."""
    out = []
    for _ in range(rng.integers(0, 5)):
        x0, y0 = rng.integers(-5, w + 5), rng.integers(-5, h + 5)
        dx, dy = rng.integers(0, 12, 2)
        near = rng.choice([0, 0, 0.5, 0.25, 1e-10, 1e-7])
        square = [[x0 + near, y0 + near], [x0 + dx + near, y0 + near], [x0 + dx + near, y0 + dy + near], [x0 + near, y0 + dy + near]]
        kinds = [square, square[::-1], square[1:] + square[:1], square[:3], rng.uniform(-3, 30, (4, 2)).tolist(), [], [[0.2, 0.2], [0.3, 0.2], [0.3, 0.3], [0.2, 0.3]]]
        out.append({"angle": float(rng.choice([0, 10, 33.3, 179, 90])), "corners": [list(map(float, p)) for p in kinds[rng.integers(0, len(kinds))]]})
    return out if rng.random() > 0.1 else None


def _by_frames(row):
    """Jaccard, angle error and number by one frame after the other."""
    on = np.zeros((2, row["height"], row["width"]), bool)
    a, b = row["gt"] or [], row["pred"] or []
    for side, found in zip(on, (a, b)):
        for f in found:
            side |= T.K.polygon(side.shape, np.array(f["corners"], float)) > 0
    either = on.any(axis=0).sum()
    wrong = [T._turned(x["angle"], y["angle"]) for x, y in zip(a, b)]
    return on.all(axis=0).sum() / either if either else 1.0, sum(wrong), len(wrong)


_FRAME_BATCH = pa.schema([("sample_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), *[(c, pa.list_(pa.struct([("angle", pa.float64()), ("corners", pa.list_(pa.list_(pa.float64())))]))) for c in ("gt", "pred")]])


def _frame_batch(rows):
    return pa.RecordBatch.from_pylist(rows, schema=_FRAME_BATCH)


@pytest.mark.parametrize("seed", range(6))
def test_frames_of_a_batch_match_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    sizes = [(int(h), int(w)) for h, w in rng.integers(1, 40, (60, 2))] + [(0, 7), (1200, 1000), (9, 9), (900, 1300)]
    rows = [{"sample_id": i, "height": h, "width": w, "gt": _random_frames(rng, h, w), "pred": _random_frames(rng, h, w)} for i, (h, w) in enumerate(sizes)]
    for batch in (_frame_batch(rows), _frame_batch(rows).slice(7, 50), _frame_batch([])):
        (got,) = T._frame_rows([batch])
        want = [(r["sample_id"], *_by_frames(r)) for r in batch.to_pylist()]
        found = list(zip(*got.to_pydict().values())) if got.num_rows else []
        assert [f[0] for f in found] == [x[0] for x in want] and [f[3] for f in found] == [x[3] for x in want]
        assert np.allclose([f[1:3] for f in found], [x[1:3] for x in want], rtol=1e-12, atol=1e-12)


def test_upright_frames_are_rasterised_together(monkeypatch):
    monkeypatch.setattr(T.K, "polygon", None)
    square = lambda x, y: [{"angle": 5.0, "corners": [[x, y], [x + 6.0, y], [x + 6.0, y + 5.0], [x, y + 5.0]]}]
    (got,) = T._frame_rows([_frame_batch([{"sample_id": i, "height": 32, "width": 32, "gt": square(1.0, 2.0), "pred": square(1.0 + i % 3, 2.0)} for i in range(2000)])])
    assert got.column(1).to_pylist()[:3] == [1.0, 36 / 48, 30 / 54] and got.column(3).to_pylist() == [1] * 2000


def test_frame_without_angle_or_size_is_an_error():
    row = {"sample_id": 1, "height": 3, "width": 3, "gt": [{"angle": None, "corners": []}], "pred": []}
    with pytest.raises(ValueError, match="no angle"):
        list(T._frame_rows([_frame_batch([row])]))
    with pytest.raises(ValueError, match="no size"):
        list(T._frame_rows([_frame_batch([row | {"gt": [], "width": None}])]))


def test_frame_score_gathers_lines_not_frames(spark, sf):
    plan = frames.frame_score(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FLOOR" not in plan[plan.index("Exchange") :]  # corners are made of floors


def test_hamming_and_pairs(spark):
    from facetta.operators import retrieval as R

    words = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, (12, 2))
    rows = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "vec_id long, embedding array<long>")
    got = {(r.query_id, r.db_id): r.dist for r in R.full_ranking(rows.where("vec_id < 4"), rows, "hamming", skip_self=False).collect()}
    bits = lambda a, b: float(np.bitwise_count((words[a] ^ words[b]).view(np.uint64)).sum())
    assert got == {(a, b): bits(a, b) for a in range(4) for b in range(12)}
    pairs = R.all_pairs(spark.range(3).withColumnRenamed("id", "query_id"), spark.range(5).withColumnRenamed("id", "db_id"))
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(3) for b in range(5)]


def test_principal_axes_match_svd(spark):
    x = np.random.default_rng(4).normal(size=(200, 30)) * np.linspace(3, 0.5, 30) + 5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    mean, axes = T.principal_axes(rows, rounds=40)
    right = np.linalg.svd(x - x.mean(axis=0))[2][:2].T
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs((axes * right).sum(axis=0)), 1, atol=1e-3)

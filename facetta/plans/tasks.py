"""Tasks of a configuration: chains of operators over image tables, scored against their truth.

A configuration has a list ``tasks``; an entry names its task, datasets, preprocessing chain, extractors, tokenizer,
metrics and distance. Lists among a metric's parameters stand for every combination. Unknown names are errors that
list the known ones.
"""

from __future__ import annotations

import argparse
import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetta.functions import kernels as K
from facetta.functions import text_metrics as X
from facetta.functions import vectors as V
from facetta.operators import codebook as B
from facetta.operators import images as I
from facetta.operators import retrieval as R
from facetta.operators import tokenizers as T
from facetta.sources import images as S

#: More than the crops that an image can have: a crop's key is its sample_id times this and its position.
CROPS = 1 << 24
#: More than the keypoints that a crop can have (its longer side is scaled to 424 pixels): query keys leave room for 2^21 images.
KEYPOINTS = 1 << 18
FRAMES = "array<struct<angle:double,corners:array<array<double>>>>"
#: Plug-ins by kind and name.
REGISTRY: dict[str, dict[str, Callable]] = {"task": {}, "metric": {}, "ocr": {}, "tokenizer": {"bpe_tokenizer": T, "word_tokenizer": T, "visual_codebook_tokenizer": B}, "preprocessing": {**I.ENHANCE, **I.MASKS, **I.TEXTS}, "features_extractor": {**I.FEATURES, **I.KEYPOINTS, "visual_codebook_extractor": B.tokenize}, "distance": {**dict.fromkeys(("cosine", "l1", "euclidean"), R.knn), "jaccard_dist": X.jaccard, "bag_dist": X.bag}}
#: Metrics by what they compare: "image" a metric of two images, "str" texts, "token" token lists, "bb" boxes, "rank" rankings, "vector" two vectors.
INPUT: dict[str, str] = {**dict.fromkeys(X.OF_TEXTS, "str"), **dict.fromkeys(X.OF_TOKENS, "token"), "iou": "bb", "map": "rank", "raw_accuracy": "rank"}
#: Entries of a plug-in that are the task's, not the plug-in's own parameters.
OF_TASK = {"name", "feats_w", "distance", "in_db_thr", "norm", "quality_thr", "matches_thr"}


def register(kind: str, name: str):
    """Decorator: a plug-in under a name."""

    def put(f):
        REGISTRY.setdefault(kind, {})[name] = f
        return f

    return put


def resolve(kind: str, name: str) -> Callable:
    known = REGISTRY.get(kind, {})
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


@dataclass
class Task:
    name: str
    datasets: list[str]
    preprocessing: list[str] = field(default_factory=list)
    features_extractors: list[str] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)
    distance: str = "cosine"
    inference_only: bool = False
    #: Entries of the preprocessors and extractors by name: OF_TASK and the plug-in's own parameters.
    options: dict[str, dict] = field(default_factory=dict)
    tokenizer: dict | None = None
    #: Name of the registered function of a cropped image that reads its text.
    ocr: str | None = None
    use_gt: bool = False
    k_mixtures: int = 8
    #: Tables kept while the task runs; ``run`` releases them.
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def keep(self, rows: DataFrame) -> DataFrame:
        self.held.append(rows.persist())
        return self.held[-1]

    def release(self) -> None:
        for rows in self.held:
            rows.unpersist()
        self.held.clear()

    def own(self, name: str) -> dict:
        """The parameters of a plug-in."""
        return {k: v for k, v in self.options.get(name, {}).items() if k not in OF_TASK}


def _names(items) -> list[str]:
    return [x["name"] if isinstance(x, dict) else x for x in items or []]


def expand(metric: dict) -> list[dict]:
    """Every combination of a metric's list-valued parameters."""
    keys = [k for k, v in metric.items() if isinstance(v, list)]
    return [{**metric, **dict(zip(keys, values))} for values in itertools.product(*[metric[k] for k in keys])]


def load(text: str) -> list[Task]:
    """The tasks of a YAML text, every name checked before anything runs."""
    import yaml

    out = []
    for entry in (yaml.safe_load(text) or {}).get("tasks", []):
        distance = entry.get("distance") or "cosine"
        task = Task(
            entry["name"], _names(entry.get("datasets")), _names(entry.get("preprocessing")), _names(entry.get("features_extractors")),
            [m for x in entry.get("metrics") or [] for m in expand(x if isinstance(x, dict) else {"name": x})], distance["name"] if isinstance(distance, dict) else distance, bool(entry.get("inference_only")),
            {x["name"]: x for kind in ("preprocessing", "features_extractors") for x in entry.get(kind) or [] if isinstance(x, dict)}, entry.get("tokenizer"), entry.get("ocr"), bool(entry.get("use_gt")), int(entry.get("k_mixtures") or 8),
        )
        for kind, names in (("task", [task.name]), ("preprocessing", task.preprocessing), ("features_extractor", task.features_extractors), ("metric", _names(task.metrics)), ("distance", [task.distance, *(o["distance"]["name"] for o in task.options.values() if o.get("distance"))]), ("tokenizer", [task.tokenizer["name"]] if task.tokenizer else []), ("ocr", [task.ocr] if task.ocr else [])):
            for name in names:
                resolve(kind, name)
        for table in (I.ENHANCE, I.MASKS, I.TEXTS, I.FEATURES, I.KEYPOINTS):
            for name in {*task.preprocessing, *task.features_extractors} & set(table):
                I.bound(table, name, task.own(name))
        out.append(task)
    return out


# ---- metrics of two images (arrays of bytes), and of the rank of the first hit

_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@register("metric", "accuracy")
def accuracy(gt: np.ndarray, pred: np.ndarray) -> float:
    return float(((gt != 0) == (pred != 0)).mean())


@register("metric", "precision")
def precision(gt: np.ndarray, pred: np.ndarray) -> float:
    return float(((gt != 0) & (pred != 0)).sum() / ((pred != 0).sum() + 1e-8))


@register("metric", "recall")
def recall(gt: np.ndarray, pred: np.ndarray) -> float:
    return precision(pred, gt)


@register("metric", "f1")
def f1(gt: np.ndarray, pred: np.ndarray) -> float:
    p, r = precision(gt, pred), recall(gt, pred)
    return 2 * p * r / (p + r + 1e-5)


@register("metric", "mae")
def mae(gt: np.ndarray, pred: np.ndarray) -> float:
    """Mean absolute difference, each side over 255 where it has values above 1."""
    a, b = (x / (255.0 if x.size and x.max() > 1 else 1.0) for x in (gt, pred))
    return float(np.abs(a - b).sum() / (gt.size + 1e-8))


@register("metric", "psnr")
def psnr(gt: np.ndarray, pred: np.ndarray) -> float:
    mse = float(((gt.astype(float) - pred) ** 2).mean())
    return 100.0 if mse == 0 else 20 * math.log10(255 / math.sqrt(mse))


@register("metric", "ssim")
def ssim(gt: np.ndarray, pred: np.ndarray, window: int = 7, span: float = 255.0) -> float | None:
    """Structural similarity: the mean over channels and whole windows; null for images smaller than a window."""
    a, b = (x.reshape(*x.shape[:2], -1).astype(float) for x in (gt, pred))
    if min(a.shape[:2]) < window:
        return None

    def means(x):
        total = np.pad(x, ((1, 0), (1, 0), (0, 0))).cumsum(0).cumsum(1)
        return (total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]) / window**2

    ma, mb, n = means(a), means(b), window**2 / (window**2 - 1)
    va, vb, both = n * (means(a * a) - ma * ma), n * (means(b * b) - mb * mb), n * (means(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float(((2 * ma * mb + c1) * (2 * both + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


for _name, _distance in X.OF_TEXTS.items() | X.OF_TOKENS.items():
    register("metric", _name)(_distance)
for _name, _column in (("euclidian_distance", V.euclidean), ("l1_distance", V.l1), ("chi2_distance", V.chi2), ("hellinger_kernel_distance", V.hellinger), ("histogram_intersection_similarity", V.intersection)):
    register("metric", _name)(_column)
    INPUT[_name] = "vector"


@register("metric", "map")
def mean_reciprocal(first: Column, top_k: int = 10) -> Column:
    return F.when(first <= top_k, 1 / first).otherwise(0.0)


@register("metric", "raw_accuracy")
def raw_accuracy(first: Column) -> Column:
    return F.when(first == 1, 1.0).otherwise(0.0)


def _label(metric: dict) -> str:
    return metric["name"] + "".join(f"@{v}" for k, v in metric.items() if k != "name")


def compared(frame: DataFrame, metrics: list[dict]) -> DataFrame:
    """sample_id, metric and value of the columns gt and pred; null where one is missing or sizes differ.

    The columns are bytes, or images (structs of height, width, nChannels and data), which metrics of windows need.
    """
    functions = [(_label(m), resolve("metric", m["name"]), {k: v for k, v in m.items() if k != "name"}) for m in metrics if INPUT.get(m["name"], "image") == "image"]
    shaped = dict(frame.dtypes)["gt"] != "binary"

    def side(x):
        if not shaped:
            return None if x is None else np.frombuffer(x, np.uint8)
        return None if x is None or x["data"] is None else I.decode(x["height"], x["width"], x["nChannels"], x["data"])

    def run(frames):
        for part in frames:
            rows = []
            for at, *data in part.itertuples(index=False):
                sides = [side(d) for d in data]
                fit = not any(x is None for x in sides) and sides[0].shape == sides[1].shape and sides[0].size > 0
                rows += [(at, name, f(*sides, **params) if fit else None) for name, f, params in functions]
            yield pd.DataFrame(rows, columns=["sample_id", "metric", "value"])

    of = (lambda c: F.col(c)) if not shaped else (lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("height", "width", "nChannels", "data")])).alias(c))
    return frame.select("sample_id", of("gt"), of("pred")).mapInPandas(run, "sample_id long, metric string, value double")


def compared_texts(frame: DataFrame, metrics: list[dict], key: str = "sample_id") -> DataFrame:
    """key, metric and value of text metrics: gt has the true lines, each a list of fields, pred the predicted texts.

    Columns gt_tokens and pred_tokens, where there are any, hold the same with token lists in place of texts; without
    them metrics of tokens are left out. A null side counts as empty, an empty side has a null value.
    """
    tokens = "gt_tokens" in frame.columns
    wanted = [(_label(m), resolve("metric", m["name"]), INPUT.get(m["name"]) == "token") for m in metrics if INPUT.get(m["name"]) == "str" or tokens and INPUT.get(m["name"]) == "token"]

    def lists(x):
        return [] if x is None else [list(y) if y is not None else [] for y in x]

    def run(frames):
        for part in frames:
            rows = []
            for at, gt, pred, *more in part.itertuples(index=False):
                texts = ([] if pred is None else list(pred), lists(gt))
                coded = ([list(p) for p in more[1]] if more and more[1] is not None else [], [[list(f) for f in line] for line in more[0]] if more and more[0] is not None else [])
                rows += [(at, name, X.worst(*(coded if of_tokens else texts), f)) for name, f, of_tokens in wanted]
            yield pd.DataFrame(rows, columns=[key, "metric", "value"])

    return frame.select(key, "gt", "pred", *(["gt_tokens", "pred_tokens"] if tokens else [])).mapInPandas(run, f"{key} long, metric string, value double")


def scored(frame: DataFrame, metrics: list[dict], over: str) -> DataFrame:
    """sample_id, metric and value of metrics that are columns; parameters are part of a metric's name."""
    columns = [F.struct(F.lit(_label(m)).alias("metric"), resolve("metric", m["name"])(F.col(over), **{k: v for k, v in m.items() if k != "name"}).alias("value")) for m in metrics if INPUT.get(m["name"]) == "rank"]
    if not columns:
        return frame.select("sample_id", F.lit("").alias("metric"), F.lit(None).cast("double").alias("value")).limit(0)
    return frame.select("sample_id", F.explode(F.array(*columns)).alias("m")).select("sample_id", "m.*")


def chain(images: DataFrame, task: Task) -> DataFrame:
    """Enhancements in order, the image of one feeds the next."""
    for name in task.preprocessing:
        if name in I.ENHANCE:
            images = I.enhance(images, name, options=task.own(name))
    return images


# ---- tasks: (result, metrics) of a task over a dataset, a dict of tables


@register("task", "masking")
def masking(task: Task, data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """The chain's last mask; its metrics against ``masks``."""
    kinds = [n for n in task.preprocessing if n in I.MASKS]
    if not kinds:
        raise ValueError("masking needs a mask preprocessor")
    found = I.masks(chain(data["images"], task), kinds[-1], options=task.own(kinds[-1]))
    if task.inference_only or "masks" not in data:
        return found, None
    made = F.struct("height", "width", F.lit(1).alias("nChannels"), F.col("mask").alias("data")).alias("pred")
    return found, compared(found.select("sample_id", made).join(mask_images(data["masks"]), "sample_id"), task.metrics)


def mask_images(masks_: DataFrame) -> DataFrame:
    """sample_id and gt, the true masks as images of one channel: colours become their luma, and 255 where there is any."""
    one = lambda img: [(None,) * 3] if img is None else [(*img.shape[:2], ((K.gray(img) > 0) * np.uint8(255)).tobytes())]
    flat = I.over(masks_, "sample_id", one, "sample_id long, height int, width int, data binary")
    return flat.select("sample_id", F.struct("height", "width", F.lit(1).alias("nChannels"), "data").alias("gt"))


@register("task", "denoising")
def denoising(task: Task, data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Enhanced images; their metrics against ``clean``."""
    found = chain(data["images"].select("sample_id", "image"), task)
    if task.inference_only or "clean" not in data:
        return found, None
    gt = data["clean"].select("sample_id", F.col("image").alias("gt"))
    return found, compared(found.select("sample_id", F.col("image").alias("pred")).join(gt, "sample_id"), task.metrics)


def tokens_of(task: Task, data: dict[str, DataFrame], text: Column) -> Column | None:
    """Token lists of texts by the task's tokenizer, fitted to the annotations; null without one."""
    if not task.tokenizer or task.tokenizer["name"] not in ("bpe_tokenizer", "word_tokenizer"):
        return None
    if task.tokenizer["name"] == "word_tokenizer" or "annotations" not in data:
        return T.words(text)
    noted = data["annotations"].select(F.array_join("fields", " ").alias("text"))
    return T.words(text) if noted.isEmpty() else T.encode(text, T.fit(noted, "text", T.Subwords(size=int(task.tokenizer.get("vocab_size", 256)))))


def text_lines(task: Task, found: DataFrame, data: dict[str, DataFrame]) -> DataFrame:
    """sample_id, gt, pred (and gt_tokens, pred_tokens with a tokenizer) for ``compared_texts``."""
    read = found.select("sample_id", F.posexplode("texts").alias("i", "text"), "crop_pos")
    noted = data["annotations"].select("sample_id", "line_no", F.posexplode("fields").alias("i", "text"))
    code = tokens_of(task, data, F.col("text"))
    if code is not None:
        read, noted = read.withColumn("tokens", code), noted.withColumn("tokens", code)
    names = ["text"] + (["tokens"] if code is not None else [])
    pred = read.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("crop_pos", "i", *names))).alias("x"))
    lines = noted.groupBy("sample_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("y"))
    gt = lines.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "y"))).alias("z"))
    both = gt.join(pred, "sample_id", "left")
    field = lambda name: F.transform("z", lambda line: F.transform(line["y"], lambda f: f[name]))
    columns = [field("text").alias("gt"), F.col("x.text").alias("pred")]
    return both.select("sample_id", *columns, *([field("tokens").alias("gt_tokens"), F.col("x.tokens").alias("pred_tokens")] if code is not None else []))


@register("task", "text_detection")
def text_detection(task: Task, data: dict[str, DataFrame], ocr=None) -> tuple[DataFrame, DataFrame | None]:
    """Text boxes of the crops in coordinates of the whole image, their masks and texts; box metrics against ``text_boxes``, text metrics against ``annotations``."""
    detector = next((n for n in task.preprocessing if n in I.TEXTS), None)
    if detector is None:
        raise ValueError("text_detection needs a text detector")
    ocr, own = ocr or (REGISTRY["ocr"][task.ocr] if task.ocr else None), task.own(detector)
    images = chain(data["images"].select("sample_id", "image"), task)
    kinds = [n for n in task.preprocessing if n in I.MASKS]
    if kinds:
        places = I.masks(images, kinds[-1], options=task.own(kinds[-1])).select("sample_id", "boxes")
        cut = I.crops(images, places).withColumn("crop_key", F.col("sample_id") * CROPS + F.col("crop_pos"))
        found = I.text_boxes(cut, detector, "crop_key", ocr=ocr, options=own).withColumns({"sample_id": F.expr(f"crop_key div {CROPS}"), "crop_pos": F.pmod("crop_key", F.lit(CROPS)).cast("int")})
        moved = found.join(places.withColumnRenamed("boxes", "places"), "sample_id", "left")
        x, y = (F.coalesce(F.get(F.get("places", "crop_pos"), i), F.lit(0)) for i in (0, 1))
        found = moved.select("sample_id", "crop_pos", F.transform("boxes", lambda b: F.array(b[0] + x, b[1] + y, b[2] + x, b[3] + y)).alias("boxes"), "texts", "height", "width", "text_mask")
    else:
        found = I.text_boxes(images, detector, ocr=ocr, options=own).select("sample_id", F.lit(0).alias("crop_pos"), "boxes", "texts", "height", "width", "text_mask")
    if task.inference_only:
        return found, None
    kinds_of = {INPUT.get(m["name"]) for m in task.metrics} if task.metrics else {"bb"}
    parts = []
    if "bb" in kinds_of and "text_boxes" in data:
        parts.append(box_iou(data["text_boxes"], found.groupBy("sample_id").agg(F.flatten(F.collect_list("boxes")).alias("boxes"))))
    if kinds_of & {"str", "token"} and "annotations" in data:
        parts.append(compared_texts(text_lines(task, found, data), task.metrics))
    return found, reduce(DataFrame.unionByName, parts) if parts else None


@register("metric", "iou")
def box_iou(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """For each sample the mean over true boxes of the best intersection over union; 0 without true boxes."""
    edge = lambda b, i: b[i].cast("double")
    area = lambda b: (edge(b, 2) - edge(b, 0)) * (edge(b, 3) - edge(b, 1))

    def one(a, b):
        w = F.greatest(F.lit(0.0), F.least(edge(a, 2), edge(b, 2)) - F.greatest(edge(a, 0), edge(b, 0)))
        h = F.greatest(F.lit(0.0), F.least(edge(a, 3), edge(b, 3)) - F.greatest(edge(a, 1), edge(b, 1)))
        return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))

    both = gt.select("sample_id", F.col("boxes").alias("gt")).join(pred.select("sample_id", F.coalesce("boxes", F.array().cast("array<array<int>>")).alias("pred")), "sample_id", "left")
    best = F.transform("gt", lambda a: F.coalesce(F.array_max(F.transform("pred", lambda b: one(a, b))), F.lit(0.0)))
    return both.select("sample_id", F.lit("iou").alias("metric"), F.coalesce(F.try_divide(_sum(best), F.size("gt")), F.lit(0.0)).alias("value"))


def _vectors(task: Task, data: dict[str, DataFrame], images: DataFrame, names: list[str]) -> DataFrame:
    """vec_id and embedding: the vectors of all extractors, joined end to end. Visual words are those of the database."""
    out = None
    for i, name in enumerate(names):
        if name == "visual_codebook_extractor":
            if not task.tokenizer or task.tokenizer["name"] != "visual_codebook_tokenizer":
                raise ValueError("visual_codebook_extractor needs the visual_codebook_tokenizer")
            own = {k: int(v) for k, v in task.tokenizer.items() if k in ("k_size", "sample", "channel", "num_words")}
            found = B.tokenize(images, B.fit(data["database"] if "database" in data else images, **own))
        else:
            found = I.features(images, name, options=task.own(name))
        one = found.select(F.col("sample_id").alias("vec_id"), F.col("vector").alias(f"v{i}"))
        out = one if out is None else out.join(one, "vec_id")
    return out.select("vec_id", F.concat(*[f"v{i}" for i in range(len(names))]).alias("embedding"))


def query_crops(task: Task, data: dict[str, DataFrame]) -> DataFrame:
    """sample_id (a crop's key), image and texts: the chain's output, cut by true regions or the last mask, its text erased."""
    images = chain(data["images"].select("sample_id", "image"), task)
    kinds, detector = [n for n in task.preprocessing if n in I.MASKS], next((n for n in task.preprocessing if n in I.TEXTS), None)
    places = I.mask_regions(data["masks"]) if task.use_gt and "masks" in data else I.masks(images, kinds[-1], options=task.own(kinds[-1])) if kinds else None
    cut = images.withColumn("crop_pos", F.lit(0)) if places is None else I.crops(images, places.select("sample_id", "boxes"))
    cut = cut.select((F.col("sample_id") * CROPS + F.col("crop_pos")).alias("sample_id"), "image")
    ocr = REGISTRY["ocr"][task.ocr] if task.ocr else None
    return I.without_text(cut, detector, ocr, options=task.own(detector)) if detector else cut.withColumn("texts", F.lit(None).cast("array<string>"))


def frames(task: Task, data: dict[str, DataFrame]) -> DataFrame | None:
    """sample_id and frames (angle, corners) of the last mask; samples without a frame have an empty list."""
    kinds = [n for n in task.preprocessing if n in I.MASKS]
    if not kinds:
        return None
    found = I.masks(chain(data["images"].select("sample_id", "image"), task), kinds[-1], options=task.own(kinds[-1]))
    return found.select("sample_id", F.coalesce(F.arrays_zip("angles", "corners").cast(FRAMES), F.array().cast(FRAMES)).alias("frames"))


def _tokens(rows: DataFrame, key: str, model) -> DataFrame:
    """key, token and k, its count in the row's text."""
    split = T.words(F.col("text")) if model is None else T.encode(F.col("text"), model)
    return rows.select(key, F.explode(split).alias("token")).groupBy(key, "token").agg(F.count("*").alias("k"))


def text_ranking(task: Task, crops: DataFrame, data: dict[str, DataFrame]) -> DataFrame:
    """query_id, db_id, dist and rank (from 0) of every database item by the tokens of its annotation."""
    if not any(n in I.TEXTS for n in task.preprocessing) or not task.ocr:
        raise ValueError("a tokenizer needs a text detector and an ocr plug-in")
    lines = data["annotations"].groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "fields"))).alias("x"))
    noted = lines.select(F.col("sample_id").alias("db_id"), F.array_join(F.flatten(F.col("x.fields")), " ").alias("text"))
    asked = crops.select(F.col("sample_id").alias("query_id"), F.array_join(F.coalesce("texts", F.array().cast("array<string>")), " ").alias("text"))
    options = task.tokenizer
    model = T.fit(noted, "text", T.Subwords(size=int(options.get("vocab_size", 256)))) if options["name"] == "bpe_tokenizer" else None
    q, d = _tokens(asked, "query_id", model), _tokens(noted, "db_id", model)
    common = q.join(d.withColumnRenamed("k", "kd"), "token").groupBy("query_id", "db_id").agg(F.sum(F.least("k", "kd")).alias("common"))
    pairs = R.all_pairs(asked, data["database"].select(F.col("sample_id").alias("db_id")))
    sized = pairs.join(q.groupBy("query_id").agg(F.sum("k").alias("nq")), "query_id", "left").join(d.groupBy("db_id").agg(F.sum("k").alias("nd")), "db_id", "left").join(common, ["query_id", "db_id"], "left")
    c, n, m = (F.coalesce(F.col(x), F.lit(0)) for x in ("common", "nq", "nd"))
    bag = (options.get("distance") or {}).get("name", "bag_dist") == "bag_dist"
    dist = F.greatest(n - c, m - c).cast("double") if bag else F.coalesce(1 - F.try_divide(c.cast("double"), n + m - c), F.lit(0.0))
    scored = sized.select("query_id", "db_id", F.round(dist, 9).alias("dist"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "db_id")) - 1)


def source_ranking(task: Task, name: str, crops: DataFrame, data: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """The ranking (query_id, db_id, rank) of an extractor and the column that tells whether a row votes for acceptance.

    Keypoint images are scored by the share of descriptors that pass the ratio test; pairs without a match score 0.
    Without a threshold a source always votes.
    """
    options, database = task.options.get(name, {}), data["database"]
    if name not in I.KEYPOINTS:
        distance = options.get("distance") or {}
        limit = distance.get("in_db_thr")
        found = R.full_ranking(_vectors(task, data, crops, [name]), _vectors(task, data, database, [name]), distance.get("name", task.distance), skip_self=False)
        return found, F.lit(True) if limit is None else F.col("dist") <= float(limit)
    each = lambda rows: I.keypoints(rows, name, options=task.own(name)).select((F.col("sample_id") * KEYPOINTS + F.col("kp")).alias("vec_id"), F.col("sample_id").alias("image_id"), F.col("descriptor").alias("embedding"))
    kind = "hamming" if options.get("norm", "hamming" if name.startswith("orb") else "l2") == "hamming" else "euclidean"
    scores = R.ratio_matches(each(crops), each(database), "image_id", float(options.get("quality_thr", 0.75)), kind, skip_self=False)
    pairs = R.all_pairs(crops.select(F.col("sample_id").alias("query_id")), database.select(F.col("sample_id").alias("db_id")))
    full = pairs.join(scores.withColumnsRenamed({"q_image": "query_id", "db_image": "db_id"}), ["query_id", "db_id"], "left")
    full = full.withColumn("score", F.coalesce("score", F.lit(0.0)))
    limit = options.get("matches_thr")
    return R.score_ranks(full, "query_id", "db_id"), F.lit(True) if limit is None else F.col("score") >= float(limit)


def _reads_text(task: Task) -> bool:
    return bool(task.tokenizer) and task.tokenizer["name"] != "visual_codebook_tokenizer"


def _scored_ranks(task: Task, found: DataFrame, data: dict[str, DataFrame]):
    """Predictions of crops; a metric's value of a sample is the mean over its true items that have a crop.

    A rejected crop has a null db_id, which is right where the truth is null too.
    """
    split = [F.expr(f"query_id div {CROPS}").alias("query_id"), F.pmod("query_id", F.lit(CROPS)).cast("int").alias("crop_id")]
    result = found.select(*split, F.col("rnk").cast("int").alias("rnk"), "db_id")
    if task.inference_only or "correspondences" not in data:
        return result, None
    gt = data["correspondences"].select("query_id", F.col("crop_pos").alias("crop_id"), F.col("db_id").alias("gt_id"))
    hit = F.when(F.col("db_id").eqNullSafe(F.col("gt_id")), F.col("rnk"))
    first = gt.join(result, ["query_id", "crop_id"]).groupBy("query_id", "crop_id").agg(F.min(hit).alias("first"))
    each = scored(first.withColumnRenamed("query_id", "sample_id"), task.metrics, "first")
    return result, each.groupBy("sample_id", "metric").agg(F.avg("value").alias("value"))


@register("task", "retrieval_comb")
def retrieval_comb(task: Task, data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Neighbours by the joined vectors of all extractors."""
    crops = task.keep(query_crops(task, data))
    sides = [_vectors(task, data, x, task.features_extractors) for x in (crops, data["database"])]
    return _scored_ranks(task, R.knn(*sides, 10, task.distance, skip_self=False), data)


@register("task", "retrieval")
def retrieval(task: Task, data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Neighbours by the first extractor; only those that the text (or, without a tokenizer, the next extractor) finds too, in the order of the first."""
    crops, found = task.keep(query_crops(task, data)), []
    for name in task.features_extractors[: 1 if _reads_text(task) else 2]:
        near = int((task.options.get(name, {}).get("distance") or {}).get("n_neighbors", 10))
        if name in I.KEYPOINTS:
            ranked, _ = source_ranking(task, name, crops, data)
            found.append(ranked.withColumnRenamed("rank", "rnk").withColumn("rnk", F.col("rnk") + 1).where(F.col("rnk") <= near))
            continue
        found.append(R.knn(*[_vectors(task, data, x, [name]) for x in (crops, data["database"])], near, task.distance, skip_self=False))
    if _reads_text(task):
        near = int((task.tokenizer.get("distance") or {}).get("n_neighbors", 10))
        found.append(text_ranking(task, crops, data).where(F.col("rank") < near))
    both = R.intersect_candidates(*found) if len(found) > 1 else found[0]
    return _scored_ranks(task, both.where("rnk <= 10"), data)


@register("task", "retrieval_distcomb")
def retrieval_distcomb(task: Task, data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Rankings of every source, fused by their weighted ranks; crops that too few extractors accept are rejected. Text has no vote."""
    crops = task.keep(query_crops(task, data))
    ranks, said = [], []
    if _reads_text(task):
        ranks.append((text_ranking(task, crops, data), float(task.tokenizer.get("feats_w") or 1.0)))
    for name in task.features_extractors:
        found, vote = source_ranking(task, name, crops, data)
        ranks.append((found, float(task.options.get(name, {}).get("feats_w") or 1.0)))
        said.append((found, vote))
    fused = R.borda(ranks).where("rnk <= 10")
    return _scored_ranks(task, R.reject(fused, R.votes(said)) if said else fused, data)


def principal_axes(rows: DataFrame, k: int = 2, more: int = 6, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the column ``embedding``: subspace iteration, each round one pass over the vectors.

    No matrix of width x width forms: a partition gives its width x (k + more) sums, which are added by
    position before the driver sees them. The largest loading of each axis is positive.
    """
    n, width = rows.count(), len(rows.first().embedding)

    def added(f, columns: int) -> np.ndarray:
        def run(batches):
            total = np.zeros((width, columns))
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                total += f(np.asarray(flat, float).reshape(batch.num_rows, width))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *(pa.array(c) for c in total.T)], names=names)

        names = ["at", *(f"c{i}" for i in range(columns))]
        parts = rows.select("embedding").mapInArrow(run, "at long, " + ", ".join(f"c{i} double" for i in range(columns)))
        found = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas().sort_values("at")
        return found[names[1:]].to_numpy()

    mean = added(lambda x: x.sum(axis=0)[:, None], 1)[:, 0] / n
    size = min(k + more, width)
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(rounds):
        image = added(lambda x, axes=axes: (x - mean).T @ ((x - mean) @ axes), size)
        values, turn = np.linalg.eigh(axes.T @ image)
        best = axes @ turn[:, np.argsort(-values)]
        axes = np.linalg.qr(image)[0]
    best = best[:, :k]
    return mean, best * np.where(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])] < 0, -1.0, 1.0)


@register("task", "visualize")
def visualize(task: Task, data: dict[str, DataFrame], mixtures: int | None = None, seed: int = 3) -> tuple[DataFrame, None]:
    """The plot's data: each crop's place on two principal components of the first extractor, and its mixture component."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = task.keep(_vectors(task, data, query_crops(task, data), task.features_extractors[:1]).where("embedding is not null"))
    mean, axes = principal_axes(rows, seed=seed)

    def place(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(mean))
            at = (x - mean) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["crop", "pc1", "pc2"])

    plane = rows.select("vec_id", "embedding").mapInArrow(place, "crop long, pc1 double, pc2 double").withColumn("features", array_to_vector(F.array("pc1", "pc2")))
    named = GaussianMixture(k=mixtures or task.k_mixtures, seed=seed, maxIter=50).fit(plane).transform(plane)
    return named.select(F.expr(f"crop div {CROPS}").alias("sample_id"), F.pmod("crop", F.lit(CROPS)).cast("int").alias("crop_id"), "pc1", "pc2", F.col("prediction").alias("component"), F.array_max(vector_to_array("probability")).alias("probability")), None


#: Pixels of the samples that are rasterised at once; a larger sample is alone.
PIXELS = 1 << 20


def _frame_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The number of frames of each sample, and the angle and corners of every frame."""
    angle, corners = column.flatten().flatten()
    if angle.null_count:
        raise ValueError("a frame has no angle")
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), angle.to_numpy(zero_copy_only=False), corners


def _upright(corners: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which frames are upright rectangles of plain coordinates, and the least x and y and greatest x and y of these.

    Plain: whole or clearly between pixels, so that no pixel lies on an edge by a rounding error.
    """
    n, points = pc.fill_null(pc.list_value_length(corners), 0).to_numpy(zero_copy_only=False).astype(np.int64), corners.flatten()
    if points.null_count or not pc.all(pc.equal(pc.list_value_length(points), 2)).as_py():
        return np.zeros(len(corners), bool), np.zeros((0, 4))
    four = n == 4
    q = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)[(np.cumsum(n) - n)[four, None] + np.arange(4)]
    same = q == np.roll(q, -1, axis=1)
    box = np.concatenate([q.min(axis=1), q.max(axis=1)], axis=1)
    side, off = box[:, 2:] - box[:, :2], np.abs(box - np.rint(box))
    plain = ((off == 0) | (off > 1e-6)).all(axis=1) & ((side == 0) | (side >= 1)).all(axis=1) & (np.abs(box) < 1e6).all(axis=1)
    turns = (same[:, ::2, 0] & same[:, 1::2, 1]).all(axis=1) | (same[:, ::2, 1] & same[:, 1::2, 0]).all(axis=1)
    four[four] = plain & turns
    return four, box[plain & turns]


def _rasters(corners: pa.ListArray, of: np.ndarray, h: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The pixels of all samples one after the other, those within a frame set; of: the sample of each frame, start: where its pixels begin."""
    steps = np.zeros(start[-1] + 1, np.int32)
    upright, box = _upright(corners)
    at = of[upright]
    x0, y0 = (np.maximum(np.ceil(box[:, i]), 0).astype(np.int64) for i in (0, 1))
    x1, y1 = (np.minimum(np.floor(box[:, i]) + 1, n[at]).astype(np.int64) for i, n in ((2, w), (3, h)))
    lines = np.where(x1 > x0, np.maximum(y1 - y0, 0), 0)
    f = np.repeat(np.arange(len(at)), lines)
    line = start[at[f]] + (y0[f] + np.arange(len(f)) - np.repeat(np.cumsum(lines) - lines, lines)) * w[at[f]]
    np.add.at(steps, line + x0[f], 1)
    np.add.at(steps, line + x1[f], -1)
    on = np.cumsum(steps[:-1], dtype=np.int32) > 0
    for i in np.flatnonzero(~upright):
        k = of[i]
        on[start[k] : start[k + 1]] |= K.polygon((h[k], w[k]), np.array(corners[i].as_py(), float)).ravel() > 0
    return on


def _turned(x: float, y: float) -> float:
    """Degrees between two frames turned by x and y."""
    x, y = math.radians(x), math.radians(y)
    return math.degrees(math.acos(max(-1.0, min(1.0, abs(math.cos(x)) * abs(math.cos(y)) + math.sin(x) * math.sin(y)))))


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sample_id, height, width, gt and pred as those of frame_rows."""
    for batch in batches:
        if batch.column(1).null_count or batch.column(2).null_count:
            raise ValueError("a sample has no size")
        h, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        sides = [_frame_parts(batch.column(i)) for i in (3, 4)]
        ends, first = np.cumsum(h * w), [np.cumsum(n) - n for n, _, _ in sides]
        share, lo = np.ones(batch.num_rows), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIXELS, "right")))
            start, on = np.concatenate([[0], np.cumsum((h * w)[lo:hi])]), []
            for (n, _, corners), f in zip(sides, first):
                on.append(_rasters(corners.slice(f[lo], n[lo:hi].sum()), np.repeat(np.arange(hi - lo), n[lo:hi]), h[lo:hi], w[lo:hi], start))
            common, either = (np.diff(np.searchsorted(np.flatnonzero(x), start)) for x in (on[0] & on[1], on[0] | on[1]))
            np.divide(common, either, out=share[lo:hi], where=either > 0)
            lo = hi
        pairs = np.minimum(sides[0][0], sides[1][0])
        of = np.repeat(np.arange(batch.num_rows), pairs)
        place, angles = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs), np.empty(len(of), complex)
        angles.real, angles.imag = (a[f[of] + place] for (_, a, _), f in zip(sides, first))
        kinds, kind = np.unique(angles, return_inverse=True)
        wrong = np.array([_turned(z.real, z.imag) for z in kinds.tolist()], float)[kind]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share), pa.array(np.bincount(of, wrong, batch.num_rows).astype(float)), pa.array(pairs)], names=["sample_id", "jaccard", "angle_error", "n_angles"])


def frame_rows(both: DataFrame) -> DataFrame:
    """sample_id, jaccard of the rasterised frames gt and pred on height x width pixels, and the sum and number of angle errors (degrees) of frames in order."""
    return both.select(F.col("sample_id").cast("long"), "height", "width", "gt", "pred").mapInArrow(_frame_rows, "sample_id long, jaccard double, angle_error double, n_angles long")


def frame_scores(gt: DataFrame, pred: DataFrame, sizes: DataFrame) -> DataFrame:
    """frame_rows of two tables of sample_id and frames, with sizes of sample_id, height and width.

    Samples that agree on having no frame score 1; the mean angle error of a set is sum(angle_error) / sum(n_angles).
    """
    both = sizes.select("sample_id", "height", "width").join(gt.select("sample_id", F.col("frames").alias("gt")), "sample_id")
    return frame_rows(both.join(pred.select("sample_id", F.col("frames").alias("pred")), "sample_id", "left"))


def dataset(spark: SparkSession, path: str, database: str | None = None) -> dict[str, DataFrame]:
    """The tables of a folder: images, and what lies beside them of masks, clean images and ground truth."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        found = at.getFileSystem(conf).globStatus(at)
        return found is not None and len(found) > 0

    out = {"images": S.images(spark, path)}
    out |= {"masks": S.images(spark, path, "*.png")} if there("*.png") else {}
    out |= {"clean": S.images(spark, f"{path}/non_augmented")} if there("non_augmented/*.jpg") else {}
    for table, read in (("correspondences", S.correspondences), ("text_boxes", S.text_boxes)):
        name = "gt_corresps" if table == "correspondences" else table
        kind = next((k for k in ("json", "pkl") if there(f"{name}.{k}")), None)
        out |= {table: read(spark, f"{path}/{name}.{kind}")} if kind else {}
    return out | ({"database": S.images(spark, database), "annotations": S.annotations(spark, database)} if database else {})


def preloaded(data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Images and masks read and kept in memory or on disk before any task runs; clean images are not."""
    out = dict(data)
    for name in {"images", "masks"} & set(data):
        out[name] = data[name].persist()
        out[name].count()
    return out


def run(spark: SparkSession, tasks: list[Task], datasets: dict[str, dict[str, DataFrame]], out: str) -> list[str]:
    """Every task over each of its datasets: ``result`` and ``report`` in a folder of its own; gives the folders."""
    folders = []
    for task in tasks:
        name = uuid.uuid4().hex[:8]
        for at in task.datasets:
            folder = f"{out}/{task.name}_on_{at}_{name}"
            result, metrics = resolve("task", task.name)(task, datasets[at])
            result.write.parquet(f"{folder}/result")
            written = spark.read.parquet(f"{folder}/result")
            if task.name == "masking":
                S.mask_files(written, "mask").write.parquet(f"{folder}/masks")
            if task.name == "text_detection":
                S.mask_files(written, "text_mask", "crop_pos").write.parquet(f"{folder}/text_masks")
                S.transcriptions(written).write.parquet(f"{folder}/text_transcriptions")
            if task.name.startswith("retrieval"):
                for kind, first in (("result_w1", True), ("result_w2", False)):
                    S.predictions(written, 10, first).write.parquet(f"{folder}/{kind}")
                if (found := frames(task, datasets[at])) is not None:
                    found.write.parquet(f"{folder}/frames")
            if metrics is not None:
                S.write_report(metrics, {k: v for k, v in task.__dict__.items() if k != "held"}, f"{folder}/report")
            task.release()
            folders.append(folder)
    return folders


def main() -> None:
    ask = argparse.ArgumentParser()
    for flag, default in (("datasets_dir", "datasets"), ("retrieval_ds_dir", None), ("output_dir", "output"), ("config", None)):
        ask.add_argument(f"--{flag}", default=default)
    ask.add_argument("--num_workers", type=int, default=0, help="ignored: the cluster has the workers")
    for flag in ("inference_only", "preload"):
        ask.add_argument(f"--{flag}", action="store_true")
    args = ask.parse_args()
    spark = SparkSession.builder.getOrCreate()
    tasks = load("\n".join(r.value for r in spark.read.text(args.config).collect()))
    for task in tasks:
        task.inference_only |= args.inference_only
    names = {d for t in tasks for d in t.datasets}
    data = {d: dataset(spark, f"{args.datasets_dir}/{d}", args.retrieval_ds_dir) for d in names}
    run(spark, tasks, {d: preloaded(x) for d, x in data.items()} if args.preload else data, args.output_dir)


if __name__ == "__main__":
    main()

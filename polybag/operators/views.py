"""Augmented views of images.

A *plan* holds every random choice of a view as plain columns, drawn from a seeded hash of
(image, view), so a view is the same whenever and wherever it is computed.  Planning is pure
SQL expressions; :func:`render_views` carries a plan out on pixels, one Arrow batch at a time,
without a shuffle.

An image table has ``image_id``, ``height``, ``width`` and, for rendering, ``pixels``
(interleaved RGB as BINARY or ARRAY<INT>).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from polybag.functions import hash_uniform, pixels as px
from polybag.operators.skew import hashed_rank
from polybag.session import map_arrow, ship_package

VIEW_SEED = 286501567
SLOTS = 2
MAGNITUDE = 10
FRAME, CROP = 256, 224

# The active operations with the two ends of their range (fixed values).
AUGMENTATIONS = [
    ("AutoContrast", 0.0, 1.0),
    ("Equalize", 0.0, 1.0),
    ("Invert", 0.0, 1.0),
    ("Rotate", 0.0, 30.0),
    ("Posterize", 0.0, 4.0),
    ("Solarize", 0.0, 256.0),
    ("SolarizeAdd", 0.0, 110.0),
    ("Contrast", 0.1, 1.9),
    ("Sharpness", 0.1, 1.9),
    ("ShearX", 0.0, 0.3),
    ("ShearY", 0.0, 0.3),
    ("CutoutAbs", 0.0, 40.0),
    ("TranslateXabs", 0.0, 100.0),
    ("TranslateYabs", 0.0, 100.0),
    ("ToBLUR", 0.0, 1.0),
    ("ToCONTOUR", 0.0, 1.0),
    ("ToEMBOSS", 0.0, 1.0),
    ("ToEDGES", 0.0, 1.0),
]
# Operations whose magnitude changes sign half of the time (fixed values).
SIGNED = ["ShearX", "ShearY", "TranslateX", "TranslateXabs", "TranslateY", "TranslateYabs",
          "Rotate"]
# View recipes: the random steps each one takes (fixed values).
RECIPES = {
    "basic1": {"crop", "jitter", "gray", "flip"},
    "basic2": {"crop", "jitter", "gray", "flip"},
    "aux": {"crop", "flip", "augment"},
    "train": {"crop"},
    "eval": set(),
}
PRETRAIN_VIEWS = ("basic1", "basic2", "aux")
CROP_SCALE = (0.2, 1.0)
CROP_RATIO = (3.0 / 4.0, 4.0 / 3.0)
JITTER = 0.4
GRAY_CHANCE = 0.2
FLIP_CHANCE = 0.5


def magnitude_of(m: float, low: float, high: float) -> float:
    """Linear map of the 0..30 strength scale to an operation's range."""
    return m / 30.0 * (high - low) + low


def _names(views: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in views]))


def augmentation_plan(images: DataFrame, views: Sequence[str] = ("aux",), n: int = SLOTS,
                      m: float = MAGNITUDE, key: str = "image_id",
                      seed: int = VIEW_SEED) -> DataFrame:
    """(image, view, slot, op, magnitude, sign): ``n`` operations drawn with replacement."""
    table = F.array(*[
        F.struct(F.lit(name).alias("op"), F.lit(magnitude_of(m, low, high)).alias("magnitude"))
        for name, low, high in AUGMENTATIONS])
    slots = images.select(key, _names(views).alias("view")).select(
        key, "view", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))

    def draw(name: str) -> Column:
        return hash_uniform(seed, F.col(key), F.col("view"), F.col("slot"), name)

    pick = F.floor(draw("op") * len(AUGMENTATIONS)).cast("int")
    chosen = slots.withColumn("_e", F.element_at(table, pick + 1))
    negative = F.col("_e.op").isin(SIGNED) & (draw("sign") > 0.5)
    return chosen.select(
        key, "view", "slot", F.col("_e.op").alias("op"),
        F.col("_e.magnitude").alias("magnitude"),
        F.when(negative, -1).otherwise(1).alias("sign"))


def with_choices(images: DataFrame, views: Sequence[str], key: str = "image_id",
                 seed: int = VIEW_SEED) -> DataFrame:
    """Add ``plan_<view>``, the recipe choices of each view as a struct.

    Built in steps, so that a draw used twice (the box area) is computed once per row.
    """
    def draw(view: str, name: str) -> Column:
        return hash_uniform(seed, F.col(key), view, name)

    def between(view: str, name: str, low: float, high: float) -> Column:
        return draw(view, name) * (high - low) + low

    def framed(edge: str) -> Column:
        return F.floor(F.col(edge) * FRAME / F.least("height", "width")).cast("int")

    def side(area: Column, edge: str) -> Column:
        return F.greatest(
            F.least(F.floor(F.sqrt(area) + 0.5).cast("int"), F.col(edge)), F.lit(1))

    def plan(view: str) -> Column:
        steps = RECIPES[view]
        width, height, x, y = F.col("_frame_w"), F.col("_frame_h"), F.lit(0), F.lit(0)
        if "crop" in steps:
            width, height = F.col(f"_w_{view}"), F.col(f"_h_{view}")
            x = F.floor(draw(view, "x") * (F.col("_frame_w") - width + 1)).cast("int")
            y = F.floor(draw(view, "y") * (F.col("_frame_h") - height + 1)).cast("int")

        def factor(name: str) -> Column:
            return (between(view, name, 1 - JITTER, 1 + JITTER) if "jitter" in steps
                    else F.lit(1.0))

        def chance(step: str, p: float) -> Column:
            return (draw(view, step) < p).cast("int") if step in steps else F.lit(0)

        fields = {
            "frame_h": F.col("_frame_h"), "frame_w": F.col("_frame_w"), "box_x": x, "box_y": y,
            "box_w": width, "box_h": height, "brightness": factor("brightness"),
            "contrast": factor("contrast"), "saturation": factor("saturation"),
            "hue": between(view, "hue", -JITTER, JITTER) if "jitter" in steps else F.lit(0.0),
            "gray": chance("gray", GRAY_CHANCE), "flip": chance("flip", FLIP_CHANCE),
        }
        return F.struct(F.lit(view).alias("view"), *[c.alias(n) for n, c in fields.items()])

    crops = [v for v in views if "crop" in RECIPES[v]]
    log_ratio = [float(np.log(r)) for r in CROP_RATIO]
    framed_images = images.withColumns({"_frame_h": framed("height"), "_frame_w": framed("width")})
    drawn = framed_images.withColumns({
        **{f"_area_{v}": between(v, "area", *CROP_SCALE) * F.col("_frame_h") * F.col("_frame_w")
           for v in crops},
        **{f"_ratio_{v}": F.exp(between(v, "ratio", *log_ratio)) for v in crops}})
    boxed = drawn.withColumns({
        **{f"_w_{v}": side(F.col(f"_area_{v}") * F.col(f"_ratio_{v}"), "_frame_w") for v in crops},
        **{f"_h_{v}": side(F.col(f"_area_{v}") / F.col(f"_ratio_{v}"), "_frame_h") for v in crops}})
    return boxed.withColumns({f"plan_{v}": plan(v) for v in views}).select(
        *images.columns, *[f"plan_{v}" for v in views])


def view_plan(images: DataFrame, views: Sequence[str] = PRETRAIN_VIEWS, key: str = "image_id",
              seed: int = VIEW_SEED) -> DataFrame:
    """The recipe choices of each image and view.

    The shorter edge is brought to 256 and a box of random area and shape is cut from it (one
    draw, kept inside the frame); jitter factors are 1 and flags 0 where a recipe lacks the step.
    Without a crop step the whole image is the box.
    """
    plans = F.array(*[F.col(f"plan_{v}") for v in views])
    return with_choices(images, views, key, seed).select(
        key, F.explode(plans).alias("_p")).select(key, "_p.*")


# ---------------------------------------------------------------- rendering

def _stack(column: pa.Array, rows: np.ndarray, h: int, w: int) -> np.ndarray:
    """The chosen images as one ``[n, h, w, 3]`` array."""
    taken = column.take(pa.array(rows))
    if pa.types.is_list(taken.type):
        flat = taken.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
    else:
        flat = np.frombuffer(b"".join(taken.to_pylist()), dtype=np.uint8)
    return flat.reshape(len(rows), h, w, 3)


def _apply(stack: np.ndarray, names: np.ndarray, v: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """One slot: every image through its own operation, one kernel call per operation."""
    out = stack.copy()
    for name in np.unique(names):
        at = names == name
        out[at] = px.KERNELS[name](stack[at], v[at], draws[at])
    return out


def _jitter(stack: np.ndarray, plan: dict[str, np.ndarray]) -> np.ndarray:
    stack = px.brightness(stack, plan["brightness"])
    stack = px.contrast(stack, plan["contrast"])
    stack = px.color(stack, plan["saturation"])
    turned = plan["hue"] != 0
    if turned.any():
        stack = stack.copy()
        stack[turned] = px.shift_hue(stack[turned], plan["hue"][turned])
    return stack


def _chunks(batch: pa.RecordBatch, rows: int = 256) -> Iterable[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sizes(batch: pa.RecordBatch) -> Iterable[tuple[int, int, np.ndarray]]:
    """Row numbers by image size (usually one)."""
    size = np.stack([_column(batch, c).to_numpy(zero_copy_only=False)
                     for c in ("height", "width")], axis=1)
    for h, w in np.unique(size, axis=0):
        yield int(h), int(w), np.nonzero((size == (h, w)).all(axis=1))[0]


def _cells(values: np.ndarray) -> pa.Array:
    """One entry per image: bytes for pixels, a list for tensors."""
    flat = values.reshape(len(values), -1)
    if flat.dtype == np.uint8:
        return pa.array([row.tobytes() for row in flat], type=pa.binary())
    offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))


def _operations(plans: pa.Array, rows: int) -> list[tuple[np.ndarray, ...]]:
    """Per slot: names, magnitudes and draws, from an array column of operation structs."""
    ops = plans.flatten()
    name, magnitude, u, v = (
        ops.field(f).to_numpy(zero_copy_only=False).reshape(rows, -1)
        for f in ("op", "magnitude", "u", "v"))
    return [(name[:, i], magnitude[:, i], np.stack([u[:, i], v[:, i]], axis=1))
            for i in range(name.shape[1])]


def _emit(batch: pa.RecordBatch, rows: np.ndarray, key: str, view: str,
          values: np.ndarray) -> pa.RecordBatch:
    ids = _column(batch, key).take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [ids, pa.repeat(pa.scalar(view), len(rows)), _cells(values)],
        names=[key, "view", "values"])


def _apply_plans(images: DataFrame, plans: dict[str, Column], key: str, as_levels: bool) -> DataFrame:
    """Run the planned operations of each view; pixels cross to Python once for all views."""
    names = list(plans)
    cells, cell = ("array<int>", np.int32) if as_levels else ("binary", np.uint8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (c for b in batches for c in _chunks(b)):
            for h, w, rows in _sizes(batch):
                stack = _stack(_column(batch, "pixels"), rows, h, w)
                for i, view in enumerate(names):
                    out = stack
                    planned = _column(batch, f"ops{i}").take(pa.array(rows))
                    for slot in _operations(planned, len(rows)):
                        out = _apply(out, *slot)
                    yield _emit(batch, rows, key, view, out.astype(np.uint8).astype(cell))

    kind = images.schema[key].dataType.simpleString()
    planned = images.select(key, "height", "width", "pixels", *[
        c.alias(f"ops{i}") for i, c in enumerate(plans.values())])
    return map_arrow(planned, run, f"`{key}` {kind}, view string, `values` {cells}"
                     ).withColumnRenamed("values", "pixels")


def planned_operations(view: str, key: str = "image_id", n: int = SLOTS, m: float = MAGNITUDE,
                       seed: int = VIEW_SEED) -> Column:
    """The plan of :func:`augmentation_plan` for one view, as an array column."""
    table = F.array(*[
        F.struct(F.lit(name).alias("op"), F.lit(magnitude_of(m, low, high)).alias("magnitude"),
                 F.lit(name in SIGNED).alias("signed"))
        for name, low, high in AUGMENTATIONS])

    def slot(i: int) -> Column:
        def draw(name: str) -> Column:
            return hash_uniform(seed, F.col(key), view, i, name)

        entry = F.element_at(table, F.floor(draw("op") * len(AUGMENTATIONS)).cast("int") + 1)
        sign = F.when(entry["signed"] & (draw("sign") > 0.5), -1.0).otherwise(1.0)
        return F.struct(
            entry["op"].alias("op"), (entry["magnitude"] * sign).alias("magnitude"),
            draw("u").alias("u"), draw("v").alias("v"))

    return F.array(*[slot(i) for i in range(n)])


def augment_views(images: DataFrame, views: Sequence[str] = ("aux",), n: int = SLOTS,
                  m: float = MAGNITUDE, key: str = "image_id",
                  seed: int = VIEW_SEED, as_levels: bool = False) -> DataFrame:
    """Apply the augmentation plan: one row per image and view with its new pixels.

    ``as_levels`` gives them as ARRAY<INT>, as ``with_levels`` would with Python workers of its own.
    """
    return _apply_plans(
        images, {v: planned_operations(v, key, n, m, seed) for v in views}, key, as_levels)


def apply_kernels(images: DataFrame, kernels: Sequence[tuple[str, float]],
                  key: str = "image_id", as_levels: bool = False) -> DataFrame:
    """Each image through each named operation at a fixed magnitude (``view`` = its name)."""
    plans = {
        name: F.array(F.struct(
            F.lit(name).alias("op"), F.lit(float(v)).alias("magnitude"),
            hash_uniform(VIEW_SEED, F.col(key), name, 0, "u").alias("u"),
            hash_uniform(VIEW_SEED, F.col(key), name, 0, "v").alias("v")))
        for name, v in kernels}
    return _apply_plans(images, plans, key, as_levels)


def _render(stack: np.ndarray, view: str, plan: pa.StructArray, ops: pa.Array | None,
            size: int) -> np.ndarray:
    """One view of a stack of images, by its recipe."""
    steps = RECIPES[view]
    p = {f.name: plan.field(f.name).to_numpy(zero_copy_only=False)
         for f in plan.type if f.name != "view"}
    box = np.stack([p["box_x"], p["box_y"], p["box_w"], p["box_h"]], 1).astype(float)
    frame = np.stack([p["frame_h"], p["frame_w"]], 1).astype(float)
    out = px.crop_resize(stack, box, frame, size)
    flipped, grey = p["flip"] == 1, p["gray"] == 1
    out[flipped] = px.flip(out[flipped])
    if ops is not None:
        for slot in _operations(ops, len(out)):
            out = _apply(out, *slot)
    if "jitter" in steps:
        out = _jitter(out, p)
    out[grey] = px.luma(out[grey])
    return out


def render_views(images: DataFrame, views: Sequence[str] = PRETRAIN_VIEWS,
                 key: str = "image_id", size: int = CROP, seed: int = VIEW_SEED,
                 tensor: bool = True) -> DataFrame:
    """Carry out the recipes: ``payload`` is the normalised tensor, or plain pixels.

    Order of steps: frame and crop, flip, planned operations or colour jitter, grey, tensor.
    The plans are columns of the image's own row, so pixels are neither joined nor shuffled,
    and they cross to Python once for all views.
    """
    augmented = [v for v in views if "augment" in RECIPES[v]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (c for b in batches for c in _chunks(b, 64)):
            for h, w, rows in _sizes(batch):
                stack, at = _stack(_column(batch, "pixels"), rows, h, w), pa.array(rows)
                for view in views:
                    ops = _column(batch, f"ops_{view}").take(at) if view in augmented else None
                    out = _render(stack, view, _column(batch, f"plan_{view}").take(at), ops, size)
                    yield _emit(batch, rows, key, view,
                                px.to_tensor(out) if tensor else out.astype(np.uint8))

    kind = images.schema[key].dataType.simpleString()
    cells = "array<float>" if tensor else "binary"
    chosen = with_choices(images.select(key, "height", "width", "pixels"), views, key, seed)
    planned = chosen.select(
        "*", *[planned_operations(v, key, seed=seed).alias(f"ops_{v}") for v in augmented])
    return map_arrow(planned, run, f"`{key}` {kind}, view string, `values` {cells}"
                     ).withColumnRenamed("values", "payload")


# ---------------------------------------------------------------- whole-image statistics

def _to_levels(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: None if p is None else np.frombuffer(p, dtype=np.uint8).astype(np.int32))


_to_levels.__annotations__ = {"pixels": pd.Series, "return": pd.Series}


def levels(images: DataFrame, pixels: str = "pixels") -> Column:
    """The levels of an image as ARRAY<INT>, from either form of pixels."""
    if isinstance(images.schema[pixels].dataType, BinaryType):
        return F.pandas_udf(_to_levels, "array<int>")(F.col(pixels))
    return F.col(pixels)


def with_levels(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Images with ``pixels`` as ARRAY<INT>, whichever form they came in."""
    ship_package(images.sparkSession)
    return images.withColumn(pixels, levels(images, pixels))


def _to_bytes(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: None if p is None else np.asarray(p, dtype=np.uint8).tobytes())


_to_bytes.__annotations__ = {"pixels": pd.Series, "return": pd.Series}


def with_bytes(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Images with ``pixels`` as BINARY, whichever form they came in."""
    if isinstance(images.schema[pixels].dataType, BinaryType):
        return images
    ship_package(images.sparkSession)
    return images.withColumn(pixels, F.pandas_udf(_to_bytes, "binary")(F.col(pixels)))


def normalize_pixels(images: DataFrame, out: str = "tensor") -> DataFrame:
    """Scaled and normalised pixels, interleaved order kept; array pixels don't leave the JVM."""
    mean = F.array(*[F.lit(v) for v in px.CHANNEL_MEAN])
    std = F.array(*[F.lit(v) for v in px.CHANNEL_STD])
    return with_levels(images).withColumn(out, F.transform(
        "pixels", lambda v, i: (v / F.lit(255.0) - mean[i % 3]) / std[i % 3]))


def channel_means(images: DataFrame, key: str = "image_id", channels: int = 3) -> DataFrame:
    """Mean of each channel of each image, inside the row."""
    def mean(c: int) -> Column:
        values = F.filter("pixels", lambda _, i: i % channels == c)
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v)
        return F.try_divide(total.cast("double"), F.size(values))

    entries = F.array(*[
        F.struct(F.lit(c).alias("channel"), mean(c).alias("mean")) for c in range(channels)])
    return with_levels(images.select(key, "pixels")).select(key, F.explode(entries).alias("_m")).select(
        key, "_m.channel", "_m.mean")


def sample_pairing(images: DataFrame, v: float, key: str = "image_id",
                   seed: int = VIEW_SEED) -> DataFrame:
    """Blend each image with a partner drawn from all images: ``a + v (b - a)``, cut to whole.

    Ids alone are numbered in hash order and paired by a draw of the partner's number; then one
    equi-join each fetches the two images' pixels.  Draws are spread evenly, so no partner is hot.
    """
    numbered = hashed_rank(images.select(key), key, rank="_r", total="_n", seed=seed)
    drawn = numbered.withColumn(
        "_partner", F.floor(hash_uniform(seed, F.col(key), "pair") * F.col("_n")))
    pairs = drawn.join(numbered.select(
        F.col("_r").alias("_partner"), F.col(key).alias("partner_id")), "_partner").select(key, "partner_id")
    pixels = with_levels(images.select(key, "pixels"))
    other = pixels.select(F.col(key).alias("partner_id"), F.col("pixels").alias("_other"))
    mixed = F.zip_with("pixels", "_other",
                       lambda a, b: (a + F.lit(float(v)) * (b - a)).cast("int"))
    return pairs.join(other, "partner_id").join(pixels, key).select(
        key, "partner_id", mixed.alias("pixels"))

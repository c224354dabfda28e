"""Pixel kernels, view plans, and images read from disk."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polybag.functions import pixels as px
from polybag.operators import views
from polybag.sources.images import (
    decode_images, image_ids, scan_images, undecodable_images, write_bitmaps)


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(1).integers(0, 256, (3, 20, 17, 3), dtype=np.uint8)


def _v(value, n=3):
    return np.full(n, float(value))


# ---------------------------------------------------------------- kernels

def test_pointwise(stack):
    assert (px.invert(stack) == 255 - stack).all()
    assert (px.solarize(stack, _v(85.3)) == np.where(stack < 85.3, stack, 255 - stack)).all()
    added = np.minimum(stack.astype(int) + 36, 255)
    assert (px.solarize_add(stack, _v(36.667)) == np.where(added < 128, added, 255 - added)).all()
    assert (px.posterize(stack, _v(4 / 3)) == (stack & 128)).all()
    assert (px.posterize(stack, _v(4)) == (stack & 0xF0)).all()
    assert (px.identity(stack) == stack).all()


@pytest.mark.parametrize("kernel", [px.brightness, px.color, px.contrast, px.sharpness])
def test_enhancers_keep_the_image_at_one(stack, kernel):
    assert (kernel(stack, _v(1.0)) == stack).all()


def test_enhancers_at_zero(stack):
    assert (px.brightness(stack, _v(0)) == 0).all()
    assert (px.color(stack, _v(0)) == px.luma(stack)).all()
    flat = px.contrast(stack, _v(0))
    assert all(len(np.unique(image)) == 1 for image in flat)


def _equalize_loop(channel):
    counts = np.bincount(channel.ravel(), minlength=256).tolist()
    present = [c for c in counts if c]
    step = (sum(present) - present[-1]) // 255 if len(present) > 1 else 0
    if not step:
        return channel
    table, running = [], step // 2
    for c in counts:
        table.append(min(running // step, 255))
        running += c
    return np.array(table)[channel]


def test_lookup_tables():
    rng = np.random.default_rng(2)
    images = np.clip(rng.normal(120, 25, (4, 40, 40, 3)), 0, 255).astype(np.uint8)
    images[1] = 7
    images[2, :, :, 0] //= 64
    out = px.equalize(images)
    for n in range(4):
        for c in range(3):
            assert (out[n, :, :, c] == _equalize_loop(images[n, :, :, c])).all()
    stretched = px.autocontrast(images)
    assert (stretched[1] == images[1]).all()
    for c in range(3):
        assert stretched[0, :, :, c].min() == 0 and stretched[0, :, :, c].max() >= 254


@pytest.mark.parametrize("name", list(px.FILTERS))
def test_filters_against_a_loop(stack, name):
    kernel, divisor, offset = px.FILTERS[name]
    r = len(kernel) // 2
    out = px.convolve(stack, name)
    for y, x, c in [(r, r, 0), (9, 8, 1), (19 - r, 16 - r, 2), (0, 3, 0), (19, 0, 1)]:
        if r <= y < 20 - r and r <= x < 17 - r:
            total = sum(kernel[j][i] * int(stack[0, y + j - r, x + i - r, c])
                        for j in range(2 * r + 1) for i in range(2 * r + 1))
            expected = min(255, max(0, math.floor(total / divisor + offset + 0.5)))
        else:
            expected = stack[0, y, x, c]
        assert out[0, y, x, c] == expected


def test_geometry(stack):
    assert (px.translate_x_abs(stack, _v(3))[:, :, :-3] == stack[:, :, 3:]).all()
    assert (px.translate_x_abs(stack, _v(3))[:, :, -3:] == 0).all()
    assert (px.translate_y_abs(stack, _v(-4))[:, 4:] == stack[:, :-4]).all()
    assert (px.translate_y(stack, _v(0.2)) == px.translate_y_abs(stack, _v(4))).all()
    assert (px.flip(px.flip(stack)) == stack).all()
    assert (px.shear_x(stack, _v(0)) == stack).all()
    assert (px.rotate(stack, _v(180)) == stack[:, ::-1, ::-1]).all()
    square = stack[:, :17]
    assert (px.rotate(square, _v(90)) == np.rot90(square, axes=(1, 2))).all()


def test_cutout(stack):
    draws = np.array([[0.5, 0.5], [0.0, 0.0], [0.99, 0.99]])
    out = px.cutout_abs(stack, _v(6), draws)
    changed = (out != stack).any(-1)
    assert (out[changed] == px.CUTOUT_COLOR).all()
    assert changed[0].sum() <= 49 and changed[0, 10, 8]
    assert (px.cutout(stack, _v(0), draws) == stack).all()


def test_hue_turns_and_returns(stack):
    assert (px.shift_hue(stack, _v(0)) == stack).all()
    red = np.zeros((1, 1, 1, 3), np.uint8)
    red[..., 0] = 200
    assert px.shift_hue(red, _v(1 / 3, 1)).ravel().tolist() == [0, 200, 0]


def test_crop_and_resize():
    image = np.arange(16, dtype=np.uint8).reshape(1, 4, 4, 1).repeat(3, -1)
    whole = np.array([[0.0, 0, 4, 4]])
    frame = np.array([[4.0, 4]])
    assert (px.crop_resize(image, whole, frame, 4) == image).all()
    corner = px.crop_resize(image, np.array([[2.0, 2, 2, 2]]), frame, 2)
    assert (corner == image[:, 2:, 2:]).all()


def test_tensor_layout(stack):
    tensor = px.to_tensor(stack)
    assert tensor.shape == (3, 3, 20, 17) and tensor.dtype == np.float32
    expected = (stack[0, 4, 5, 1] / 255 - px.CHANNEL_MEAN[1]) / px.CHANNEL_STD[1]
    assert tensor[0, 1, 4, 5] == pytest.approx(expected, rel=1e-6)


# ---------------------------------------------------------------- plans

@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.range(2000).selectExpr(
        "id AS image_id", "512 AS height", "cast(512 + (id % 3) * 64 AS int) AS width")


def test_magnitudes_of_strength_ten():
    found = {n: views.magnitude_of(10, lo, hi) for n, lo, hi in views.AUGMENTATIONS}
    expected = {"Rotate": 10, "Posterize": 4 / 3, "Solarize": 256 / 3, "SolarizeAdd": 110 / 3,
                "Contrast": 0.7, "Sharpness": 0.7, "ShearX": 0.1, "ShearY": 0.1,
                "CutoutAbs": 40 / 3, "TranslateXabs": 100 / 3, "TranslateYabs": 100 / 3}
    for name, value in expected.items():
        assert found[name] == pytest.approx(value)
    assert len(found) == 18 and set(found) <= set(px.KERNELS)


def test_plan_is_even_and_repeatable(catalogue):
    plan = views.augmentation_plan(catalogue)
    rows = plan.collect()
    assert sorted(rows) == sorted(views.augmentation_plan(catalogue.repartition(7)).collect())
    assert len(rows) == 4000
    counts = {r["op"]: r["count"] for r in plan.groupBy("op").count().collect()}
    assert len(counts) == 18 and all(150 < c < 300 for c in counts.values())
    signed = [r.sign for r in rows if r.op in views.SIGNED]
    assert 0.4 < signed.count(-1) / len(signed) < 0.6
    assert all(r.sign == 1 for r in rows if r.op not in views.SIGNED)


def test_view_plan_stays_inside_the_frame(catalogue):
    plan = views.view_plan(catalogue, ("basic1", "basic2", "aux", "eval", "train"))
    rows = plan.collect()
    assert all(r.box_x >= 0 and r.box_x + r.box_w <= r.frame_w and r.box_y >= 0
               and r.box_y + r.box_h <= r.frame_h for r in rows)
    for r in rows:
        if r.view == "eval":
            assert (r.box_w, r.box_h, r.flip, r.brightness) == (r.frame_w, 256, 0, 1.0)
        if not r.view.startswith("basic"):
            assert r.gray == 0 and r.hue == 0.0
    basic = [r for r in rows if r.view == "basic1"]
    assert 0.15 < sum(r.gray for r in basic) / len(basic) < 0.25
    assert any((a.box_x, a.flip) != (b.box_x, b.flip) for a, b in zip(
        basic, [r for r in rows if r.view == "basic2"]))


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 12, 10 + 2 * (i % 2), bytearray(rng.integers(
        0, 256, 12 * (10 + 2 * (i % 2)) * 3, dtype=np.uint8).tobytes())) for i in range(40)]
    return spark.createDataFrame(
        rows, "image_id bigint, height int, width int, pixels binary").repartition(4)


def test_augmented_pixels_follow_the_plan(pictures):
    done = {r.image_id: r.pixels for r in views.augment_views(pictures).collect()}
    plan = {}
    for r in views.augmentation_plan(pictures).collect():
        plan.setdefault(r.image_id, {})[r.slot] = (r.op, r.magnitude * r.sign)
    checked = 0
    for r in pictures.collect():
        ops = [plan[r.image_id][s] for s in (0, 1)]
        if any(name == "CutoutAbs" for name, _ in ops):
            continue
        image = np.frombuffer(bytes(r.pixels), np.uint8).reshape(1, r.height, r.width, 3)
        for name, v in ops:
            image = px.KERNELS[name](image, np.array([v]), np.zeros((1, 2)))
        assert image.tobytes() == bytes(done[r.image_id])
        checked += 1
    assert checked > 20


def test_rendered_views(pictures):
    done = views.render_views(pictures, size=8).collect()
    assert len(done) == 120 and {len(r.payload) for r in done} == {192}
    raw = views.render_views(pictures, ("eval",), size=8, tensor=False).collect()
    assert all(len(bytes(r.payload)) == 192 for r in raw)
    again = {(r.image_id, r.view): r.payload for r in views.render_views(
        pictures.repartition(3), size=8).collect()}
    assert all(again[(r.image_id, r.view)] == r.payload for r in done)


def test_whole_image_statistics(spark):
    images = spark.createDataFrame([(1, [0, 100, 255, 10, 120, 245])], "image_id bigint, pixels array<int>")
    means = {r.channel: r.mean for r in views.channel_means(images).collect()}
    assert means == {0: 5.0, 1: 110.0, 2: 250.0}
    tensor = views.normalize_pixels(images).first().tensor
    assert tensor[4] == pytest.approx((120 / 255 - px.CHANNEL_MEAN[1]) / px.CHANNEL_STD[1])


def test_sample_pairing(spark):
    images = spark.range(200).selectExpr(
        "id AS image_id", "array(cast(id AS int), cast(255 - id AS int)) AS pixels")
    rows = views.sample_pairing(images, 0.4).collect()
    assert len(rows) == 200 and len({r.partner_id for r in rows}) > 90
    for r in rows:
        a, b = r.image_id, r.partner_id
        expected = [a + 0.4 * (b - a), (255 - a) + 0.4 * (a - b)]
        assert all(abs(p - e) < 1 for p, e in zip(r.pixels, expected))


def test_both_forms_of_pixels_give_the_same(spark, pictures):
    arrays = views.with_levels(pictures)
    assert arrays.first().pixels == list(bytes(pictures.where(f"image_id = {arrays.first().image_id}").first().pixels))
    assert views.with_bytes(arrays).orderBy("image_id").collect() == pictures.orderBy("image_id").collect()
    for operator in (views.normalize_pixels, views.channel_means, lambda d: views.sample_pairing(d, 0.3)):
        ours, theirs = (sorted(map(tuple, operator(d).drop("pixels").collect()), key=str)
                        for d in (pictures, arrays))
        assert ours == theirs
    ours, theirs = (sorted(map(tuple, views.sample_pairing(d, 0.3).collect())) for d in (pictures, arrays))
    assert ours == theirs


# ---------------------------------------------------------------- files

def _png(pixels):
    h, w, c = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)

    def chunk(kind, data):
        return (struct.pack(">I", len(data)) + kind + data
                + struct.pack(">I", zlib.crc32(kind + data)))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head)
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_from_directories(spark, tmp_path):
    rng = np.random.default_rng(9)
    truth = {}
    for sid, c in (("g1", 3), ("g1", 3), ("g2", 3), ("g3", 1), ("g4", 4)):
        folder = tmp_path / sid
        folder.mkdir(exist_ok=True)
        pixels = rng.integers(0, 256, (6, 5, c), dtype=np.uint8)
        if c == 4:
            pixels[..., 3] = 255
        name = folder / f"{len(truth)}.png"
        name.write_bytes(_png(pixels))
        truth[f"{sid}/{name.name}"] = pixels
    (tmp_path / "g2" / "broken.png").write_bytes(b"not an image")
    (tmp_path / "g2" / "notes.txt").write_text("ignored")
    listed = scan_images(spark, str(tmp_path), "*.png")
    assert {r.sid: r["count"] for r in listed.groupBy("sid").count().collect()} == {
        "g1": 2, "g2": 2, "g3": 1, "g4": 1}
    decoded = decode_images(spark, str(tmp_path), "*.png")
    rows = decoded.collect()
    assert len(rows) == 5
    bad = undecodable_images(spark, str(tmp_path), "*.png").collect()
    assert [(r.sid, r.path.split("/")[-1]) for r in bad] == [("g2", "broken.png")]
    write_bitmaps(decoded.select("sid", F.element_at(F.split("path", "/"), -1).alias("name"),
                                 "height", "width", "pixels"), str(tmp_path / "again"))
    again = decode_images(spark, str(tmp_path / "again"), "*")
    assert sorted((r.sid, bytes(r.pixels)) for r in again.collect()) == sorted(
        (r.sid, bytes(r.pixels)) for r in rows)
    for r in rows:
        pixels = truth["/".join(r.path.split("/")[-2:])]
        expected = pixels.repeat(3, -1) if pixels.shape[2] == 1 else pixels[..., :3]
        assert (r.height, r.width) == (6, 5) and r.sid == r.path.split("/")[-2]
        assert bytes(r.pixels) == expected.tobytes()
    rendered = views.render_views(image_ids(decoded), size=4)
    assert rendered.count() == 15
    assert rendered.select(F.size("payload")).distinct().collect()[0][0] == 48


def test_levels_come_from_the_workers_of_the_kernels(spark):
    """As with_levels gives them, by one Python worker for a task instead of two."""
    images = spark.createDataFrame([(i, 6, 7, [(i * 31 + k * 7) % 256 for k in range(126)]) for i in range(300)],
                                   "image_id bigint, height int, width int, pixels array<int>")
    kernels = [("ToBLUR", 0.0), ("Sharpness", 0.5)]
    done = views.apply_kernels(images, kernels, as_levels=True)
    assert dict(done.dtypes)["pixels"] == "array<int>"
    assert "EvalPython" not in done._jdf.queryExecution().executedPlan().toString()
    plain = views.with_levels(views.apply_kernels(images, kernels))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, plain.collect()))
    seen = views.augment_views(images, ("aux",), as_levels=True)
    assert sorted(map(tuple, seen.collect())) == sorted(
        map(tuple, views.with_levels(views.augment_views(images, ("aux",))).collect()))

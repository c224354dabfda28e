"""Pixel kernels on stacks of equally sized images, ``uint8 [n, height, width, 3]``.

Each kernel takes the stack, one magnitude per image and two draws per image (only the
rectangle fill uses those), so the images of an Arrow batch that share an operation are
handled by the same few NumPy calls.  Resampling is nearest neighbour.
"""

from __future__ import annotations

import numpy as np

# Channel statistics, fill colour, luma weights (16-bit), filter kernels.
CHANNEL_MEAN = (0.4914, 0.4822, 0.4465)
CHANNEL_STD = (0.2023, 0.1994, 0.2010)
CUTOUT_COLOR = (125, 123, 114)
LUMA = (19595, 38470, 7471)
SOLARIZE_ADD_THRESHOLD = 128
FILTERS = {
    # name: (kernel rows, divisor, offset)
    "blur": ([[1, 1, 1, 1, 1],
              [1, 0, 0, 0, 1],
              [1, 0, 0, 0, 1],
              [1, 0, 0, 0, 1],
              [1, 1, 1, 1, 1]], 16, 0),
    "contour": ([[-1, -1, -1],
                 [-1, 8, -1],
                 [-1, -1, -1]], 1, 255),
    "emboss": ([[0, 0, 0],
                [0, 1, 0],
                [-1, 0, 0]], 1, 128),
    "edges": ([[-1, -1, -1],
               [-1, 8, -1],
               [-1, -1, -1]], 1, 0),
    "smooth": ([[1, 1, 1],
                [1, 5, 1],
                [1, 1, 1]], 13, 0),
}


def _per_image(v: np.ndarray) -> np.ndarray:
    return np.asarray(v, dtype=np.float64).reshape(-1, 1, 1, 1)


def _to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def luma(images: np.ndarray) -> np.ndarray:
    """Grey value of each pixel, ``[n, h, w, 1]``."""
    weighted = images.astype(np.int64) @ np.array(LUMA)
    return ((weighted + 0x8000) >> 16).astype(np.uint8)[..., None]


def blend(base: np.ndarray, images: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``base + v (image - base)``, fraction cut off, kept in 0..255."""
    base = base.astype(np.float64)
    return _to_bytes(base + _per_image(v) * (images.astype(np.float64) - base))


def _lookup(images: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Map each channel through its own table ``[n, 3, 256]``."""
    n, c = np.arange(images.shape[0])[:, None, None, None], np.arange(3)
    return table[n, c, images]


# ---------------------------------------------------------------- pointwise

def invert(images, v=None, draws=None):
    return 255 - images


def solarize(images, v, draws=None):
    return np.where(images < _per_image(v), images, 255 - images).astype(np.uint8)


def solarize_add(images, v, draws=None):
    brighter = _to_bytes(images + _per_image(v))
    return solarize(brighter, np.full(len(images), SOLARIZE_ADD_THRESHOLD))


def posterize(images, v, draws=None):
    bits = np.asarray(v, dtype=np.float64).astype(np.int64).reshape(-1, 1, 1, 1)
    return (images & (0xFF ^ ((1 << (8 - bits)) - 1))).astype(np.uint8)


def brightness(images, v, draws=None):
    return blend(np.zeros_like(images), images, v)


def color(images, v, draws=None):
    return blend(np.broadcast_to(luma(images), images.shape), images, v)


def contrast(images, v, draws=None):
    mean = np.floor(luma(images).mean(axis=(1, 2, 3)) + 0.5)
    return blend(np.broadcast_to(_per_image(mean), images.shape), images, v)


def identity(images, v=None, draws=None):
    return images


# ---------------------------------------------------------------- lookup tables per channel

def autocontrast(images, v=None, draws=None):
    """Stretch each channel to 0..255; a flat channel stays as it is."""
    low = images.min(axis=(1, 2)).astype(np.float64)[..., None]
    high = images.max(axis=(1, 2)).astype(np.float64)[..., None]
    level = np.arange(256, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 255.0 / (high - low)
        stretched = np.trunc(level * scale - low * scale)
    table = np.where(high > low, np.clip(stretched, 0, 255), level)
    return _lookup(images, table.astype(np.uint8))


def equalize(images, v=None, draws=None):
    """Flatten each channel's histogram; too few pixels or levels leave it as it is."""
    n = images.shape[0]
    owner = (np.arange(n)[:, None, None, None] * 3 + np.arange(3)) * 256
    counts = np.bincount((owner + images).ravel(), minlength=n * 768).reshape(n, 3, 256)
    last = np.take_along_axis(
        counts, (255 - (counts[..., ::-1] > 0).argmax(-1))[..., None], -1)
    step = (counts.sum(-1, keepdims=True) - last) // 255
    before = np.cumsum(counts, -1) - counts
    with np.errstate(divide="ignore"):
        flat = (before + step // 2) // np.maximum(step, 1)
    usable = (step > 0) & ((counts > 0).sum(-1, keepdims=True) > 1)
    table = np.where(usable, np.clip(flat, 0, 255), np.arange(256))
    return _lookup(images, table.astype(np.uint8))


# ---------------------------------------------------------------- filters

def convolve(images: np.ndarray, name: str) -> np.ndarray:
    """Correlate with a fixed kernel; the border, where it does not fit, is copied."""
    kernel, divisor, offset = FILTERS[name]
    kernel = np.array(kernel)
    r = kernel.shape[0] // 2
    n, h, w, c = images.shape
    if h <= 2 * r or w <= 2 * r:
        return images
    total = np.zeros((n, h - 2 * r, w - 2 * r, c), dtype=np.int64)
    wide = images.astype(np.int64)
    for dy, dx in zip(*np.nonzero(kernel)):
        total += kernel[dy, dx] * wide[:, dy:h - 2 * r + dy, dx:w - 2 * r + dx]
    out = images.copy()
    out[:, r:h - r, r:w - r] = _to_bytes(np.floor(total / divisor + offset + 0.5))
    return out


def blur(images, v=None, draws=None):
    return convolve(images, "blur")


def contour(images, v=None, draws=None):
    return convolve(images, "contour")


def emboss(images, v=None, draws=None):
    return convolve(images, "emboss")


def edges(images, v=None, draws=None):
    return convolve(images, "edges")


def sharpness(images, v, draws=None):
    return blend(convolve(images, "smooth"), images, v)


# ---------------------------------------------------------------- geometry

def affine(images: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Output pixel (x, y) takes the input pixel at ``m [n, 2, 3] . (x, y, 1)``; outside is 0."""
    n, h, w, _ = images.shape
    y, x = np.mgrid[0:h, 0:w] + 0.5
    grid = np.stack([x, y, np.ones_like(x)])
    source = np.floor(np.einsum("nij,jhw->nihw", m, grid) + 1e-9).astype(np.int64)
    sx, sy = source[:, 0], source[:, 1]
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    picked = images[np.arange(n)[:, None, None], sy.clip(0, h - 1), sx.clip(0, w - 1)]
    return np.where(inside[..., None], picked, 0).astype(np.uint8)


def _maps(n: int) -> np.ndarray:
    return np.tile(np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), (n, 1, 1))


def _moved(images, v, row: int, column: int):
    m = _maps(len(images))
    m[:, row, column] += np.asarray(v, dtype=np.float64)
    return affine(images, m)


def shear_x(images, v, draws=None):
    return _moved(images, v, 0, 1)


def shear_y(images, v, draws=None):
    return _moved(images, v, 1, 0)


def translate_x_abs(images, v, draws=None):
    return _moved(images, v, 0, 2)


def translate_y_abs(images, v, draws=None):
    return _moved(images, v, 1, 2)


def translate_x(images, v, draws=None):
    return _moved(images, np.asarray(v) * images.shape[2], 0, 2)


def translate_y(images, v, draws=None):
    return _moved(images, np.asarray(v) * images.shape[1], 1, 2)


def rotate(images, v, draws=None):
    """Turn counter-clockwise by ``v`` degrees about the centre."""
    n, h, w, _ = images.shape
    a = np.deg2rad(np.asarray(v, dtype=np.float64))
    cos, sin, cx, cy = np.cos(a), np.sin(a), w / 2.0, h / 2.0
    m = np.empty((n, 2, 3))
    m[:, 0] = np.stack([cos, -sin, cx - cos * cx + sin * cy], axis=1)
    m[:, 1] = np.stack([sin, cos, cy - sin * cx - cos * cy], axis=1)
    return affine(images, m)


def flip(images, v=None, draws=None):
    return images[:, :, ::-1]


def cutout_abs(images, v, draws):
    """Fill a square of side ``v`` at a drawn centre, cut at the border (both ends included)."""
    n, h, w, _ = images.shape
    v = np.asarray(v, dtype=np.float64)
    x0 = np.maximum(0, draws[:, 0] * w - v / 2.0).astype(np.int64)
    y0 = np.maximum(0, draws[:, 1] * h - v / 2.0).astype(np.int64)
    x1, y1 = np.minimum(w, x0 + v), np.minimum(h, y0 + v)
    x, y = np.arange(w), np.arange(h)
    in_x = (x >= x0[:, None]) & (x <= x1[:, None])
    in_y = (y >= y0[:, None]) & (y <= y1[:, None])
    hit = (in_y[:, :, None] & in_x[:, None, :] & (v >= 0)[:, None, None])[..., None]
    return np.where(hit, np.array(CUTOUT_COLOR, dtype=np.uint8), images)


def cutout(images, v, draws):
    """The same with ``v`` as a fraction of the width; 0 changes nothing."""
    v = np.asarray(v, dtype=np.float64)
    return cutout_abs(images, np.where(v > 0, v * images.shape[2], -1.0), draws)


KERNELS = {
    "ShearX": shear_x, "ShearY": shear_y, "TranslateX": translate_x,
    "TranslateXabs": translate_x_abs, "TranslateY": translate_y,
    "TranslateYabs": translate_y_abs, "Rotate": rotate, "AutoContrast": autocontrast,
    "Invert": invert, "Equalize": equalize, "Flip": flip, "Solarize": solarize,
    "SolarizeAdd": solarize_add, "Posterize": posterize, "Contrast": contrast, "Color": color,
    "Brightness": brightness, "Sharpness": sharpness, "Cutout": cutout, "CutoutAbs": cutout_abs,
    "ToEMBOSS": emboss, "ToEDGES": edges, "ToCONTOUR": contour, "ToBLUR": blur,
    "Identity": identity,
}


# ---------------------------------------------------------------- recipe steps

def crop_resize(images: np.ndarray, box: np.ndarray, frame: np.ndarray, size: int) -> np.ndarray:
    """Resize to ``frame`` (height, width), cut ``box`` (x, y, w, h) and resize to ``size``.

    Two nearest-neighbour steps folded into one gather.
    """
    n, h, w, _ = images.shape
    i = np.arange(size) + 0.5

    def source(start, length, framed, full):
        at = np.floor(start[:, None] + i * length[:, None] / size)
        at = np.minimum(at, framed[:, None] - 1)
        return np.floor((at + 0.5) * full / framed[:, None]).astype(np.int64).clip(0, full - 1)

    xs = source(box[:, 0], box[:, 2], frame[:, 1], w)
    ys = source(box[:, 1], box[:, 3], frame[:, 0], h)
    return images[np.arange(n)[:, None, None], ys[:, :, None], xs[:, None, :]]


def shift_hue(images: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Turn the hue by a fraction ``v`` of the circle, saturation and value kept."""
    rgb = images.astype(np.float64)
    top, low = rgb.max(-1), rgb.min(-1)
    span = np.where(top > low, top - low, 1.0)
    r, g, b = (rgb[..., k] for k in range(3))
    sector = np.where(top == r, ((g - b) / span) % 6.0,
                      np.where(top == g, (b - r) / span + 2.0, (r - g) / span + 4.0))
    turned = (sector + 6.0 * np.asarray(v, dtype=np.float64).reshape(-1, 1, 1)) % 6.0
    channels = []
    for shift in (5.0, 3.0, 1.0):
        k = (shift + turned) % 6.0
        channels.append(top - (top - low) * np.clip(np.minimum(k, 4.0 - k), 0.0, 1.0))
    return _to_bytes(np.floor(np.stack(channels, -1) + 0.5))


def to_tensor(images: np.ndarray) -> np.ndarray:
    """Scale to 0..1, normalise per channel, channels first: ``float32 [n, 3, h, w]``."""
    scaled = (images / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
    return scaled.transpose(0, 3, 1, 2).astype(np.float32)

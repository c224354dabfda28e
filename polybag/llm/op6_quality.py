"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by what it says, its words and its runs of
three bytes, hashed to ``WORDS`` and ``GRAMS`` numbers, and by how it looks, a few counts of
characters and word shapes.  A learned layer projects the code; gated attention, learned from
document labels alone, weighs the passages, and the document is scored on the weighted sum of their
codes.  (Ilse, Tomczak, Welling: Attention-based Deep Multiple Instance Learning, 2018.)

The model is fitted on at most ``SAMPLE`` labelled documents, those first in the order of a hash
of the id; only their passages' numbers come to the driver.  Rows whose crc32 of the id, as text,
leaves no rest by 5 are held out.  Language, source and id are no inputs.  Scoring reads every
word of every document, inside the row, without a shuffle.

A null text counts as empty.  An empty text has no passage; it is scored on a code of zeros,
which takes part in the fit like any other.  Labels that are null are skipped, a document with
several labels counts once per label, labels without a document are ignored.  Without labels of
both kinds there is nothing to learn and every score is the share of label 1, or 0.5 without any.
Repeated rows are scored alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole, text_of, unwrapped
from polybag.session import ship_package

SAMPLE = 4_000
PASSAGE = 64
THRESHOLD = 0.3
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 60, 0.01, 1e-4
SEED = 11
LOOKS, WORDS, GRAMS = 14, 64, 64
WIDTH = LOOKS + WORDS + GRAMS
SOFTER = 3.0
# Documents scored at once.
SCORED = 256
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _HIGH = bytes(range(48, 58)), bytes(range(128, 256))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()")


def encode(text: str) -> np.ndarray:
    """(passages, WIDTH) numbers: a passage is ``PASSAGE`` words, the last may be shorter."""
    words = text.encode().split()
    rows, said = [], []
    for start in range(0, len(words), PASSAGE):
        part = words[start:start + PASSAGE]
        raw = b"".join(part)
        n, size = len(part), len(raw)
        distinct = len(set(part))
        upper = size - len(raw.translate(None, _UPPER))
        lower = size - len(raw.translate(None, _LOWER))
        marks = size - len(raw.translate(None, _MARKS))
        digits = size - len(raw.translate(None, _DIGITS))
        other = size - len(raw.translate(None, _HIGH))
        ends = sum(w[-1] in b".!?" for w in part)
        runs = sum(a == b for a, b in zip(part, part[1:]))
        bare = sum(not w.isalnum() and w.translate(None, _MARKS) == b"" for w in part)
        rows.append((
            upper / size, lower / size, marks / size, digits / size, other / size,
            size / n / 10, distinct / n, runs / n, ends / n, bare / n,
            sum(len(w) <= 3 for w in part) / n, max(map(len, part)) / 40, n / PASSAGE,
            sum(w[-1] in _MARKS for w in part) / n))
        said.append(_said(part))
    return np.hstack([np.array(rows), np.array(said)]) if rows else np.zeros((1, WIDTH))


def _said(words: list[bytes]) -> np.ndarray:
    """Shares of a passage's words and byte runs in each bucket, as roots so that rare ones count."""
    lower = b" ".join(words).lower()
    own = np.fromiter(map(crc32, lower.split(b" ")), np.int64, len(words)) % WORDS
    raw = np.frombuffer(b" " + lower + b" ", dtype=np.uint8).astype(np.uint32)
    # A multiplicative hash of each three bytes; its upper bits are the mixed ones.
    runs = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - 6)
    return np.sqrt(np.concatenate([np.bincount(own, minlength=WORDS) / len(own),
                                   np.bincount(runs, minlength=GRAMS) / len(runs)]))


class Model(NamedTuple):
    """Weights of the encoder, the gated attention and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.weights:
            return np.full(len(bags), self.mean[0])
        x = (np.concatenate(bags) - self.mean) / self.scale
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return _forward(self.weights, x, owner, len(bags))["score"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, owner: np.ndarray, bags: int) -> dict:
    code = np.tanh(x @ w["encode"] + w["encode0"])
    tanh, gate = np.tanh(code @ w["tanh"]), _sigmoid(code @ w["gate"])
    raw = (tanh * gate) @ w["attend"]
    top = np.full(bags, -np.inf)
    np.maximum.at(top, owner, raw)
    power = np.exp(raw - top[owner])
    share = power / np.bincount(owner, power, bags)[owner]
    pooled = np.zeros((bags, code.shape[1]))
    np.add.at(pooled, owner, share[:, None] * code)
    return {"code": code, "tanh": tanh, "gate": gate, "share": share, "pooled": pooled,
            "score": _sigmoid(pooled @ w["score"] + w["score0"])}


def _gradients(w: dict, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross entropy."""
    f = _forward(w, x, owner, len(y))
    out = (f["score"] - y) / len(y)
    pooled = out[:, None] * w["score"][None, :]
    code = f["share"][:, None] * pooled[owner]
    along = (f["code"] * pooled[owner]).sum(axis=1)
    raw = f["share"] * (along - np.bincount(owner, f["share"] * along, len(y))[owner])
    gated = raw[:, None] * w["attend"][None, :]
    tanh = gated * f["gate"] * (1 - f["tanh"] ** 2)
    gate = gated * f["tanh"] * f["gate"] * (1 - f["gate"])
    code += tanh @ w["tanh"].T + gate @ w["gate"].T
    inner = code * (1 - f["code"] ** 2)
    return {"encode": x.T @ inner, "encode0": inner.sum(axis=0), "tanh": f["code"].T @ tanh,
            "gate": f["code"].T @ gate, "attend": (f["tanh"] * f["gate"]).T @ raw,
            "score": f["pooled"].T @ out, "score0": out.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam over shuffled batches of documents; the same sample gives the same model."""
    if len(set(labels.tolist())) < 2:
        return Model(np.array([labels.mean() if len(labels) else 0.5]), np.ones(1), {})
    random = np.random.default_rng(SEED)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    # A bucket says little by itself, and there are many: each speaks more softly than a count.
    scale[LOOKS:] *= SOFTER
    scaled = [(b - mean) / scale for b in bags]
    shapes = {"encode": (WIDTH, HIDDEN), "encode0": (HIDDEN,), "tanh": (HIDDEN, ATTENTION),
              "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "score": (HIDDEN,), "score0": (1,)}
    w = {k: random.normal(0, 0.3, s) * (0 if k.endswith("0") else 1) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for start in range(0, len(order), 64):
            chosen = order[start:start + 64]
            x = np.concatenate([scaled[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(scaled[i]) for i in chosen])
            step += 1
            for k, g in _gradients(w, x, owner, labels[chosen]).items():
                g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _encoded(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t).astype(np.float32).tobytes())
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that aren't held out."""
    ship_package(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & ~held_out()).select(
        "doc_id", F.col(label).cast("double").alias("label"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = usable.join(docs.select("doc_id").distinct(), "doc_id").orderBy(
        order, "doc_id", "label").limit(sample)
    # The broadcast side has ``sample`` rows at most, and no more rows come to the driver.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", F.md5("text").alias("key"), _encoded(F.col("text")).alias("code")).orderBy(
        order, "doc_id", "label", "key").limit(sample).collect()
    return fit([np.frombuffer(r.code, dtype=np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.label for r in rows]))


def _score(model: Model) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            # Some documents at a time: the codes of all in a batch would be larger than their texts.
            parts = [model.scores([encode(t) for t in batch.iloc[i:i + SCORED]]) for i in range(0, len(batch), SCORED)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text_of())


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Every row as a struct, with its ``score``."""
    ship_package(docs.sparkSession)
    return kept_whole(docs, _score(model).alias("score"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return unwrapped(with_scores(docs, train(docs, labels)).where(F.col("score") >= threshold))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(f"{ROW}.doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias(
        "predicted")).withColumn("held_out", held_out())

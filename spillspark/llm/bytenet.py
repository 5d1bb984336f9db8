"""A byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are cut into chunks of 256 bytes that overlap by 64, from
the first byte to the last. Each byte is a learned vector plus flags that say
whether it equals the byte 3 to 10 places before it (repetition shows up
there). Learned filters over 8 bytes slide over each chunk in steps of four,
are rectified and max-pooled; the chunks' maxima are averaged and a small
dense layer combines them into one probability.

Training reads labelled rows only, at most ``TRAIN_ROWS`` of them (a documented
bound: the smallest hashes of the id among the rows that may be learned from),
whole texts of at most ``TRAIN_BYTES`` (so that what the driver holds is bounded in bytes
too), with Adam from a fixed seed. Scoring covers every byte of every
text, slab by slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import byte_column, slabs

CHUNK, OVERLAP = 256, 64
KERNEL, STEP = 8, 4
EMBED, FILTERS, HIDDEN = 6, 24, 12
LAGS = tuple(range(3, 11))
WIDTH = EMBED + len(LAGS)
TRAIN_ROWS, TRAIN_BYTES = 1500, 1 << 17
EPOCHS = 14
THRESHOLD = 0.3
BEFORE = max(LAGS)
POSITIONS = (CHUNK - KERNEL) // STEP + 1


def chunk_ends(at: np.ndarray) -> np.ndarray:
    """Chunks of the texts up to each: every text has one at least."""
    return np.cumsum(np.maximum(1, -(-(np.diff(at) - OVERLAP) // (CHUNK - OVERLAP))))


def chunks(raw: np.ndarray, at: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each chunk with BEFORE bytes ahead of it, text of each chunk), of chunks low to high.

    Zeros fill what lies outside a text.
    """
    size, ends = np.diff(at), chunk_ends(at)
    number = np.arange(low, min(ends[-1], high) if high is not None else ends[-1])
    text = np.searchsorted(ends, number, side="right")
    start = (number - np.r_[0, ends[:-1]][text]) * (CHUNK - OVERLAP)
    place = start[:, None] + np.arange(-BEFORE, CHUNK)
    inside = (place >= 0) & (place < size[text][:, None])
    flat = np.where(inside, place + at[:-1][text][:, None], 0)
    return np.where(inside, raw[flat], 0).astype(np.uint8) if len(raw) else np.zeros(flat.shape, np.uint8), text


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    normal = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
    return {
        "embed": normal(256, EMBED, scale=0.5),
        "filters": normal(KERNEL * WIDTH, FILTERS, scale=1 / np.sqrt(KERNEL * WIDTH)),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": normal(FILTERS, HIDDEN, scale=1 / np.sqrt(FILTERS)),
        "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=1 / np.sqrt(HIDDEN)),
        "out_bias": np.zeros(1, np.float32),
    }


def patches(model: dict, block: np.ndarray) -> np.ndarray:
    """(chunks * positions, KERNEL * WIDTH) inputs of the filters."""
    own = block[:, BEFORE:]
    x = np.empty((*own.shape, WIDTH), np.float32)
    x[:, :, :EMBED] = model["embed"][own]
    for i, lag in enumerate(LAGS):
        x[:, :, EMBED + i] = (own == block[:, BEFORE - lag : -lag]) & (own != 0)
    rows = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), KERNEL * WIDTH, axis=1)[:, :: STEP * WIDTH]
    return rows.reshape(-1, KERNEL * WIDTH)


def pooled(model: dict, block: np.ndarray) -> np.ndarray:
    """Max-pooled, rectified filter outputs of each chunk."""
    z = patches(model, block) @ model["filters"]
    return np.maximum(z.reshape(len(block), POSITIONS, FILTERS).max(axis=1) + model["bias"], 0)


def combined(model: dict, maxima: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Probability of each text from its chunks' maxima."""
    first = np.searchsorted(text, np.arange(texts))
    mean = np.add.reduceat(maxima, first, axis=0) / np.bincount(text, minlength=texts)[:, None]
    hidden = np.maximum(mean @ model["dense"] + model["dense_bias"], 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_bias"], -30, 30)))


def score(model: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text of a slab."""
    if len(at) < 2:
        return np.zeros(0)
    maxima, texts = [], []
    for a in range(0, int(chunk_ends(at)[-1]), 1024):
        block, text = chunks(raw, at, a, a + 1024)
        maxima.append(pooled(model, block))
        texts.append(text)
    return combined(model, np.concatenate(maxima), np.concatenate(texts), len(at) - 1)


def step(model: dict, raw: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss over the texts of a batch."""
    block, text = chunks(raw, at)
    n = len(at) - 1
    rows = patches(model, block)
    z = (rows @ model["filters"]).reshape(len(block), POSITIONS, FILTERS)
    arg = z.argmax(axis=1)
    top = np.take_along_axis(z, arg[:, None], axis=1)[:, 0] + model["bias"]
    maxima = np.maximum(top, 0)
    count = np.bincount(text, minlength=n)[:, None].astype(np.float32)
    mean = np.add.reduceat(maxima, np.searchsorted(text, np.arange(n)), axis=0) / count
    pre = mean @ model["dense"] + model["dense_bias"]
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_bias"], -30, 30)))
    d = ((p - label) * weight / n).astype(np.float32)
    dh = np.outer(d, model["out"]) * (pre > 0)
    dtop = (dh @ model["dense"].T / count)[text] * (top > 0)
    grad = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True), "dense": mean.T @ dh, "dense_bias": dh.sum(0), "bias": dtop.sum(0)}
    picked = rows.reshape(len(block), POSITIONS, -1)[np.arange(len(block))[:, None], arg]  # chunk, filter, input
    grad["filters"] = np.einsum("cfi,cf->if", picked, dtop, optimize=True)
    back = dtop[:, :, None] * model["filters"].T[None]  # the same shape as picked
    back = back.reshape(len(block), FILTERS, KERNEL, WIDTH)[..., :EMBED]
    seen = block[:, BEFORE:][np.arange(len(block))[:, None, None], arg[:, :, None] * STEP + np.arange(KERNEL)]
    grad["embed"] = np.zeros_like(model["embed"])
    for e in range(EMBED):
        grad["embed"][:, e] = np.bincount(seen.ravel(), back[..., e].ravel(), minlength=256)
    return grad


def trained(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """Fit to whole texts. Classes weigh the same; Adam in small batches."""
    model = initial(seed)
    if not len(labels):
        return model
    g = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    t = 0
    for epoch in range(epochs):
        order = g.permutation(len(texts))
        rate = 0.006 * (0.5 if epoch >= epochs * 2 // 3 else 1)
        for a in range(0, len(order), 24):
            pick = order[a : a + 24]
            at = np.r_[0, np.cumsum([len(texts[i]) for i in pick])]
            raw = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            grad = step(model, raw, at, labels[pick], weight[pick])
            t += 1
            for k, v in grad.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return model


def held_out() -> Column:
    """True where crc32 of the id's text leaves no remainder by five."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled whole texts that may be learned from.

    Labels are spread by a hash of the id. Ids with null labels are left out;
    of an id's several labels the smallest counts, and of its several texts the
    smallest too, so the choice doesn't depend on the order of rows. Longer
    texts than ``TRAIN_BYTES`` are scored, not learned from.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = sorted(texts.toLocalIterator(), key=lambda r: r.doc_id)
    return [(r.text or "").encode() for r in found], np.array([int(r.quality > 0) for r in found], np.float32)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts are one chunk of zeros. Without labels the untrained
    network scores. Rows that repeat an id are scored one by one; held_out is
    null for a null id; texts may be of any length (about a thousand chunks are
    held at a time); other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    model = trained(*training_rows(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            raw, at = byte_column(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(score(model, raw, at).astype(np.float64), 6))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

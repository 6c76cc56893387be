"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that together cover all of it.  Each byte is embedded by a
learned table; learned filters of ``WIDTH`` bytes move over the chunk by ``STRIDE``; each filter's
rectified response is max-pooled over the chunk.  A small layer reads the pooled responses of
every chunk and the chunks' outputs are averaged into one logit.

The network is fitted on the driver on a bounded sample of labelled rows: at most
``max_rows`` rows of each label, taken in the order of a hash of their id, and of those as many
as fit in ``max_bytes`` of text.  Scoring runs in the tasks over every whole text, one
stretch of chunks at a time, so memory does not depend on a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others

CHUNK, STEP = 512, 448  # consecutive chunks share 64 bytes
WIDTH, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 8, 24, 16
#: Chunks held at once while scoring.
STRETCH = 256
MAX_ROWS, MAX_BYTES = 1500, 6_000_000
EPOCHS, RATE = 10, 0.01


class Network:
    """The parameters, the forward pass and its gradient."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(f),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            "shift": np.zeros(FILTERS, f),
            "w1": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "b2": np.zeros(1, f),
        }

    @staticmethod
    def chunks(data: np.ndarray) -> np.ndarray:
        """Overlapping chunks of a text's bytes, padded with 256; an empty text is one chunk of padding."""
        n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
        padded = np.full((n - 1) * STEP + CHUNK, 256, np.int16)
        padded[: len(data)] = data
        return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]

    def forward(self, chunks: np.ndarray, keep: bool = False):
        p = self.p
        positions = (CHUNK - WIDTH) // STRIDE + 1
        emb = p["embed"][chunks]  # chunks, CHUNK, EMBED
        windows = np.lib.stride_tricks.sliding_window_view(emb.reshape(len(chunks), -1), WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED)
        response = (flat @ p["filters"]).reshape(len(chunks), positions, FILTERS)
        at = response.argmax(1) if keep else None
        top = response.max(1) + p["shift"]
        pooled = np.maximum(top, 0)
        mid = np.tanh(pooled @ p["w1"] + p["b1"])
        out = mid @ p["w2"] + p["b2"][0]
        return (out, (flat, at, top, pooled, mid)) if keep else out

    def gradient(self, chunks: np.ndarray, kept, d_out: np.ndarray) -> dict[str, np.ndarray]:
        p, (flat, at, top, pooled, mid) = self.p, kept
        g = {"w2": mid.T @ d_out, "b2": d_out.sum(keepdims=True)}
        d_mid = np.outer(d_out, p["w2"]) * (1 - mid * mid)
        g["w1"], g["b1"] = pooled.T @ d_mid, d_mid.sum(0)
        d_top = (d_mid @ p["w1"].T) * (top > 0)
        g["shift"] = d_top.sum(0)
        positions = len(flat) // len(chunks)
        rows = (np.arange(len(chunks))[:, None] * positions + at).reshape(-1)  # the window behind each maximum
        which = np.tile(np.arange(FILTERS), len(chunks))
        d = d_top.reshape(-1)
        g["filters"] = np.stack([(flat[rows[which == k]] * d[which == k, None]).sum(0) for k in range(FILTERS)], 1)
        d_emb = (p["filters"].T[which] * d[:, None]).reshape(-1, WIDTH, EMBED)
        places = (at * STRIDE).reshape(-1)[:, None] + np.arange(WIDTH)
        owners = np.repeat(np.arange(len(chunks)), FILTERS)[:, None]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], chunks[owners, places].reshape(-1), d_emb.reshape(-1, EMBED))
        return g

    def logit(self, data: np.ndarray) -> float:
        chunks = self.chunks(data)
        total = sum(float(self.forward(chunks[i : i + STRETCH]).sum()) for i in range(0, len(chunks), STRETCH))
        return total / len(chunks)


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 9) -> Network:
    """Adam on the log loss, documents in a fixed shuffled order; labels weigh by the root of their rarity."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32) ** 0.5
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    bodies = [np.frombuffer(t, np.uint8) for t in texts]
    whole = [Network.chunks(b) for b in bodies]
    step, steps = 0, max(1, epochs * -(-len(whole) // 16))
    for _ in range(epochs):
        order = rng.permutation(len(whole))
        # a third of the texts stand in by a short stretch of theirs, so that short texts are learned too
        parts = list(whole)
        for k in np.flatnonzero(rng.random(len(whole)) < 0.33):
            size = int(rng.integers(24, 400))
            at = int(rng.integers(0, max(1, len(bodies[k]) - size)))
            parts[k] = Network.chunks(bodies[k][at : at + size])
        for i in range(0, len(order), 16):
            some = order[i : i + 16]
            total = {k: np.zeros_like(x) for k, x in net.p.items()}
            for k in some:
                outs = [net.forward(parts[k][a : a + STRETCH], keep=True) for a in range(0, len(parts[k]), STRETCH)]
                n = len(parts[k])
                score = 1 / (1 + np.exp(-sum(float(o.sum()) for o, _ in outs) / n))
                slope = weight[k] * (score - y[k]) / n / len(some)
                for a, (o, kept) in zip(range(0, n, STRETCH), outs):
                    for name, g in net.gradient(parts[k][a : a + STRETCH], kept, np.full(len(o), slope, np.float32)).items():
                        total[name] += g
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for name, g in total.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                net.p[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, max_bytes: int) -> list[tuple[bytes, int]]:
    """The bounded sample: (text, label).  Rows whose crc32 of the id's text has remainder 2 by 4 are held out."""
    key = F.col(labels.columns[0])
    taught = labels.select(key.alias("_id"), F.col(labels.columns[1]).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").where(~held_out(F.col("_id")))
    chosen = [r for y in (0, 1) for r in taught.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r["_id"], r["_y"]) for r in chosen], taught.schema)
    d = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("binary").alias("_t"))
    # max_rows ids a label bound the broadcast
    rows = d.join(F.broadcast(ids), F.col("_d") == F.col("_id")).select("_id", "_y", "_t", F.octet_length("_t").alias("_n"))
    sizes = rows.select("_id", "_y", "_n").orderBy("_y", F.xxhash64("_id"), "_id").limit(4 * max_rows).collect()
    fits, used = set(), {0: 0, 1: 0}
    for r in sizes:
        if used[r["_y"]] + (r["_n"] or 0) <= max_bytes // 2:
            used[r["_y"]] += r["_n"] or 0
            fits.add(r["_id"])
    return [(bytes(r["_t"] or b""), r["_y"]) for r in sorted(rows.where(F.col("_id").isin(sorted(fits))).select("_id", "_y", "_t").collect(), key=lambda r: (r["_id"], r["_t"] or b""))]


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _score(net: Network, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = []
            for text in batch.column(at):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                scores.append(1 / (1 + np.exp(-np.clip(net.logit(data), -30, 30))))
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if keep_text or i != at}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(np.array(scores, np.float64))})

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, keep_text: bool = True) -> DataFrame:
    """struct ``row`` (``docs``' columns but the text, whatever their names), ``text`` (bytes) and ``score`` in 0..1, higher for label 1.

    ``labels``: id, label (others are not read; null or other labels teach nothing).  Null and
    empty texts are scored as a chunk of padding.  With no labelled row every score is that of an
    untrained network.  Repeated rows score alike; an empty table gives no rows.
    """
    sample = training_rows(docs, labels, id_col, text_col, max_rows, max_bytes)
    net = fit([t for t, _ in sample], [y for _, y in sample])
    d = docs.select(others(docs, text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return d.mapInArrow(_score(net, keep_text), T.StructType([f for f in d.schema if keep_text or f.name != "text"] + [T.StructField("score", T.DoubleType())]))

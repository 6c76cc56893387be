"""Product codes of vectors: Lloyd's rounds over integer parts, with a heap of slacks for each codebook entry.

Vectors are kept in blocks, and a block's state travels with it from round to round: for each part
position and entry a heap of the parts assigned to it, keyed by the slack between the distances to
the second nearest and the nearest entry, plus the drift that the entry had gathered at the time.
Between two rounds an entry's drift grows by its own movement and the largest of any other; only
parts whose key the drift has reached can have changed their entry, so only these are popped, compared
with all entries exactly, and pushed again.  All others are known to be where they were.

A task tells its blocks' changes of the entries' sums, which are added up before they are shuffled;
the driver holds the codebooks and their sums only.  Each round's blocks are written to the shared
folder, and the round before is removed then.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, delete, ensure_checkpoint_dir, lookup

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
NONE = 255
#: Slacks are taken this much too small, for the rounding of distances.
MARGIN = 1e-9


def limit(width: int) -> int:
    """The largest component for which no sum of a vector's squared distances leaves a long."""
    return math.isqrt((1 << 62) // (PARTS * width)) // 2


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, with zeros up to PARTS * width: (n, PARTS, width)."""
    n = len(vectors)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((n, PARTS * width), np.int32)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out.reshape(n, PARTS, width)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (parts, entries), exact."""
    out = np.empty((len(parts), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        d = parts.astype(np.int64) - entry
        out[:, e] = (d * d).sum(1)
    return out


class Block:
    """Vectors' integer parts, their entries, and a heap of (key, vector) for each part position and entry."""

    def __init__(self, data: np.ndarray, entries: int):
        self.data = data
        n = len(data)
        self.codes = np.full((n, PARTS), NONE, np.uint8)
        # at first all parts are due, in the first entry's heap
        self.members = [[np.arange(n, dtype=np.int32) if e == 0 else np.zeros(0, np.int32) for e in range(entries)] for _ in range(PARTS)]
        self.keys = [[np.full(len(m), -np.inf) for m in row] for row in self.members]
        self.popped = 0

    def assign(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Assign what the drift allows to have changed; changes of the entries' sums and counts (PARTS, entries, width + 1)."""
        entries, width = books.shape[1:]
        delta = np.zeros((PARTS, entries, width + 1), np.int64)
        for p in range(PARTS):
            heaps: dict[int, list[tuple[float, int]]] = {}
            due: list[int] = []

            def heap(e: int) -> list[tuple[float, int]]:
                if e not in heaps:
                    heaps[e] = list(zip(self.keys[p][e].tolist(), self.members[p][e].tolist()))
                return heaps[e]

            for e in range(entries):
                if not len(self.keys[p][e]) or self.keys[p][e][0] > drift[p, e]:
                    continue
                h = heap(e)
                while h and h[0][0] <= drift[p, e]:
                    due.append(heapq.heappop(h)[1])
            if due:
                at = np.array(sorted(due), np.int64)
                self.popped += len(at)
                d = distances(self.data[at, p], books[p])
                new = d.argmin(1)
                root = np.sqrt(d.astype(np.float64))
                near = root[np.arange(len(at)), new]
                root[np.arange(len(at)), new] = np.inf
                far = root.min(1)
                slack = np.where(np.isinf(far), np.inf, (far - near) - MARGIN * (far + near + 1))
                for key, i, e in zip((slack + drift[p, new]).tolist(), at.tolist(), new.tolist()):
                    heapq.heappush(heap(e), (key, i))
                old = self.codes[at, p]
                moved = old != new
                rows = np.concatenate([self.data[at, p], np.ones((len(at), 1), np.int32)], 1).astype(np.int64)[moved]
                np.add.at(delta[p], new[moved], rows)
                had = old[moved] != NONE
                np.subtract.at(delta[p], old[moved][had], rows[had])
                self.codes[at, p] = new
            for e, h in heaps.items():
                self.keys[p][e] = np.array([k for k, _ in h], np.float64)
                self.members[p][e] = np.array([i for _, i in h], np.int32)
        return delta

    def errors(self, books: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.data), np.int64)
        for p in range(PARTS):
            d = self.data[:, p].astype(np.int64) - books[p][self.codes[:, p]]
            out += (d * d).sum(1)
        return out

    def state(self, delta: np.ndarray) -> dict[str, bytes]:
        flat = lambda rows, kind: np.concatenate([x for row in rows for x in row]).astype(kind).tobytes()
        sizes = np.array([[len(x) for x in row] for row in self.members], np.int32)
        return {"data": self.data.tobytes(), "codes": self.codes.tobytes(), "members": flat(self.members, np.int32), "keys": flat(self.keys, np.float64), "sizes": sizes.tobytes(), "delta": delta.tobytes()}

    @staticmethod
    def of(row: dict[str, bytes], width: int, entries: int) -> Block:
        b = Block.__new__(Block)
        b.data = np.frombuffer(row["data"], np.int32).reshape(-1, PARTS, width)
        b.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, PARTS).copy()
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
        split = lambda name, kind: np.split(np.frombuffer(row[name], kind), ends)
        members, keys = split("members", np.int32), split("keys", np.float64)
        b.members = [members[p * entries : (p + 1) * entries] for p in range(PARTS)]
        b.keys = [keys[p * entries : (p + 1) * entries] for p in range(PARTS)]
        b.popped = 0
        return b


NAMES = ["data", "codes", "members", "keys", "sizes", "delta"]


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _first(width: int, books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * PARTS * width)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                b = Block(integers(part.column(2), width), books.shape[1])
                state = b.state(b.assign(books, drift))
                yield pa.RecordBatch.from_pydict({"ids": _listed(part.column(0)), "labels": _listed(part.column(1))} | {k: pa.array([v], pa.binary()) for k, v in state.items()})

    return run


def _blocks(batch: pa.RecordBatch, width: int, entries: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k].as_py() for name in NAMES if name != "delta"}
        yield batch.column("ids").slice(k, 1), batch.column("labels").slice(k, 1), Block.of(row, width, entries)


def _next(width: int, books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, b in _blocks(batch, width, books.shape[1]):
                state = b.state(b.assign(books, drift))
                yield pa.RecordBatch.from_pydict({"ids": ids, "labels": labels} | {k: pa.array([v], pa.binary()) for k, v in state.items()})

    return run


def _last(width: int, books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, b in _blocks(batch, width, books.shape[1]):
                b.assign(books, drift)
                yield pa.RecordBatch.from_pydict({"vec_id": ids.flatten(), "label": labels.flatten(), "code": pa.array([c.tobytes().hex() for c in b.codes], pa.string()), "error": pa.array(b.errors(books), pa.int64())})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            d = np.frombuffer(x.as_py(), np.int64)
            total = d.copy() if total is None else total + d
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int64()), "total": pa.array(total[some], pa.int64())})


def _entries(rows: list, width: int) -> np.ndarray:
    """The first codebooks: (PARTS, entries, width)."""
    vectors = integers(pa.array([list(r.vector) for r in rows], pa.list_(pa.float64())), width)
    return vectors.transpose(1, 0, 2).astype(np.int64).copy()


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of the vectors and the final codebooks (PARTS, entries, width); none if there is no vector.

    Rows whose vector is null or holds a null or non-finite component are left out.  Components are
    floor(SCALE * x).  Vectors of different lengths, or of one that PARTS does not divide, are filled up with
    zeros.  The first entries are the vectors of the smallest ids (nulls last; of one id the smaller
    vector), fewer if there are fewer.  Repeated rows count and are coded each.  A vector so large that
    its squared distances may not fit a long has a null code and a null error and takes no part.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = base.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    schema = T.StructType([*kept.select("vec_id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema), None
    width = max(1, -(-longest // PARTS))
    fits = F.forall("vector", lambda x: F.abs(x) * float(SCALE) <= float(limit(width) - 1))
    fit = kept.where(fits)
    first = fit.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    too_large = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not first:
        return too_large, None
    books = _entries(first, width)
    drift = np.zeros(books.shape[:2])
    sums = np.zeros((*books.shape[:2], width + 1), np.int64)
    ensure_checkpoint_dir(spark)
    home = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"codes-{uuid.uuid4().hex}")
    state = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), *(T.StructField(n, T.BinaryType()) for n in NAMES)])
    for k in range(rounds):
        blocks = fit.mapInArrow(_first(width, books, drift), state) if k == 0 else spark.read.schema(state).parquet(f"{home}/{k - 1}").mapInArrow(_next(width, books, drift), state)
        blocks.write.parquet(f"{home}/{k}")
        if k:
            delete(vectors, f"{home}/{k - 1}")
        told = spark.read.schema(state).parquet(f"{home}/{k}").select("delta").mapInArrow(_summed, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
        for r in told.collect():  # a number for each component of the codebooks
            sums.reshape(-1)[r.slot] += r.total
        count = sums[:, :, -1:]
        new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
        moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2))
        for p in range(PARTS):
            for e in range(books.shape[1]):
                rest = np.delete(moved[p], e)
                drift[p, e] += (moved[p, e] + (rest.max() if len(rest) else 0.0)) * (1 + MARGIN)
        books = new
    ready = spark.read.schema(state).parquet(f"{home}/{rounds - 1}") if rounds else fit.mapInArrow(_first(width, books, drift), state)
    coded = cut(ready.mapInArrow(_last(width, books, drift), schema))
    delete(vectors, home)
    return coded.unionByName(too_large), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors' sum over all rows of the label (null is a label)."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error"))
    return lookup(coded, cut(sums), "label", "vec_id")

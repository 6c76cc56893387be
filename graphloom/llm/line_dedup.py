"""Line dedup by two Bloom filters: only lines that may repeat are shuffled, as digests, and confirmed exactly.

1. Each task puts the digests of its documents' long lines into a filter of those seen once and,
   where the first has them already, into a filter of those seen twice.  The tasks' filters are
   merged segment by segment: what two tasks have both seen once has been seen twice.
2. Digests that the merged second filter knows are suspects; they alone are shuffled, 16 bytes
   each, pre-aggregated by digest and document, and counted exactly.
3. The digests that a document has to lose go back to it, and its text is written anew.

A filter never misses a repeat, so its size bears on cost only.  It follows the bytes of the texts
up to ``MAX_BITS``, which bounds what the driver and a task hold; beyond that more lines are
suspects, at worst all, and the results are the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lookup, others
from .textbytes import U64

#: Code points from which a key counts, and documents in which it has to stand.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits set for a digest; bits of a segment, in which filters are merged; most bits of a filter.
HASHES, SEGMENT_BITS, MAX_BITS = 3, 1 << 20, 1 << 30
STRIP = b" \t\n\x0b\x0c\r"


def digests(text: bytes, least: int) -> list[bytes | None]:
    """For each line the digest of its key, or none if the key is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()  # bytes: A-Z only
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            out.append(hashlib.blake2b(key, digest_size=16).digest())
        else:
            out.append(None)
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_py() or b""


def _distinct(column: pa.Array, least: int) -> list[list[bytes]]:
    """Each document's distinct digests."""
    return [list(dict.fromkeys(d for d in digests(t, least) if d is not None)) for t in _texts(column)]


def _places(found: np.ndarray, bits: int) -> np.ndarray:
    """The bits of digests (n, 2): an array (n, HASHES)."""
    return (found[:, :1] + np.arange(HASHES, dtype=U64) * (found[:, 1:] | U64(1))) & U64(bits - 1)


def known(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> U64(3)] >> (places & U64(7)).astype(np.uint8)) & 1).all(1)


def _add(bitmap: np.ndarray, places: np.ndarray) -> None:
    places = places.reshape(-1)
    at, bit = places >> U64(3), places & U64(7)
    for b in range(8):  # one bit at a time, so that places that share a byte do not undo each other
        bitmap[at[bit == b]] |= np.uint8(1 << b)


def _filters(bits: int, least: int):
    """A task's two filters, segment by segment, packed; segments without a bit are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            raw = b"".join(d for of in _distinct(batch.column(0), least) for d in of)
            if not raw:
                continue
            found = np.frombuffer(raw, U64).reshape(-1, 2)
            _, first, count = np.unique(found[:, 0], return_index=True, return_counts=True)
            places = _places(found[first], bits)
            again = (count > 1) | known(once, places)
            _add(twice, places[again])
            _add(once, places)
        size = min(bits, SEGMENT_BITS) // 8
        for k in range(len(once) // size):
            a, b = once[k * size : (k + 1) * size], twice[k * size : (k + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "body": pa.array([zlib.compress(a.tobytes() + b.tobytes(), 1)], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: those seen twice by one task, or once by two."""
    last, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({"segment": pa.array([last], pa.int32()), "body": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})

    for batch in batches:
        for segment, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            both = np.frombuffer(zlib.decompress(body.as_py()), np.uint8)
            a, b = both[: len(both) // 2], both[len(both) // 2 :]
            if segment != last:
                if last is not None:
                    yield done()
                last, once, twice = segment, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if last is not None:
        yield done()


def seen_twice(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged filter of digests that stand in two documents (column 0 of ``texts``: bytes)."""
    parts = min(max(1, bits // SEGMENT_BITS), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    segments = texts.mapInArrow(_filters(bits, least), "segment int, body binary").repartition(parts, "segment").sortWithinPartitions("segment")
    out, size = np.zeros(bits // 8, np.uint8), min(bits, SEGMENT_BITS) // 8
    for r in segments.mapInArrow(_merge, "segment int, body binary").toLocalIterator():  # bits / 8 bytes in all, one segment at a time
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(zlib.decompress(r.body), np.uint8)
    return out


def _suspects(twice, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            per = _distinct(batch.column(1), least)
            flat = [d for of in per for d in of]
            if not flat:
                continue
            hit = known(bitmap, _places(np.frombuffer(b"".join(flat), U64).reshape(-1, 2), bits))
            row = np.repeat(np.arange(len(per)), [len(of) for of in per])[hit]
            yield pa.RecordBatch.from_pydict({"key": pa.array([flat[k] for k in np.flatnonzero(hit).tolist()], pa.binary()), "id": batch.column(0).take(pa.array(row))})

    return run


def _rewrite(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, texts = [], [], []
            for text, drop in zip(_texts(batch.column(1)), batch.column(2)):
                gone = set(drop.as_py() or ())
                if not gone:
                    lines.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    texts.append(text)
                    continue
                own = text.split(b"\n")
                kept = [line for line, d in zip(own, digests(text, least)) if d is None or d not in gone]
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
                texts.append(b"\n".join(kept))
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(texts, pa.binary())})

    return run


def repeated_lines(suspects: DataFrame, least_docs: int) -> DataFrame:
    """(key, keeper) of the digests (key, id; each pair once) that stand in at least so many documents, with the largest id."""
    return suspects.groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).select("key", "keeper")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """struct ``row`` (``docs``' columns but the text), n_lines (before dropping), n_dropped and kept (bytes: the other lines, joined by \\n).

    A line's key is the line without space and 0x09-0x0D at both ends, A-Z lower-cased.  Keys of at
    least ``least_chars`` code points that stand in at least ``least_docs`` documents lose all their
    lines except those in the document of the largest id that holds them - all of that document's,
    if it holds several.  A null or empty text is one empty line.  Rows that share an id are one
    document, and each loses or keeps its own lines.  A null id counts for no document and comes
    before all others, so such rows lose what is repeated elsewhere.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"), others(docs, text_col).alias("row"))
    if bits is None:
        total = base.agg(F.sum(F.octet_length("_text").cast("bigint"))).first()[0] or 0
        bits = min(MAX_BITS, max(SEGMENT_BITS, 1 << (total // 8).bit_length()))
    twice = spark.sparkContext.broadcast(seen_twice(base.select("_text"), bits, least_chars).tobytes())
    schema = T.StructType([T.StructField("key", T.BinaryType()), *base.select("id").schema])
    found = base.select("id", "_text").mapInArrow(_suspects(twice, bits, least_chars), schema)
    suspects = cut(found.distinct())
    repeated = cut(repeated_lines(suspects, least_docs))
    hits = lookup(suspects, repeated, "key", "id").where("keeper is not null")
    drops = cut(hits.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias("_id")).agg(F.collect_list("key").alias("_drop")))
    whole = base.join(drops, F.col("id").eqNullSafe(F.col("_id")), "left").select("row", "_text", "_drop")
    out = T.StructType([*whole.select("row").schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.BinaryType())])
    return whole.mapInArrow(_rewrite(least_chars), out)

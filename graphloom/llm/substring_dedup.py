"""Substring dedup: words inside passages of ``WINDOW`` words that also start earlier in the corpus.

The corpus is dealt into shards by content, so that equal passages always meet in one shard and
no document has to be streamed past shards that cannot hold its passages:

1. The anchor of a window is its ``GRAM``-word piece with the smallest hash; equal windows have
   equal anchors.  Anchors are counted; windows whose anchor occurs once are unique.
2. For each repeated anchor, the stretch of words that its windows cover goes to the shard of the
   anchor; equal stretches are merged first, keeping the earliest place.  Windows of an anchor
   with over ``HOT`` occurrences are dealt one by one by their own hash instead.
3. A shard concatenates its stretches into a compressed FM-index and streams their words backwards
   through its wavelet tree: for each place, how many words up to it also stand elsewhere (its
   matching statistic) and the suffix range of those.  Where that reaches the window, the range
   holds all occurrences, and the earliest of them is the one to keep.
4. A document's windows with repeated anchors are removed except those found to be earliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, others
from .fm_index import FMIndex
from .textbytes import SPACE_WORDS, U64, find_words, hash_words, mix, text_slices, within

WINDOW, GRAM = 20, 6
HOT = 20_000
#: Words indexed as one shard inside a task.
SHARD_WORDS = 400_000
_ODD = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (they may pass the end of a row; see ``within``)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    total = np.zeros(size, U64)
    for k in range(n):
        total += words[k : k + size] * _ODD[k]
    return mix(total)


def anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, anchor place, first window, windows) of each stretch of windows with one anchor; places count words of the slice."""
    starts = within(first, window)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, np.zeros(0, U64), none, none, none
    grams = gram_hashes(words, GRAM)
    bits = max(1, int(len(grams)).bit_length())
    low = (grams >> U64(bits) << U64(bits)) | np.arange(len(grams)).astype(U64)
    span, have = window - GRAM + 1, 1
    while have < span:  # running minimum over span grams
        more = min(have, span - have)
        low = np.minimum(low[:-more], low[more:])
        have += more
    place = (low[starts] & U64((1 << bits) - 1)).astype(np.int64)
    row = np.searchsorted(first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], grams[place[at]], place[at], starts[at], np.diff(np.append(at, len(starts)))


def _sliced(column: pa.Array):
    for row, end, data, offsets in text_slices(column):
        starts, ends, first = find_words(data, offsets, SPACE_WORDS)
        yield row, end, data, starts, ends, first, hash_words(data, starts, ends, fold=False)


def _list_anchors(window: int):
    """Task: (anchor, id, th, n): each anchor of a document once, with the number of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, _, _, _, _, first, words in _sliced(batch.column(2)):
                r, h, _, _, _ = anchors(words, first, window)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(r)))
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(h[at].view(np.int64)), "id": pa.array(ids[row + r[at]]), "th": pa.array(th[row + r[at]]), "n": pa.array(n.astype(np.int32))})

    return run


def _repeated(told: pa.Array, hot: pa.Array, row: int, r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each stretch 0 if its anchor isn't repeated, else 1, or 2 if it is hot; the columns list each document's anchors."""
    out = np.zeros(len(r), np.int8)
    cuts = np.searchsorted(r, np.arange(r[-1] + 2)) if len(r) else [0]
    own = h.view(np.int64)
    for k in range(len(cuts) - 1):
        mine = slice(cuts[k], cuts[k + 1])
        if mine.start < mine.stop and told[row + k].is_valid:
            out[mine] = np.isin(own[mine], told[row + k].values.to_numpy(zero_copy_only=False))
            if len(hot[row + k]):
                out[mine] += np.isin(own[mine], hot[row + k].values.to_numpy(zero_copy_only=False))
    return out


def _stretches(window: int):
    """Task: (route, id, th, at, body) of the stretches with repeated anchors; body: their bytes, at: first window in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, _, data, starts, ends, first, words in _sliced(batch.column(2)):
                r, h, _, begin, count = anchors(words, first, window)
                kind = _repeated(batch.column(3), batch.column(4), row, r, h)
                k = np.flatnonzero(kind == 1)
                hot = np.flatnonzero(kind == 2)
                single = np.repeat(begin[hot] - (np.cumsum(count[hot]) - count[hot]), count[hot]) + np.arange(count[hot].sum())
                owner = np.concatenate([r[k], np.repeat(r[hot], count[hot])])
                b = np.concatenate([begin[k], single])
                e = b + np.concatenate([count[k], np.ones(len(single), np.int64)]) + window - 2
                route = np.concatenate([h[k], gram_hashes(words, window)[single] if len(single) else np.zeros(0, U64)])
                raw = data.tobytes()
                at = b - first[owner]
                # equal stretches of the slice go on once, with the earliest place
                least: dict[bytes, int] = {}
                body = [raw[x:y] for x, y in zip(starts[b].tolist(), ends[e].tolist())]
                for i in np.lexsort((at, th[row + owner], ids[row + owner])).tolist():
                    least.setdefault(body[i], i)
                j = np.fromiter(least.values(), np.int64, len(least))
                yield pa.RecordBatch.from_pydict({"route": pa.array(route[j].view(np.int64)), "id": pa.array(ids[row + owner[j]]), "th": pa.array(th[row + owner[j]]), "at": pa.array(at[j].astype(np.int32)), "body": pa.array(list(least), pa.binary())})

    return run


def earliest(bodies: list[bytes], ids: np.ndarray, th: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch, which of its windows have no earlier occurrence among these stretches."""
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts, ends, first = find_words(data, offsets, SPACE_WORDS)
    _, dense = np.unique(hash_words(data, starts, ends, fold=False), return_inverse=True)
    n = np.diff(first)
    piece = np.repeat(np.arange(len(n)), n)
    where = np.arange(len(dense)) + piece  # one separator after each stretch
    text = np.zeros(len(dense) + len(n), np.int64)
    text[where] = dense + 1
    query = within(first, window)
    owner = piece[query]
    place = at[owner] + query - first[owner]
    order = np.lexsort((place, th[owner], ids[owner]))
    rank = np.empty(len(query), np.int64)
    rank[order] = np.arange(len(query))
    rank_at = np.full(len(text), len(query), np.int64)
    rank_at[where[query]] = rank
    index = FMIndex(text, sample=2)
    matched, lo, hi = index.repeats(text, where[query] + window - 1, window)
    mine = np.ones(len(query), bool)
    shared = np.flatnonzero(matched >= window)
    if len(shared):
        ranges, at_first, which = np.unique(lo[shared], return_index=True, return_inverse=True)
        size = hi[shared][at_first] - ranges
        begin = np.cumsum(size) - size
        rows = np.repeat(ranges - begin, size) + np.arange(size.sum())
        best = np.minimum.reduceat(rank_at[index.locate(rows)], begin)
        mine[shared] = rank[shared] == best[which]
    counts = n - window + 1
    return np.split(mine, np.cumsum(counts)[:-1])


def _search(window: int):
    """Task over stretches sorted by route: (id, th, at, windows that are the earliest) of those with such windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close(rows):
            bodies = [x[1] for x in rows]
            key = [int(x[2]) for x in rows]
            ids = np.array([k >> 55 for k in key], np.int64)
            th = np.array([(k >> 31) & 0xFFFFFF for k in key], np.int32)
            at = np.array([k & 0x7FFFFFFF for k in key], np.int64)
            out = earliest(bodies, ids, th, at, window)
            places = [(a + np.flatnonzero(m)).astype(np.int32) for a, m in zip(at.tolist(), out)]
            some = [i for i, p in enumerate(places) if len(p)]
            return pa.RecordBatch.from_pydict({"id": pa.array(ids[some], pa.int64()), "th": pa.array(th[some], pa.int32()), "places": pa.array([places[i] for i in some], pa.list_(pa.int32()))})

        for batch in batches:
            for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if size >= SHARD_WORDS and x[0] != held[-1][0]:
                    yield close(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[1]) // 6
        if held:
            yield close(held)

    return run


def _remove(window: int):
    """Task: row, n_words, removed (flat starts and ends of the removed stretches, in words) and the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kept_places = batch.column(names.index("_firsts"))
            for row, end, data, starts, ends, first, words in _sliced(batch.column(names.index("_text"))):
                r, h, _, begin, count = anchors(words, first, window)
                kind = _repeated(batch.column(names.index("_told")), batch.column(names.index("_hot")), row, r, h)
                gone = np.zeros(len(words) + 1, np.int64)
                many = kind > 0
                windows = np.repeat(begin[many] - (np.cumsum(count[many]) - count[many]), count[many]) + np.arange(count[many].sum())
                gone[windows] = 1
                for k in np.unique(r[many]).tolist():
                    for p in kept_places[row + k].as_py() or ():
                        gone[first[k] + np.array(p, np.int64)] = 0
                windows = np.flatnonzero(gone)
                edge = np.zeros(len(words) + 1, np.int64)
                edge[windows] += 1
                np.add.at(edge, windows + window, -1)
                stays = np.cumsum(edge[:-1]) <= 0
                raw = data.tobytes()
                n_words, spans, texts = [], [], []
                for k in range(end - row):
                    a, b = int(first[k]), int(first[k + 1])
                    n_words.append(b - a)
                    if a == b:
                        spans.append([])
                        texts.append(b"")
                        continue
                    mine = stays[a:b]
                    own = raw[starts[a] : ends[b - 1]].split()
                    if mine.all():
                        spans.append([])
                        texts.append(b" ".join(own))
                        continue
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], ~mine, [False]]).astype(np.int8)))
                    spans.append(flips.tolist())
                    texts.append(b" ".join(compress(own, mine.tolist())))
                yield pa.RecordBatch.from_pydict({"row": batch.column(0).slice(row, end - row), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(spans, pa.list_(pa.int32())), "kept": pa.array(texts, pa.binary())})

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """struct ``row`` (``docs``' columns but the text), n_words, removed (starts and ends of removed stretches, in words) and kept (bytes).

    Windows are judged on the input.  The earliest place is the one with the smallest id, then the
    earliest start; rows that share an id count as one document if their texts are equal and are
    ordered by a hash of the text if not.  A null id comes after all others.  Null and empty texts
    have no words, texts under ``window`` words keep all; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.pmod(F.xxhash64(t), F.lit(1 << 24)).cast("int").alias("th"), t.alias("_text"), others(docs, text_col).alias("row"))
    listed = base.select("id", "th", "_text").mapInArrow(_list_anchors(window), "anchor long, id long, th int, n int")
    counts = listed.groupBy("anchor").agg(F.sum("n").alias("c")).where("c > 1")
    places = cut(listed.join(counts, "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("_told"), F.collect_set(F.when(F.col("c") > hot, F.col("anchor"))).alias("_hot")))
    # both reads of the texts by document ask for the same columns of the same left join, so they share one shuffle
    told = base.join(places, ["id", "th"], "left")
    stretches = told.select("id", "th", "_text", "_told", "_hot", "row").mapInArrow(_stretches(window), "route long, id long, th int, at int, body binary")
    # id, th and at as one ordered number, which hash aggregation can keep the least of
    key = F.col("id").cast("decimal(38,0)") * F.lit(1 << 55).cast("decimal(18,0)")
    order = (key + (F.shiftleft(F.col("th").cast("long"), 31) + F.col("at")).cast("decimal(38,0)")).cast("decimal(38,0)")
    # dealt by route once: the merge of equal stretches and the search use the same partitions
    merged = stretches.select("route", "body", order.alias("k")).repartition("route").groupBy("route", "body").agg(F.min("k").alias("k"))
    firsts = merged.sortWithinPartitions("route").mapInArrow(_search(window), "id long, th int, places array<int>").groupBy("id", "th").agg(F.collect_list("places").alias("_firsts"))
    whole = told.join(firsts, ["id", "th"], "left").select("row", "_text", "_told", "_hot", "_firsts")
    schema = T.StructType([*whole.select("row").schema, T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept", T.BinaryType())])
    return whole.mapInArrow(_remove(window), schema)

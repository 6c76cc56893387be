"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded stretch of documents inside one task.  Its words become symbols; words
that no test item has are separators, since no phrase passes them, and stretches between
separators shorter than the shortest phrase are left out.  The rest is indexed; every test
phrase is searched backwards through the wavelet tree, its occurrences are located by sampled
suffix positions, and the removal spans are merged.  Documents never leave their partition.

The test set is read by the driver and sent to the tasks, in blocks of at most
``block_bytes`` of text; a larger test set takes several passes over the documents, each
adding to the spans found before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, others, with_text
from .fm_index import FMIndex
from .textbytes import ALNUM_WORDS, find_words, hash_words, text_slices, within

WINDOW = 10
#: Text bytes indexed as one shard.
SHARD_BYTES = 1 << 23
BLOCK_BYTES = 1 << 22


class Phrases:
    """The distinct test phrases as rows of word symbols, and the items that each belongs to, all in arrays.

    ``groups`` has for each length (length, symbols by phrase, first, owners): phrase p belongs to the items
    ``owners[first[p] : first[p + 1]]``, places in ``items``, which are sorted as strings.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        items = sorted(items, key=lambda x: x[0])
        self.items = list(dict.fromkeys(i for i, _ in items))
        place = {i: k for k, i in enumerate(self.items)}
        of_row = np.array([place[i] for i, _ in items], np.int32)
        data = np.frombuffer(b"".join(t or b"" for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t or b"") for _, t in items])]).astype(np.int64)
        starts, ends, first = find_words(data, offsets, ALNUM_WORDS)
        self.vocabulary, symbols = np.unique(hash_words(data, starts, ends, fold=True), return_inverse=True)
        symbols = (symbols + 1).astype(np.int32)
        counts = np.diff(first)
        self.groups = []
        for length in range(1, window + 1):
            at = within(first, window) if length == window else first[:-1][counts == length]
            if len(at):
                row = np.searchsorted(first, at, "right") - 1
                self.groups.append((length, *_distinct(symbols[at[:, None] + np.arange(length)], of_row[row])))
        self.shortest = self.groups[0][0] if self.groups else 0


def _distinct(phrases: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, where each row's owners begin, and the owners, each once a row."""
    order = np.lexsort((owners, *phrases.T[::-1]))
    phrases, owners = phrases[order], owners[order]
    new = np.ones(len(phrases), bool)
    new[1:] = (phrases[1:] != phrases[:-1]).any(1)
    once = new.copy()
    once[1:] |= owners[1:] != owners[:-1]
    first = np.append(np.flatnonzero(new[once]), once.sum())
    return phrases[new], first, owners[once]


def search_shard(symbols: np.ndarray, first_word: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Which words lie inside an occurrence of a phrase, and the (row, item) pairs that occur."""
    n = len(symbols)
    hit = np.zeros(n, bool)
    pairs: set[tuple[int, str]] = set()
    if not n or not phrases.groups:
        return hit, []
    # maximal stretches of known words inside one row
    known = symbols > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    rows = first_word[1:-1]
    rows = rows[(rows > 0) & (rows < n)]
    begin[rows] = known[rows]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    stop[rows - 1] = known[rows - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= phrases.shortest
    a, b = a[long], b[long]
    if not len(a):
        return hit, []
    sizes = b - a + 1  # with a separator after each
    ends = np.cumsum(sizes)
    place = np.repeat(a - (ends - sizes), sizes) + np.arange(ends[-1])
    text = np.where(np.arange(ends[-1]) == np.repeat(ends - 1, sizes), 0, symbols[np.minimum(place, n - 1)])
    # symbols in use, made dense
    used, dense = np.unique(np.append(text, 0), return_inverse=True)
    index = FMIndex(dense[:-1])
    edge = np.zeros(n + 1, np.int64)
    for length, pats, first_owner, owners in phrases.groups:
        at = np.minimum(np.searchsorted(used, pats), len(used) - 1)
        mine = np.where(used[at] == pats, at, -1)
        lo, hi = index.search(mine)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        count = hi[some] - lo[some]
        rows_of = np.repeat(lo[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        where = place[index.locate(rows_of)]
        which = np.repeat(some, count)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + length, -1)
        row = np.searchsorted(first_word, where, "right") - 1
        for r, p in set(zip(row.tolist(), which.tolist())):
            pairs.update((r, phrases.items[k]) for k in owners[first_owner[p] : first_owner[p + 1]].tolist())
    hit = np.cumsum(edge[:-1]) > 0
    return hit, sorted(pairs)


def _pass(phrases: Phrases, column: str, shard_bytes: int):
    """Task: adds the hit spans (byte ranges, merged) and items of these phrases to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            n_words, spans, items = [], batch.column(batch.schema.get_field_index("_hits")).to_pylist(), batch.column(batch.schema.get_field_index("_items")).to_pylist()
            shard: list[tuple] = []
            held = 0

            def close(shard):
                symbols = np.concatenate([s[2] for s in shard])
                counts = np.concatenate([np.diff(s[3]) for s in shard])
                first = np.concatenate([[0], np.cumsum(counts)])
                hit, pairs = search_shard(symbols, first, phrases)
                base = shard[0][0]
                for r, item in pairs:
                    items[base + r] = sorted({*items[base + r], item})
                if hit.any():
                    starts = np.concatenate([s[4] for s in shard])
                    ends = np.concatenate([s[5] for s in shard])
                    rows = np.repeat(np.arange(len(counts)), counts)
                    for r in np.unique(rows[hit]).tolist():
                        mine = slice(first[r], first[r + 1])
                        w = np.flatnonzero(hit[mine])
                        old = spans[base + r]
                        new = np.stack([w, starts[mine][w], ends[mine][w]], 1).reshape(-1).tolist()
                        spans[base + r] = new if not old else [x for t in sorted({*zip(old[::3], old[1::3], old[2::3]), *zip(new[::3], new[1::3], new[2::3])}) for x in t]

            for row, end, data, offsets in text_slices(batch.column(at)):
                starts, ends, first = find_words(data, offsets, ALNUM_WORDS)
                h = hash_words(data, starts, ends, fold=True)
                if len(phrases.vocabulary):
                    k = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
                    symbols = np.where(phrases.vocabulary[k] == h, k + 1, 0)
                else:
                    symbols = np.zeros(len(h), np.int64)
                n_words.append(np.diff(first))
                own = np.repeat(offsets[:-1], np.diff(first))  # spans count from the start of the row's text
                shard.append((row, end, symbols, first, starts - own, ends - own))
                held += len(data)
                if held >= shard_bytes:
                    close(shard)
                    shard, held = [], 0
            if shard:
                close(shard)
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            out |= {"_n_words": pa.array(counts, pa.int64()), "_hits": pa.array(spans, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_row (``docs``' other columns), _text (bytes), _n_words, _hits (flat word, byte start, byte end of each hit word) and _items (ids as text).

    ``benchmark``: item id, text.  Null texts have no words and match nothing; items with a null
    id are searched under the id "null"; repeated items count once; with an empty test set nothing
    is hit.  Columns of ``docs`` other than the text are carried unread, whatever their names
    (they travel in one struct).
    """
    items = benchmark.select(F.coalesce(F.col(benchmark.columns[0]).cast("string"), F.lit("null")).alias("item"), F.col(benchmark.columns[1]).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(others(docs, text_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"), F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<int>").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    for b in range(blocks):
        if b:  # a task then holds the phrases of one block only
            out = cut(out)
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else items
        phrases = Phrases([(r["item"], bytes(r["text"])) for r in block.collect()], window)
        out = out.mapInArrow(_pass(phrases, "_text", shard_bytes), out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (ids sorted as strings), contaminated.

    Null and empty texts have no words and are not contaminated; rows that share an id are told apart and judged
    alike; an item that stands twice counts once, and one of no words never.  Empty tables give no rows.
    """
    f = find_hits(docs.select(id_col, text_col), benchmark.select("item_id", "text"), text_col)
    n_hit = (F.size("_hits") / 3).cast("bigint")
    return f.select(F.col(f"_row.{id_col}").alias("doc_id"), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut_spans(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column(batch.schema.get_field_index("_text")), batch.column(batch.schema.get_field_index("_hits")).to_pylist()):
                text = text.as_py()
                if not hits:
                    texts.append(text)
                    continue
                kept, at, k = [], 0, 0
                words, starts, ends = hits[::3], hits[1::3], hits[2::3]
                while k < len(words):
                    j = k
                    while j + 1 < len(words) and words[j + 1] == words[j] + 1:
                        j += 1
                    kept.append(text[at : starts[k]])
                    at = ends[j]
                    k = j + 1
                kept.append(text[at:])
                texts.append(b"".join(kept))
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | {"_text": pa.array(texts, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the merged spans of test passages cut from the texts; all rows and columns are kept.

    A null text stays null, a text that is all passage becomes empty; what stands between two words of a passage
    goes with it.  An empty test set or table changes nothing.
    """
    f = find_hits(docs, benchmark, text_col)
    f = f.mapInArrow(_cut_spans("_text"), f.schema)
    return f.select(*with_text(docs, "_row", text_col, F.col("_text").cast("string")))

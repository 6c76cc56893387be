"""Exact top-k BM25 search with an inverted index and block-max WAND per shard.

Shards are stretches of documents inside a task; document frequencies, the number of documents
and their mean length are global, so that a score does not depend on the shard and the shards'
top lists merge exactly.  In a shard, documents are put in blocks by their most common words and length.

A query of at most ``SHORT`` terms goes by itself (``Shard``): a term's postings are
sorted by document and cut at the blocks, and every term keeps its largest impact in each of its
blocks (and, where it has many postings there, all impacts as a row).  The sum of a query's terms' maxima bounds the scores of a block.  Blocks are read
from the highest bound on; the k-th best score found so far, in this shard or those before it in
the task, is the threshold, and once the next bound is below it all further blocks are skipped
with their postings unread.  That is WAND's pivot test for a block of documents at a time instead
of one, which numpy does for all terms at once.

Longer queries, whose bounds hardly ever fall below the threshold, go together (``Block``): those
alike are a batch, and a batch meets a block of ``DOCS`` documents at once.  The block's maxima tell
which queries of the batch can be skipped.  For the others, the terms that many queries and
documents have are one matrix product, and the postings of the rest are added to it.  Only
documents that reach a query's threshold are scored exactly.

Queries are a stated set; those with the same terms are searched once.  They go to the tasks in blocks of at most
``BLOCK_TERMS`` terms, each block being one pass over the documents.  Where shards are many, one document in ``EARLY`` is searched
first: the k-th best scores are thresholds for all other tasks, so that what these return follows
the queries and not queries times tasks.  A block's results are written before the next is sent,
so the driver never holds more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textbytes import ALNUM_WORDS, U64, find_words, hash_words, text_slices

K1, B = 1.2, 0.75
#: Text bytes of a shard, documents of a block, and blocks read before the threshold is looked at first; then twice as many each time.
SHARD_BYTES, BLOCK, FIRST = 1 << 25, 64, 16
#: Postings of a term in a block from which they are kept as a row; scores from rows are within SLACK of the exact ones, or
#: within ROUNDING times the query's terms if that is more: a sum of n positive float32 products is off by (n + 3) / 2^24 of it at most.
HEAVY, SLACK, ROUNDING = 8, 1e-4, 2.0**-23
#: Most common words by which documents are put side by side.
ALIKE = 4
#: Terms of a query that goes by itself; queries of a batch and documents of a block of the longer ones.
SHORT, QUERIES, DOCS = 4, 256, 2048
#: A term of a batch and a block goes into the matrix product if one in so many pairs of a query and a document share it,
#: and if one in so many of the block's documents has it.
SHARED, COMMON = 600, 50
#: Postings that are added at once; queries, and pairs of a query and a document, whose exact scores are found at once.
PIECE, TOGETHER, PAIRS = 1 << 16, 16, 256
#: One in so many documents is searched before the others.
EARLY = 16
BLOCK_TERMS = 16_000_000


def _by_row(r: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Order by row and term."""
    if n_rows <= 1 << 16:
        key = (r.astype(U64) << U64(48)) | (h >> U64(16))
        order = np.argsort(key)
        key, low = key[order], h[order]
        if not ((key[1:] == key[:-1]) & (low[1:] != low[:-1])).any():
            return order
    return np.lexsort((h, r))


def _terms(column: pa.Array):
    """(first row, words per row, row of each distinct term, term, times) slice by slice."""
    for row, end, data, offsets in text_slices(column):
        starts, ends, first = find_words(data, offsets, ALNUM_WORDS)
        h = hash_words(data, starts, ends, fold=True)
        n = np.diff(first)
        r = np.repeat(np.arange(len(n)), n)
        order = _by_row(r, h, len(n))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        yield row, n, r[at], h[at], np.diff(np.append(at, len(h)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (term, documents with it) over this stretch; term null carries the documents and words."""
    for batch in batches:
        words, found = 0, []
        for _, n, _, h, _ in _terms(batch.column(0)):
            words += int(n.sum())
            found.append(h)
        terms, df = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
        last = np.arange(len(df) + 1) == len(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(terms.view(np.int64), 0), mask=last), "df": pa.array(np.append(df, batch.num_rows)), "words": pa.array(last * np.int64(words))})


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the distinct terms of each query."""
    for batch in batches:
        ids = batch.column(0)
        for row, n, r, h, _ in _terms(batch.column(1)):
            ends = np.searchsorted(r, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"query_id": ids.slice(row, len(n)), "terms": pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))})


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, end), one range after the other."""
    size = end - first
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Shard:
    """The inverted index of some documents over the terms of a block of queries.

    A run is the postings of one term in one block.  Runs of few postings stand by term; those of
    ``HEAVY`` and more stand by block as rows of one impact a document.
    """

    def __init__(self, parts: list[tuple], n_terms: int, mean_length: float):
        ids = np.concatenate([p[0] for p in parts])
        length = np.concatenate([p[1] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        doc = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        term, times = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        # documents with the same most common words (which tell the language) side by side, and then by length:
        # a block's documents have like terms and impacts, so that its bound is near their scores
        often = np.bincount(term, minlength=n_terms)
        by_doc = np.lexsort((-often[term], doc))
        end = np.searchsorted(doc[by_doc], np.arange(len(length) + 1))
        ranked = np.append(term[by_doc], -1)
        common = [np.where(end[:-1] + j < end[1:], ranked[np.minimum(end[:-1] + j, len(term))], -1) for j in range(ALIKE)]
        order = np.lexsort((length, *common[::-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, length, doc = ids[order], length[order], place[doc]
        self.n_blocks = -(-len(order) // BLOCK)
        impact = times * (K1 + 1) / (times + (K1 * (1 - B + B * length / max(mean_length, 1e-9)))[doc])
        # by document, for the exact scores
        by_doc = np.lexsort((term, doc))
        self.d_term, self.d_impact = term[by_doc], impact[by_doc]
        self.d_first = np.searchsorted(doc[by_doc], np.arange(len(order) + 1))
        by_term = np.lexsort((doc, term))
        term, doc, impact = term[by_term], doc[by_term], impact[by_term]
        block = doc // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(term)))
        most = np.maximum.reduceat(impact, at) if len(at) else np.zeros(0)
        few = np.flatnonzero(size < HEAVY)
        p = _ranges(at[few], at[few] + size[few])
        self.impact, self.lane = impact[p], (doc[p] % BLOCK).astype(np.int32)
        self.run = np.append(0, np.cumsum(size[few]))
        self.block, self.most = block[at[few]], most[few]
        self.first = np.searchsorted(term[at[few]], np.arange(n_terms + 1))
        many = np.flatnonzero(size >= HEAVY)
        many = many[np.argsort(block[at[many]], kind="stable")]
        p = _ranges(at[many], at[many] + size[many])
        self.rows = np.zeros((len(many), BLOCK), np.float32)
        self.rows[np.repeat(np.arange(len(many)), size[many]), doc[p] % BLOCK] = impact[p]
        self.row_term, self.row_most, self.row_block = term[at[many]], most[many], block[at[many]]
        self.row_first = np.searchsorted(self.row_block, np.arange(self.n_blocks + 1))
        self.weight = np.zeros(n_terms)  # the query's, at its terms
        self.read = self.skipped = 0

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all documents that may be among the best k (ties at the k-th included) and reach ``least``."""
        self.weight[terms] = weights
        slack = max(SLACK, ROUNDING * len(terms))
        heavy = self.weight[self.row_term]
        a, b = self.first[terms], self.first[terms + 1]
        runs, w = _ranges(a, b), np.repeat(weights, b - a)
        block = self.block[runs]
        bound = np.bincount(block, weights=self.most[runs] * w, minlength=self.n_blocks) + np.bincount(self.row_block, weights=self.row_most * heavy, minlength=self.n_blocks)
        bound = bound * (1 + slack)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        heavy = heavy.astype(np.float32)
        docs, near, at, many, low = np.zeros(0, np.int64), np.zeros(0), 0, FIRST, least * (1 - slack)
        while at < len(order) and bound[order[at]] >= low:
            some = order[at : at + many]
            some = some[bound[some] >= low]
            slot = np.full(self.n_blocks, -1, np.int32)
            slot[some] = np.arange(len(some), dtype=np.int32) * BLOCK
            of = slot[block]
            mine = np.flatnonzero(of >= 0)
            begin = self.run[runs[mine]]
            size = self.run[runs[mine] + 1] - begin
            p = _ranges(begin, begin + size)
            total = np.bincount(np.repeat(of[mine], size) + self.lane[p], weights=self.impact[p] * np.repeat(w[mine], size), minlength=len(some) * BLOCK).astype(np.float64)
            for j, (x, y) in enumerate(zip(self.row_first[some].tolist(), self.row_first[some + 1].tolist())):
                total[j * BLOCK : (j + 1) * BLOCK] += heavy[x:y] @ self.rows[x:y]
            good = np.flatnonzero(total >= max(low, 1e-300))
            docs, near = np.concatenate([docs, some[good // BLOCK] * BLOCK + good % BLOCK]), np.concatenate([near, total[good]])
            at += len(some)
            many *= 2
            if len(near) >= k:
                low = max(low, np.partition(near, len(near) - k)[len(near) - k] * (1 - 2 * slack))
                docs, near = docs[near >= low], near[near >= low]
        self.read += at
        self.skipped += len(order) - at
        # the exact scores, added up in the order of terms
        size = self.d_first[docs + 1] - self.d_first[docs]
        p = _ranges(self.d_first[docs], self.d_first[docs + 1])
        scores = np.bincount(np.repeat(np.arange(len(docs)), size), weights=self.d_impact[p] * self.weight[self.d_term[p]], minlength=len(docs))
        self.weight[terms] = 0
        return self.ids[docs], scores


def _alike(term: np.ndarray, first: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Sort keys, last one first: the most common terms of each row, which has one at least; ``rank`` is 0 for the most common of all."""
    r = rank[term]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = []
    for _ in range(ALIKE):
        least = np.minimum.reduceat(r, first[:-1])
        keys.append(least)
        r[r == least[row]] = len(rank)
    return keys[::-1]


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k rows of each query, by query, score and id."""
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


class Queries:
    """A block of queries: ``weight`` by term, and the terms of query i at ``cuts[i]`` to ``cuts[i + 1]``."""

    def __init__(self, cuts: np.ndarray, terms: np.ndarray, weight: np.ndarray):
        self.cuts, self.terms, self.weight = cuts, terms, weight
        self.size = np.diff(cuts)
        self.slack = np.maximum(SLACK, ROUNDING * self.size)

    def of(self, i: int) -> np.ndarray:
        return self.terms[self.cuts[i] : self.cuts[i + 1]]


class Block:
    """The postings of some documents by term, their impacts times the term's weight; common terms as rows, too."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int, slot: np.ndarray):
        order = np.argsort(term.astype(np.int64) * n_docs + doc)
        self.doc, self.value, term = doc[order].astype(np.uint16), value[order], term[order]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.terms, self.first, self.n_docs = term[at], np.append(at, len(term)), n_docs
        self.most = np.maximum.reduceat(self.value, at)
        self.size = np.diff(self.first)
        often = np.flatnonzero(self.size * COMMON >= n_docs)
        p = _ranges(self.first[often], self.first[often + 1])
        self.row = np.full(len(at), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n_docs), np.float32)
        self.rows[np.repeat(np.arange(len(often)), self.size[often]), self.doc[p]] = self.value[p]
        self.slot = slot  # place of a term here, or -1

    def scores(self, queries: Queries, begin: int, end: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries among begin to end whose bound reaches ``low``, and a row of scores for each, within their slack."""
        n = end - begin
        at = self.slot[queries.terms[queries.cuts[begin] : queries.cuts[end]]]
        row = np.repeat(np.arange(n), queries.size[begin:end])
        here = np.flatnonzero(at >= 0)
        at, row = at[here], row[here]
        bound = np.bincount(row, weights=self.most[at], minlength=n) * (1 + queries.slack[begin:end])
        alive = (bound > 0) & (bound >= low[begin:end])
        left = np.flatnonzero(alive)
        if len(left) < n:
            here = alive[row]
            at, row = at[here], (np.cumsum(alive) - 1)[row[here]]
        asked = np.bincount(at, minlength=len(self.terms))
        dense = (self.row >= 0) & (asked * self.size * SHARED > len(left) * self.n_docs)
        place = np.cumsum(dense) - 1
        on = dense[at]
        has = np.zeros((len(left), int(dense.sum())), np.float32)
        has[row[on], place[at[on]]] = 1
        total = has @ self.rows[self.row[dense]]
        at, row = at[~on], row[~on]
        a, size = self.first[at], self.size[at]
        held = np.cumsum(size)
        x = 0
        for y in np.searchsorted(held, np.arange(PIECE, held[-1] + PIECE, PIECE)) + 1 if len(held) else ():
            p = _ranges(a[x:y], a[x:y] + size[x:y])
            cell = np.repeat(row[x:y] * self.n_docs, size[x:y])
            cell += self.doc[p]
            np.add.at(total.reshape(-1), cell, self.value[p])
            x = y
        return left + begin, total


class Stretch:
    """A shard's documents for queries that go together."""

    def __init__(self, parts: list[tuple], weight: np.ndarray, mean_length: float):
        ids, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        doc = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        self.term, self.times = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        # only documents with a known term; postings come by document and term
        size = np.bincount(doc, minlength=len(ids))
        known = np.flatnonzero(size)
        self.ids, length, self.first = ids[known], length[known], np.append(0, np.cumsum(size[known]))
        self.norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        self.weight = weight
        often = np.bincount(self.term, minlength=len(weight))
        rank = np.empty(len(weight), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(weight))
        self.order = np.lexsort((length, *_alike(self.term, self.first, rank))) if len(known) else known

    def _impact(self, p: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Impacts of some postings, given the document of each."""
        times = self.times[p]
        return times * (K1 + 1) / (times + self.norm[docs])

    def blocks(self) -> Iterator[tuple[np.ndarray, Block]]:
        slot = np.full(len(self.weight), -1, np.int32)
        for begin in range(0, len(self.order), DOCS):
            docs = self.order[begin : begin + DOCS]
            a, b = self.first[docs], self.first[docs + 1]
            p, at = _ranges(a, b), np.repeat(np.arange(len(docs)), b - a)
            term = self.term[p]
            block = Block(at, term, (self._impact(p, docs[at]) * self.weight[term]).astype(np.float32), len(docs), slot)
            slot[block.terms] = np.arange(len(block.terms), dtype=np.int32)
            yield docs, block
            slot[block.terms] = -1

    def top(self, queries: Queries, which: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all documents that may be among the best k (ties at the k-th included) and reach ``least``, for the queries which[0] to which[1]."""
        low = np.maximum(least * (1 - queries.slack), 1e-300)
        found = []
        for docs, block in self.blocks():
            for begin in range(which[0], which[1], QUERIES):
                some, total = block.scores(queries, begin, min(begin + QUERIES, which[1]), low)
                if not len(some):
                    continue
                n = total.shape[1]
                hit = np.flatnonzero(total >= low[some].astype(np.float32)[:, None])
                many = np.flatnonzero(np.bincount(hit // n, minlength=len(some)) > 4 * k)
                if len(many):
                    kth = np.partition(total[many], n - k, axis=1)[:, n - k]
                    low[some[many]] = np.maximum(low[some[many]], kth * (1 - 2 * queries.slack[some[many]]))
                    hit = hit[total.reshape(-1)[hit] >= low[some].astype(np.float32)[hit // n]]
                found.append((some[hit // n], docs[hit % n], total.reshape(-1)[hit]))
        q, docs, near = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))
        order = np.lexsort((-near, q))
        q, docs, near = q[order], docs[order], near[order]
        begin, end = np.searchsorted(q, q), np.searchsorted(q, q, "right")
        kth = np.where(end - begin >= k, near[np.minimum(begin + k, end) - 1], 0)
        good = near >= np.maximum(low[q], kth * (1 - 2 * queries.slack[q]))
        q, docs = q[good], docs[good]
        return q, self.ids[docs], self._exact(queries, q, docs)

    def _exact(self, queries: Queries, q: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of pairs that are sorted by query, added up in the order of terms."""
        scores, has = np.zeros(len(q)), np.zeros((TOGETHER, len(self.weight)), bool)
        begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
        for x in range(0, len(begins), TOGETHER):
            some = q[begins[x : x + TOGETHER]]
            begin, end = begins[x], begins[x + TOGETHER] if x + TOGETHER < len(begins) else len(q)
            at = np.repeat(np.arange(len(some)), queries.size[some]), queries.terms[_ranges(queries.cuts[some], queries.cuts[some + 1])]
            has[at] = True
            for y in range(begin, end, PAIRS):
                z = min(y + PAIRS, end)
                a, b = self.first[docs[y:z]], self.first[docs[y:z] + 1]
                p = _ranges(a, b)
                mine = np.flatnonzero(has.reshape(-1)[np.repeat(np.searchsorted(some, q[y:z]) * len(self.weight), b - a) + self.term[p]])
                pair, p = np.searchsorted(np.cumsum(b - a), mine, "right"), p[mine]
                scores[y:z] = np.bincount(pair, weights=self._impact(p, docs[y:z][pair]) * self.weight[self.term[p]], minlength=z - y)
            has[at] = False
        return scores


def _search(said, floor, k: int, mean_length: float, shard_bytes: int):
    """Task: its best k documents for every query of the block, of those that reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, cuts, terms, n_short = said.value[:5]
        queries = Queries(cuts, terms, weight)
        short = np.unique(terms[: cuts[n_short]])
        least = np.zeros(len(cuts) - 1) if floor is None else floor.value.copy()
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        parts: list[tuple] = []
        held = 0

        def close():
            nonlocal best
            more = [best]
            if len(cuts) - 1 > n_short:
                more.append(Stretch(parts, weight, mean_length).top(queries, (n_short, len(cuts) - 1), k, least))
            if n_short:
                few = []
                for p in parts:
                    at = np.minimum(np.searchsorted(short, p[3]), len(short) - 1)
                    mine = short[at] == p[3]
                    few.append((p[0], p[1], p[2][mine], at[mine], p[4][mine]))
                shard = Shard(few, len(short), mean_length)
                for i in range(n_short):
                    ids, scores = shard.top(np.searchsorted(short, queries.of(i)), weight[queries.of(i)], k, least[i])
                    more.append((np.full(len(ids), i), ids, scores))
            q, ids, scores = (np.concatenate([m[j] for m in more]) for j in range(3))
            order = _best(q, ids, scores, k)
            best = q, ids, scores = q[order], ids[order], scores[order]
            last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, np.int64)
            last = last[np.diff(np.append(-1, last)) == k]
            least[q[last]] = np.maximum(least[q[last]], scores[last])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, n, r, h, times in _terms(batch.column(1)):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                parts.append((ids[row : row + len(n)], n, r[known].astype(np.int32), at[known].astype(np.int32), times[known].astype(np.int32)))
                held += int(n.sum()) * 6
                if held >= shard_bytes:
                    close()
                    parts, held = [], 0
        if parts:
            close()
        yield pa.RecordBatch.from_pydict({"query": pa.array(best[0], pa.int32()), "doc_id": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})

    return run


def _spread(said):
    """Task: the rows of a query for all queries that have its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first = said.value[5:]
        for batch in batches:
            q = batch.column(0).to_numpy()
            a, b = first[q], first[q + 1]
            at = pa.array(np.repeat(np.arange(len(q)), b - a))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[_ranges(a, b)], pa.int64()), **{c: batch.column(c).take(at) for c in ("rank", "doc_id", "score")}})

    return run


def _block(asked: pa.Table, words: pa.Table) -> tuple | None:
    """What tasks are told of queries (query_id, terms): vocabulary, its weights, the distinct sets of terms (cuts, terms, how many
    are short), and the ids that have each (ids, cuts).  Short sets come first, then those alike side by side."""
    order = np.argsort(words["term"].to_numpy().view(U64))
    vocabulary, weight = words["term"].to_numpy().view(U64)[order], words["weight"].to_numpy()[order]
    if not len(vocabulary):
        return None
    places, ids, sets = {}, [], []
    for batch in asked.to_batches():
        terms, ends = batch.column(1).flatten().to_numpy().view(U64), batch.column(1).offsets.to_numpy()
        ends = ends - ends[0]
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = vocabulary[at] == terms
        at, ends = at[known].astype(np.int32), np.append(0, np.cumsum(known))[ends]
        for i, query_id in enumerate(batch.column(0).to_pylist()):
            mine = at[ends[i] : ends[i + 1]]
            if len(mine):
                place = places.setdefault(hashlib.blake2b(mine, digest_size=16).digest(), len(sets))
                if place == len(sets):
                    sets.append(mine.copy())
                ids.append((query_id, place))
    if not sets:
        return None
    size = np.array([len(x) for x in sets])
    rank = np.empty(len(weight), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(weight))
    order = np.lexsort((size, *_alike(np.concatenate(sets), np.append(0, np.cumsum(size)), rank), size > SHORT))
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    who, place = np.array([i for i, _ in ids]), new[[p for _, p in ids]]
    by = np.lexsort((who, place))
    return vocabulary, weight, np.append(0, np.cumsum(size[order])), np.concatenate([sets[i] for i in order]), int((size <= SHORT).sum()), who[by], np.searchsorted(place[by], np.arange(len(order) + 1))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by BM25; ties go to the smaller id.

    ``queries``: id, text.  A query's distinct words count once each; words are digits, letters
    and everything beyond ASCII, A-Z lower-cased.  Documents that share no word with a query are
    not listed; null and empty texts neither find nor are found; rows with a null id are left
    out; repeated rows are listed alike, each; of several texts of one query the least is taken;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    seen = d.select("text").mapInArrow(_frequencies, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    seen = cut(seen)
    total = seen.where("term is null").first()
    n_docs, n_words = (total["df"], total["words"]) if total else (0, 0)
    asked = queries.select(F.col(queries.columns[0]).cast("long").alias("query_id"), F.col(queries.columns[1]).cast("binary").alias("text")).where("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))
    q = cut(asked.mapInArrow(_query_terms, "query_id long, terms array<long>").where(F.size("terms") > 0))
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    n_terms = q.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n_terms // block_terms))
    mean_length, shards = n_words / max(1, n_docs), (n_words or 0) * 6 // shard_bytes
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    found = []

    def search(some: DataFrame, said, floor) -> DataFrame:
        return some.mapInArrow(_search(said, floor, k, mean_length, shard_bytes), "query int, doc_id long, score double")

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    for b in range(blocks):
        mine = q.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b)
        words = mine.select(F.explode("terms").alias("term")).distinct().join(seen.where("term is not null").select("term", "df"), "term")
        told = _block(mine.toArrow(), words.select("term", idf.alias("weight")).toArrow())  # columns, not rows: a block is bounded by block_terms
        if told is None:
            continue
        said, floor = spark.sparkContext.broadcast(told), None
        if shards >= EARLY:
            early = F.pmod(F.xxhash64("doc_id"), F.lit(EARLY)) == 0
            first = cut(ranked(search(d.where(early).repartition(int(-(-shards // EARLY))), said, None)))
            kth = first.where(F.col("rank") == k).select("query", "score").toArrow()
            least = np.zeros(len(told[2]) - 1)
            least[kth["query"].to_numpy()] = kth["score"].to_numpy()
            floor = spark.sparkContext.broadcast(least)
            part = search(d.where(~early), said, floor).unionByName(first.drop("rank"))
        else:
            part = search(d, said, None)
        rows = ranked(part).select("query", "rank", "doc_id", "score").mapInArrow(_spread(said), "query_id long, rank int, doc_id long, score double")
        found.append(cut(rows))  # written now, so that the block's terms can be let go
        for sent in (said, floor):
            if sent is not None:
                sent.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return reduce(DataFrame.unionByName, found)

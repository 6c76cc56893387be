"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. One pass over the texts gives every document its distinct word shingles' count, a 128-bit
   hash of the set and ``TREES * DEPTH`` minimum hashes.  Equal sets collapse to the smallest id.
2. Each of the ``TREES`` groups of minima is one sorted order of the distinct sets, dealt by
   range, so even a region that a third of all rows share is spread over many tasks.  Candidates
   are neighbours whose longest common prefix is at least ``MIN_PREFIX`` minima.  A region too
   large for its neighbours to cover gets a centre - the set that agrees best with the region's
   most frequent minima - which is compared with all its members; what the centre does not
   cover is split by one more minimum, so that the depth adapts to the region.
3. Members of large regions, and of regions that a task's edge may cut, also go through a prefix
   filter without a cap: their shingles are ordered by how many members hold them, the rarest
   first, and two sets that reach the similarity share one of their first shingles.  Pairs across
   components that share one, and whose lengths, places of it and minima allow the similarity,
   are candidates, however many they are.
4. Candidates are confirmed on full sets of 64-bit shingle hashes, the best of each document
   first; pairs that the links found so far already connect need no confirmation.  The texts
   of all that is named by a candidate move once, and their sets are kept for every confirmation.
5. Components are found by alternating large-star and small-star steps.

Of the forest no pair of a group becomes a row beyond a fixed number of neighbours a document and order
and one centre a region and depth; of the prefix filter only pairs that may still be links do.  No document is left out, and nothing of the corpus is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup
from .textbytes import SPACE_WORDS, U64, find_words, hash_words, mix, text_slices, within

TREES, DEPTH, MIN_PREFIX = 12, 6, 3
#: Following neighbours in each order that a document is compared with.
NEIGHBOURS = 8
#: Bytes of the sketch (one a minimum hash) and the share of agreements, below the similarity asked for,
#: under which a candidate is not worth a confirmation: over six standard deviations for 72 hashes.
SKETCH, SLACK = TREES * DEPTH, 0.27
#: In large regions each set is also compared, by sketch, with the others of its stretch of BLOCK rows of
#: the order, and its BEST nearest of them are candidates too; the stretches differ from order to order.
BLOCK, BEST = 512, 2

#: Buckets of the table of shingle counts by which the prefix filter orders shingles, and the count from which one matters.
#: Any order gives the same pairs; a good one gives them at less cost.
BUCKETS, COMMON = 1 << 20, 8
#: Holders of one shingle that a task compares with each other; those of a more common one are dealt over several tasks.
HOLDERS = 2048

def least_agreements(percent: int) -> int:
    return int(SKETCH * (percent / 100 - SLACK))


def least_bits(percent: int) -> int:
    """Of 64 one-bit minima a pair at the similarity agrees in (1 + similarity) / 2; 6.5 standard deviations less are still compared."""
    p = (1 + percent / 100) / 2
    return int(64 * p - 6.5 * (64 * p * (1 - p)) ** 0.5)


_SALTS = np.random.default_rng(3).integers(1, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = [U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row by row, and where each row's begin (length rows + 1)."""
    starts, ends, first = find_words(data, offsets, SPACE_WORDS)
    h = hash_words(data, starts, ends, fold=True)
    counts = np.diff(first)
    at = within(first, width)
    hashes = [sum((h[at + k] * _STEP[k % 5] + U64(k) for k in range(width)), np.zeros(len(at), U64))]
    rows = [np.searchsorted(first, at, "right") - 1]
    for n in range(1, width):  # fewer words: the whole sequence is one shingle
        few = np.flatnonzero(counts == n)
        hashes.append(sum((h[first[few] + k] * _STEP[k % 5] + U64(k) for k in range(n)), np.full(len(few), 977 * n, U64)))
        rows.append(few)
    key, row = mix(np.concatenate(hashes)), np.concatenate(rows)
    n_rows = len(offsets) - 1
    bits = max(1, int(n_rows).bit_length())
    order = np.argsort((row.astype(U64) << U64(64 - bits)) | (key >> U64(bits)), kind="stable")
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(n_rows + 1))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in text_slices(batch.column(1)):
                sets, first = shingle_sets(data, offsets, width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                low, high = np.zeros(len(n), U64), np.zeros(len(n), U64)
                sig = np.zeros((len(n), TREES * DEPTH), np.uint32)
                if len(some):
                    cuts = first[some]
                    low[some] = np.add.reduceat(mix(sets + U64(1)), cuts)
                    high[some] = np.add.reduceat(mix(sets ^ U64(0x5851F42D4C957F2D)), cuts)
                    for k, salt in enumerate(_SALTS):
                        sig[some, k] = np.minimum.reduceat((sets * salt) >> U64(32), cuts)
                wide = sig.astype(">u4").tobytes()
                size = TREES * DEPTH * 4
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(row, end - row),
                        "n": pa.array(n, pa.int64()),
                        "s1": pa.array(low.view(np.int64)),
                        "s2": pa.array(high.view(np.int64)),
                        "sig": pa.array([wide[i : i + size] for i in range(0, len(wide), size)], pa.binary()),
                    }
                )

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for each sorted order: tree, prefix (its minima, big-endian), doc_id, n, sketch."""
    for batch in batches:
        ids, sizes = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 2048):
            sigs = batch.column(2).slice(at, 2048).to_pylist()
            m = np.frombuffer(b"".join(sigs), ">u4").reshape(len(sigs), TREES * DEPTH)
            sketch = (m[:, :SKETCH] & 0xFF).astype(np.uint8).tobytes()
            sketches = [sketch[i : i + SKETCH] for i in range(0, len(sketch), SKETCH)]
            for t in range(TREES):
                part = m[:, t * DEPTH : (t + 1) * DEPTH].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(np.full(len(sigs), t, np.int32)),
                        "prefix": pa.array([part[i : i + DEPTH * 4] for i in range(0, len(part), DEPTH * 4)], pa.binary()),
                        "doc_id": ids.slice(at, 2048),
                        "n": sizes.slice(at, 2048),
                        "sketch": pa.array(sketches, pa.binary()),
                    }
                )


def _nearest(sketch: np.ndarray, lo: int, hi: int, least: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Of each stretch of rows [lo, hi): every row with its nearest others, by sketch."""
    for a in range(lo, hi, BLOCK):
        part = sketch[a : min(hi, a + BLOCK)]
        n = len(part)
        if n < 2:
            continue
        agree = np.zeros((n, n), np.uint8)
        for column in part.T:
            agree += column[:, None] == column[None, :]
        np.fill_diagonal(agree, 0)
        k = min(BEST, n - 1)
        top = np.argpartition(agree, n - k, axis=1)[:, n - k :]
        i, j = np.repeat(np.arange(n), k), top.reshape(-1)
        good = agree[i, j] >= least
        out.append((a + i[good], a + j[good]))


def _centres(prefix: np.ndarray, sketch: np.ndarray, lo: int, hi: int, depth: int, least: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Compares the centre of rows [lo, hi), alike in ``depth`` minima, with all of them; then goes deeper."""
    while hi - lo > NEIGHBOURS + 1:
        part = sketch[lo:hi]
        common = np.array([np.bincount(c, minlength=256).argmax() for c in part.T], np.uint8)
        centre = lo + int((part == common).sum(1).argmax())
        alike = (part == sketch[centre]).sum(1) >= least
        alike[centre - lo] = False
        members = lo + np.flatnonzero(alike)
        out.append((np.full(len(members), centre), members))
        if depth == prefix.shape[1]:
            return
        steps = np.flatnonzero(prefix[lo + 1 : hi, depth] != prefix[lo : hi - 1, depth]) + lo + 1
        depth += 1
        if len(steps):
            for a, b in zip([lo, *steps.tolist()], [*steps.tolist(), hi]):
                _centres(prefix, sketch, a, b, depth, least, out)
            return


def _candidates(percent: int):
    """Task over one stretch of the sorted orders: candidate pairs (a, b, agreements), a < b.

    Of small regions all neighbours, of large ones each set's nearest and the centres at every depth.
    Members of large regions, and of the first and the last region of a batch, which may go on
    elsewhere, are told as (a, a, -1).
    """
    least = least_agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False)
            prefix = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            n = batch.column(3).to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)
            if tail is not None:  # the last rows of the batch before stay neighbours
                tree, prefix, ids, n, sketch = (np.concatenate(x) for x in zip(tail, (tree, prefix, ids, n, sketch)))
            same = (tree[1:] == tree[:-1]) & (prefix[1:, :MIN_PREFIX] == prefix[:-1, :MIN_PREFIX]).all(1)
            region = np.concatenate([[0], np.cumsum(~same)])
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(region)]])
            large = np.flatnonzero(np.diff(edges) > NEIGHBOURS + 1)
            in_large = np.isin(region, large)
            pairs = []
            for w in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero((region[w:] == region[:-w]) & ~in_large[w:]) if w < len(region) else np.zeros(0, np.int64)
                pairs.append((i, i + w))
            for a, b in zip(edges[large].tolist(), edges[large + 1].tolist()):
                _centres(prefix, sketch, a, b, MIN_PREFIX, least, pairs)
                _nearest(sketch, a, b, least, pairs)
            told = np.unique(ids[in_large | (region == 0) | (region == region[-1])])
            yield pa.RecordBatch.from_pydict({"a": pa.array(told, pa.int64()), "b": pa.array(told, pa.int64()), "agree": pa.array(np.full(len(told), -1, np.int32))})
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            ok = (ids[i] != ids[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            found = []
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                agree = (sketch[p] == sketch[q]).sum(1)
                good = agree >= least
                a, b = ids[p[good]], ids[q[good]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), agree[good]], 1))
            keep = min(len(ids), NEIGHBOURS)
            tail = tuple(x[len(x) - keep :] for x in (tree, prefix, ids, n, sketch))
            if found:
                rows = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pa.array(rows[:, 0], pa.int64()), "b": pa.array(rows[:, 1], pa.int64()), "agree": pa.array(rows[:, 2].astype(np.int32))})

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(1)):
                sets, first = shingle_sets(data, offsets, width)
                raw, cuts = sets.tobytes(), (first * 8).tolist()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(row, end - row), "shingles": pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(a, b) links -> (node, component) with the smallest node of each component, by alternating large and small stars.

    After a given number of ``rounds`` nodes with one label are in one component, though a component
    may still have several labels.
    """
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)  # links are few and narrow
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().coalesce(parts))
    before, k = None, 0
    while rounds is None or k < rounds:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct().coalesce(parts))
        if rounds is None:
            now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
            if before == now:
                break
            before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree) of the sets (doc_id, n, sig): pairs, and as (a, a, -1) the members of large regions."""
    trees = reps.select("doc_id", "n", "sig").mapInArrow(_trees, "tree int, prefix binary, doc_id long, n long, sketch binary")
    parts = max(8, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    orders = trees.repartitionByRange(parts, "tree", "prefix", "doc_id").sortWithinPartitions("tree", "prefix", "doc_id")
    return orders.mapInArrow(_candidates(percent), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's sets hold a shingle of each bucket."""
    table = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, _ in text_slices(batch.column(0)):
            table += np.bincount((data.view(U64) % U64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    some = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "held": pa.array(table[some])})


def _prefixes(percent: int, held: np.ndarray):
    """Each set's first shingles, rarest first, as far as one that a partner shares may be the first shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(3)):
                sets, first = data.view(U64), offsets // 8
                n = np.diff(first)
                of = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((sets, held[(sets % U64(BUCKETS)).astype(np.int64)], of))
                place = np.arange(len(sets)) - first[of]
                keep = 100 * (n[of] - place) >= percent * n[of]
                of, place, sets = of[keep], place[keep], sets[order][keep]
                minima = np.frombuffer(b"".join(batch.column(2).slice(row, end - row).to_pylist()), ">u4").reshape(-1, TREES * DEPTH)
                bits = np.packbits((minima[:, :64] & 1).astype(np.uint8), axis=1).view(np.int64).reshape(-1)
                ids, groups = (batch.column(k).slice(row, end - row).to_numpy(zero_copy_only=False) for k in (0, 1))
                for at in range(0, len(of), 1 << 16):
                    o, w = of[at : at + (1 << 16)], place[at : at + (1 << 16)]
                    index = (n[o] - w) * (100 + percent) >= 2 * percent * n[o]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shingle": pa.array(sets[at : at + (1 << 16)].view(np.int64)),
                            "doc_id": pa.array(ids[o], pa.int64()),
                            "component": pa.array(groups[o], pa.int64()),
                            "n": pa.array(n[o].astype(np.int32)),
                            "place": pa.array(w.astype(np.int32)),
                            "index": pa.array(index),
                            "bits": pa.array(bits[o]),
                        }
                    )

    return run


def _sharing(percent: int):
    """Task over holders by shingle, unit and length: all pairs across components that may reach the similarity."""
    least = least_bits(percent)

    def pairs(shingle, unit, n, place, doc, group, bits):
        new = np.ones(len(n), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (unit[1:] != unit[:-1])
        begin = np.flatnonzero(new)
        stop = np.repeat(np.append(begin[1:], len(n)), np.diff(np.append(begin, len(n))))
        rest, i, w, found, many = n - place, np.arange(len(n)), 0, [], 0
        while len(i):
            w += 1
            i = i[i + w < stop[i]]
            i = i[100 * n[i] >= percent * n[i + w]]  # lengths grow: further ones are too long, too
            j = i + w
            ok = ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (n[i] + n[j])) & (group[i] != group[j])
            a, b = i[ok], j[ok]
            near = np.bitwise_count(~(bits[a] ^ bits[b]).view(U64)) >= least
            a, b = doc[a[near]], doc[b[near]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            many += len(a)
            if many > 1 << 18:
                yield np.unique(np.concatenate(found), axis=0)
                found, many = [], 0
        if many:
            yield np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None

        def whole(parts):
            for rows in pairs(*(np.concatenate(c) for c in zip(*parts))):
                yield pa.RecordBatch.from_pydict({"a": pa.array(rows[:, 0], pa.int64()), "b": pa.array(rows[:, 1], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            own = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cutoff = len(own) - int(own[::-1].argmin() if not own.all() else len(own))  # the last group may go on
            if cutoff or last != (cols[0][-1], cols[1][-1]):
                if parts := held + ([tuple(c[:cutoff] for c in cols)] if cutoff else []):
                    yield from whole(parts)
                held = []
            held.append(tuple(c[cutoff:] for c in cols))
            last = (cols[0][-1], cols[1][-1])
        if held:
            yield from whole(held)

    return run


def sharing(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the members (doc_id, component, sig), in different components, that neither a prefix filter nor their sketches rule out."""
    spark = sets.sparkSession
    own = members.join(sets, "doc_id").select("doc_id", "component", "sig", "shingles")
    counted = own.select("shingles").mapInArrow(_counts, "bucket int, held long").groupBy("bucket").agg(F.sum("held").alias("held")).where(F.col("held") >= COMMON).toPandas()
    held = np.zeros(BUCKETS, np.int64)
    held[counted["bucket"].to_numpy(np.int64)] = counted["held"].to_numpy(np.int64)
    rows = cut(own.mapInArrow(_prefixes(percent, held), "shingle long, doc_id long, component long, n int, place int, index boolean, bits long"))
    # a common shingle's holders are dealt over units; those outside its largest component, or those that may be the smaller set, go to all
    each = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("rows"), F.count_if("index").alias("small"))
    common = (
        each.groupBy("shingle")
        .agg(F.sum("rows").alias("all"), F.sum("small").alias("small"), F.max("rows").alias("most"), F.max_by("component", "rows").alias("main"))
        .where(F.col("all") > HOLDERS)
    )
    common = cut(common.select("shingle", F.ceil(F.col("all") / HOLDERS).cast("int").alias("units"), "main", (F.col("all") - F.col("most") < F.col("small")).alias("by_main"), (F.least(F.col("all") - F.col("most"), "small") == 0).alias("none")))
    dealt = lookup(rows, common, "shingle", "doc_id").where("none is null or not none")
    to_all = F.when(F.col("by_main"), F.col("component") != F.col("main")).otherwise(F.col("index"))
    unit = F.when(F.col("units").isNull(), F.array(F.lit(0))).when(to_all, F.sequence(F.lit(0), F.col("units") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("units")).cast("int")))
    dealt = dealt.select("shingle", F.explode(unit).alias("unit"), "n", "place", "doc_id", "component", "bits")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "shingle", "unit").sortWithinPartitions("shingle", "unit", "n")
    return cut(alike(dealt.mapInArrow(_sharing(percent), "a long, b long").distinct(), members, percent))


def _agree(percent: int):
    least = least_agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, n = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(-1, TREES * DEPTH) for k in (2, 3))
            agree = (m == n).sum(1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep), "agree": pa.array(agree.astype(np.int32)).filter(keep)})

    return run


def alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree) of the pairs whose minima agree often enough, so that no full set moves for the others."""
    x = members.select(F.col("doc_id").alias("a"), F.col("sig").alias("x"))
    y = members.select(F.col("doc_id").alias("b"), F.col("sig").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_agree(percent), "a long, b long, agree int")


def sets_of(d: DataFrame, told: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of all documents that candidates name: the one time that texts move, whatever is confirmed later."""
    wanted = told.select(F.col("a").alias("doc_id")).unionByName(told.select(F.col("b").alias("doc_id"))).distinct()
    return cut(d.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(_full_sets(width), "doc_id long, shingles binary"))


def _across(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs that the labels do not connect."""
    ca = linked.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = linked.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b", "agree")


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Enough confirmed links to connect all that the pairs connect: of each document's best pair first, then of the rest."""
    ends = pairs.select(F.col("a").alias("d"), "a", "b", "agree").unionByName(pairs.select(F.col("b").alias("d"), "a", "b", "agree"))
    best = cut(ends.groupBy("d").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
    edges = cut(confirmed(best, sets, percent))
    rest = cut(_across(pairs.join(best, ["a", "b"], "left_anti"), cut(components(edges, rounds=2))))
    return edges if rest.isEmpty() else cut(edges.unionByName(confirmed(rest, sets, percent)))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Words are runs of anything but space and 0x09-0x0D with A-Z lower-cased; a document with
    fewer than ``width`` words has one shingle, its whole sequence; links hold at 100 * shared >=
    ``percent`` * union.  Null, empty and wordless texts have no shingle and are alone.  Repeated
    rows of one id stay, alike.  A row with a null id is linked with nothing and is kept, with a
    null component.  Other columns are not read.  An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sig = cut(d.mapInArrow(_signatures(width), "doc_id long, n long, s1 long, s2 long, sig binary"))
    groups = sig.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    groups = cut(groups)
    reps = sig.join(groups.select(F.col("rep").alias("doc_id"), F.col("s1").alias("_1"), F.col("s2").alias("_2")), "doc_id").where("s1 = _1 and s2 = _2").select("doc_id", "n", "sig").dropDuplicates(["doc_id", "n"])
    reps = cut(reps)
    told = cut(candidates(reps, percent))
    sets = sets_of(d, told, width)
    pairs = told.where("a < b")
    edges = pairs.select("a", "b").limit(0) if pairs.isEmpty() else _links(sets, pairs, percent)
    linked = None if edges.isEmpty() else cut(components(edges))
    large = told.where("a = b").select(F.col("a").alias("doc_id"))
    if not large.isEmpty():
        of = reps.select("doc_id", "sig").join(large, "doc_id")
        of = cut(of.withColumn("component", F.col("doc_id")) if linked is None else of.join(linked, F.col("doc_id") == F.col("node"), "left").select("doc_id", "sig", F.coalesce("component", "doc_id").alias("component")))
        more = sharing(sets, of, percent)
        if not more.isEmpty():
            found = _links(sets, more, percent)
            if not found.isEmpty():
                linked = cut(components(edges.unionByName(found)))
    of_set = groups if linked is None else groups.join(linked, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("rep"))
    # texts without a shingle have no set to be found by
    some, none = (sig.where(x).select("doc_id", "n", "s1", "s2") for x in ("n > 0", "n = 0"))
    out = some.join(of_set.select("s1", "s2", "n", F.col("rep").alias("c")), ["s1", "s2", "n"], "left").unionByName(none.withColumn("c", F.lit(None).cast("bigint")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

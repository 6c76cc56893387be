"""The text operators against brute force on small fixtures with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontamination, near_dedup, quality, search, substring_dedup, token_count
from graphloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, words=400):
    return [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies at and around the border, shared passages, odd and very long texts."""
    rng = random.Random(7)
    docs = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "One"), (4, "one"), (5, "Two Words"), (6, "two\nwords"), (7, "É é İ \U0001f600 x"), (8, "a b c"), (9, "A  B\tC")]
    base = prose(rng, 120)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        docs.append((len(docs), " ".join(w)))
    passage = prose(rng, 35)
    for k in range(40):
        docs.append((len(docs), " ".join(prose(rng, rng.randint(0, 80)) + passage + prose(rng, rng.randint(0, 80)))))
    docs += [(len(docs) + k, "copy of a text that stands twenty times in the table, word for word") for k in range(20)]
    docs.append((len(docs), " ".join(prose(rng, 30_000))))
    docs.append((len(docs), "x" * 300_000))
    docs.append((len(docs), " ".join(["same"] * 500)))
    docs.append((len(docs), "\n".join([" ".join(passage)] * 5)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in docs], "doc_id long, text string, row string, n long").repartition(3)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, corpus, width, percent):
    sets = {}
    for i, t in corpus:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    df = frame(spark, corpus + [(None, "one"), (10, dict(corpus)[10])])
    for r in near_dedup.link(df, width=width, percent=percent).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id), r


def test_substring_dedup(spark, corpus):
    seen, want = set(), {}
    for i, t in corpus:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        want[i] = (len(w), " ".join(x for x, g in zip(w, gone) if not g).encode(), gone)
    for hot in (substring_dedup.HOT, 3):  # the second deals every window by itself
        got = substring_dedup.dedup(frame(spark, corpus), hot=hot).collect()
        assert len(got) == len(corpus)
        for r in got:
            n, kept, gone = want[r.row.doc_id]
            assert (r.n_words, bytes(r.kept)) == (n, kept), r.row
            spans = [False] * n
            for a, b in zip(r.removed[::2], r.removed[1::2]):
                spans[a:b] = [True] * (b - a)
            assert spans == gone


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "a b")]
    got = sorted((r.row.doc_id or 99, bytes(r.kept).decode()) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, text), (1, text), (2, ""), (99, ""), (99, "a b")]


def test_decontamination(spark, corpus):
    rng = random.Random(3)
    docs = list(corpus)
    items = [(0, " ".join(prose(rng, 25, 60))), (1, "Gamma-Delta, EPSILON"), (2, None), (3, "..."), (4, " ".join(prose(rng, 14, 60))), (10, "zeta1 é2 eta3 theta4 iota5 kappa6 lambda7 mu8 nu9 xi10 omicron11"), (11, None)]
    w = items[0][1].split()
    docs += [(len(docs), "start " + " ".join(w[3:20]).upper() + " end."), (len(docs) + 1, "x gamma; delta! epsilon gamma delta epsilon"), (len(docs) + 2, "ZETA1 é2 eta3 theta4, iota5 kappa6 lambda7 mu8 nu9\nxi10"), (len(docs) + 3, items[4][1] + " " + " ".join(w[:9])), (len(docs) + 4, "zeta1 É2 eta3 theta4 iota5 kappa6 lambda7 mu8 nu9 xi10")]
    phrases = defaultdict(set)
    for i, t in items:
        x = ALNUM.findall(lower(t))
        for k in range(max(1, len(x) - 9) if x else 0):
            phrases[tuple(x[k : k + 10])].add(str(i))
    want = {}
    for i, t in docs:
        x = ALNUM.findall(lower(t))
        hit, found = [False] * len(x), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(x) - n + 1):
                if tuple(x[k : k + n]) in phrases:
                    hit[k : k + n] = [True] * n
                    found |= phrases[tuple(x[k : k + n])]
        want[i] = (len(x), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, extra string")
    df = frame(spark, docs)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.report(df, bench).collect()}
    assert got == want
    # shards of a few texts and one item a pass give the same
    small = decontamination.find_hits(df, bench.select("item_id", "text"), shard_bytes=200, block_bytes=100).collect()
    assert {r._row.doc_id: (r._n_words, len(r._hits) // 3, len(r._items)) for r in small} == {i: v[:3] for i, v in want.items()}
    clean = {r.doc_id: r for r in decontamination.remove(df, bench.select("item_id", "text")).collect()}
    assert clean[docs[-5][0]].text == "start  end." and clean[docs[-4][0]].text == "x "
    assert clean[0].text is None and clean[7].text == dict(docs)[7] and set(clean[0].asDict()) == set(df.columns)


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(20):
        pieces = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 8))]
        text = np.concatenate([np.append(p, 0) for p in pieces + pieces[:2]])
        index = FMIndex(text, sample=3)
        for n in (1, 3, 6):
            patterns = rng.integers(0, 6, (20, n))
            for p, a, b in zip(patterns, *index.search(patterns)):
                want = [] if (p == 0).any() else [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_token_counts(spark, corpus):
    vocabulary = {p: -float(k + 1) for k, p in enumerate(["▁", "▁w", "w", "1", "2", "12", "▁w1", "o", "n", "e", "one", "▁one", "é", "same", "ame", "▁s", "x", "xx", "xxxx"])}

    def brute(word):
        s = "▁" + word
        byte = min(vocabulary.values()) - token_count.BYTE_COST
        best = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            n = len(s[end - 1].encode())
            top = (best[end - 1][0] + n * byte, best[end - 1][1] + n)
            for start in range(end - 1, max(-1, end - 6), -1):
                if s[start:end] in vocabulary and best[start][0] + vocabulary[s[start:end]] >= top[0]:
                    top = (best[start][0] + vocabulary[s[start:end]], best[start][1] + 1)
            best.append(top)
        return best[-1]

    memo = {}
    docs = [d for d in corpus if len(d[1] or "") < 200_000]
    for r in token_count.count_tokens(frame(spark, docs), vocabulary=vocabulary).collect():
        said = [memo.setdefault(w, brute(w)) for w in WORD.findall(dict(docs)[r.row.doc_id] or "")]
        assert (r.n_pretokens, r.n_tokens) == (len(said), sum(s[1] for s in said))
        assert math.isclose(r.log_prob, math.fsum(s[0] for s in said), abs_tol=1e-9)


def test_token_store_starts_anew(monkeypatch):
    monkeypatch.setattr(token_count, "STORE", 3)
    c = token_count.Counter({"▁a": -1.0, "b": -2.0})
    c.insert({b"a", b"ab"})
    c.insert({b"abb", b"b"})
    assert c.stored == {b"abb": (3, -5.0), b"b": (4, -2.0 + 3 * (-2.0 - token_count.BYTE_COST))}


@pytest.mark.parametrize("shard_bytes,block_terms", [(1 << 25, 2_000_000), (3000, 400)])
def test_search_equals_brute_force(spark, corpus, shard_bytes, block_terms):
    docs = [*corpus, *[(900 + k, "tied words of a text that many rows have") for k in range(30)]]
    words = {i: ALNUM.findall(lower(t)) for i, t in docs}
    times = {i: Counter(w) for i, w in words.items()}
    df_of = defaultdict(int)
    for w in words.values():
        for x in set(w):
            df_of[x] += 1
    mean = sum(map(len, words.values())) / len(words)
    longest = [i for i, t in docs if len(t or "") > 20_000]
    asked = [0, 1, 3, 7, 12, 75, 90, 120, 905, *longest]
    df = frame(spark, docs)
    got = defaultdict(list)
    for r in search.top_k(df, df.where(df.doc_id.isin(asked)).select("doc_id", "text"), k=10, shard_bytes=shard_bytes, block_terms=block_terms).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    for q in asked:
        scores = {}
        for i, w in words.items():
            norm = search.K1 * (1 - search.B + search.B * len(w) / mean)
            s = sum(math.log1p((len(words) - df_of[x] + 0.5) / (df_of[x] + 0.5)) * n * (search.K1 + 1) / (n + norm) for x, n in times[i].items() if x in times[q])
            if s > 0:
                scores[i] = s
        want = sorted(scores.values(), reverse=True)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert np.allclose([m[2] for m in mine], want, rtol=1e-9)
        for _, i, s in mine:
            assert math.isclose(scores[i], s, rel_tol=1e-9)
        if q == 905:
            assert [i for _, i, _ in mine] == list(range(900, 910))  # of thirty that tie the smallest ids


def test_search_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(5)
    n_docs, n_terms = 20_000, 300
    size = rng.integers(5, 40, n_docs)
    doc = np.repeat(np.arange(n_docs), size)
    term = np.minimum(rng.zipf(1.3, len(doc)) - 1, n_terms - 1)
    pairs, times = np.unique(doc * n_terms + term, return_counts=True)
    doc, term = pairs // n_terms, pairs % n_terms
    shard = search.Shard([(np.arange(n_docs), size, doc, term, times)], n_terms, float(size.mean()))
    weights = np.log1p(n_docs / np.maximum(1, np.bincount(term, minlength=n_terms)))
    norm = search.K1 * (1 - search.B + search.B * size / size.mean())
    for terms in ([0, 7, 40], [1, 250], list(range(0, 300, 9)), [299]):
        terms = np.array(terms)
        share = np.isin(term, terms)
        full = np.bincount(doc[share], weights=(weights[term] * times * (search.K1 + 1) / (times + norm[doc]))[share], minlength=n_docs)
        want = np.lexsort((np.arange(n_docs), -full))[:10]
        for least in (0.0, full[want[-1]] * (1 - 1e-9)):
            before = shard.read, shard.skipped
            ids, scores = shard.top(terms, weights[terms], 10, least)
            order = np.lexsort((ids, -scores))[:10]
            assert np.allclose(scores[order], full[want]) and set(np.flatnonzero(full > full[want[-1]] * (1 + 1e-9))) <= set(ids)
            assert shard.read > before[0]
    assert shard.skipped > shard.read  # most blocks are never looked into


def test_search_by_a_query_of_many_terms_that_nearly_tie():
    """Documents that share nearly all of 20,000 query terms: rounding in the rows must not lose one of the best."""
    rng = np.random.default_rng(6)
    n_docs, n_terms = 150, 20_000
    has = rng.random((n_docs, n_terms)) < 0.999
    doc, term = np.nonzero(has)
    size = np.full(n_docs, n_terms)
    shard = search.Shard([(np.arange(n_docs), size, doc, term, np.ones(len(doc), np.int64))], n_terms, float(n_terms))
    weights = rng.uniform(1e-3, 3, n_terms)
    full = has @ weights  # times 1 and a length of the mean: the impact of each is 1
    want = np.lexsort((np.arange(n_docs), -full))[:10]
    ids, scores = shard.top(np.arange(n_terms), weights, 10)
    order = np.lexsort((ids, -scores))[:10]
    assert ids[order].tolist() == want.tolist() and np.allclose(scores[order], full[want], rtol=1e-9)
    assert search.ROUNDING * n_terms > search.SLACK


def brute_bm25(docs, asked, weight, mean):
    """Scores of all documents (doc, size, times by term) by each set of terms."""
    out = np.zeros((len(asked), len(docs)))
    for d, (size, times) in enumerate(docs):
        norm = search.K1 * (1 - search.B + search.B * size / mean)
        for q, terms in enumerate(asked):
            out[q, d] = sum(weight[t] * n * (search.K1 + 1) / (n + norm) for t, n in sorted(times.items()) if t in terms)
    return out


@pytest.mark.parametrize("docs_of_block,queries_of_batch,piece", [(2048, 256, 1 << 16), (64, 7, 50)])
def test_search_by_long_queries_that_go_together(monkeypatch, docs_of_block, queries_of_batch, piece):
    for name, value in (("DOCS", docs_of_block), ("QUERIES", queries_of_batch), ("PIECE", piece)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(11)
    n_terms = 400
    docs = []
    for i in range(500):
        term = np.minimum(rng.zipf(1.4, rng.integers(0, 120)) - 1, n_terms - 1)
        docs.append(docs[i - 1] if i % 9 == 8 else (len(term) + i % 3, Counter(term.tolist())))  # some tie
    weight = rng.uniform(0.1, 8, n_terms)
    mean = float(np.mean([size for size, _ in docs]))
    asked = [{0}, {3, 7}] + [set(rng.choice(n_terms, n, replace=False).tolist()) for n in (5, 12, 40, 90, 200, 399)] + [set(d[1]) for d in docs[:40] if len(d[1]) > search.SHORT]
    terms = [np.array(sorted(x), np.int32) for x in asked]
    queries = search.Queries(np.append(0, np.cumsum([len(x) for x in terms])), np.concatenate(terms), weight)
    parts = []
    for a in range(0, 500, 130):
        some = docs[a : a + 130]
        rows = [(i, t, n) for i, (_, times) in enumerate(some) for t, n in sorted(times.items())]
        r, t, n = (np.array(x, np.int32) for x in zip(*rows))
        parts.append((np.arange(a, a + len(some)) + 1000, np.array([size for size, _ in some]), r, t, n))
    full = brute_bm25(docs, asked, weight, mean)
    tenth = np.sort(full, axis=1)[:, -10]
    for least in (np.zeros(len(asked)), tenth, tenth * 2):
        q, ids, scores = search.Stretch(parts, weight, mean).top(queries, (0, len(asked)), 10, least)
        assert np.allclose(scores, full[q, ids - 1000], rtol=1e-12)
        for i in range(len(asked)):
            must = np.flatnonzero((full[i] > 0) & (full[i] >= max(tenth[i], least[i])))
            assert set(must + 1000) <= set(ids[q == i].tolist()) and len(ids[q == i]) <= len(must) + 3


def test_search_takes_one_pass_for_more_than_a_million_terms(spark, monkeypatch):
    sent = []
    was = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or was(self, value))
    words = [" ".join(f"t{k * 20_000 + i}" for i in range(20_000)) for k in range(55)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = search.top_k(docs, docs.unionAll(docs.selectExpr("doc_id + 100", "text"))).collect()
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == {(k + more, 1, k) for k in range(55) for more in (0, 100)}
    assert len(sent) == 1  # equal queries are searched once, and all of them in one pass


def test_search_sorts_terms_that_begin_alike():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 5, 400))
    for term in (rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64)):  # the first ones differ in their last bits only
        for n_rows in (5, 1 << 17):
            order = search._by_row(row, term, n_rows)
            want = np.lexsort((term, row))
            assert (row[order] == row[want]).all() and (term[order] == term[want]).all()


def test_search_tasks_return_only_what_reaches_the_floor():
    ids = list(range(300))
    texts = [f"w{i % 7} w{i % 11} w{i % 13} common words of all the texts" for i in ids]
    column = pa.array([t.encode() for t in texts])
    told = list(search._query_terms(iter([pa.RecordBatch.from_arrays([pa.array(ids[:20]), column.slice(0, 20)], ["query_id", "text"])])))
    asked = pa.Table.from_batches(told)
    terms = np.unique(asked["terms"].combine_chunks().flatten().to_numpy())
    block = search._block(asked, pa.table({"term": terms, "weight": np.linspace(0.5, 3, len(terms))}))

    class Said:
        def __init__(self, value):
            self.value = value

    def run(floor):
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column], ["doc_id", "text"])
        out = pa.Table.from_batches(search._search(Said(block), floor, 10, 8.0, 2000)(iter([batch])))
        return out["query"].to_numpy(), out["doc_id"].to_numpy(), out["score"].to_numpy()

    q, docs, scores = run(None)
    first = np.array([scores[q == i].max() for i in range(20)])
    assert np.bincount(q).tolist() == [10] * 20
    q2, docs2, scores2 = run(Said(first * (1 + 1e-9)))
    keep = scores >= first[q] * (1 - 1e-3)
    assert set(zip(q2.tolist(), docs2.tolist())) == set(zip(q[keep].tolist(), docs[keep].tolist())) and len(q2) < len(q) / 2


def test_quality_learns_and_covers_whole_texts(spark):
    rng = random.Random(4)
    good = lambda n: " ".join(prose(rng, n))
    bad = lambda n: "&&& ".join(prose(rng, n))
    rows = [(i, (good if i % 2 else bad)(rng.randint(20, 200)), "x", 0.5) for i in range(400)] + [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (1002, "z" * 50_000, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    got = quality.score(docs, labels, max_rows=150).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in quality.score(docs, labels, max_rows=150).collect() if r.row.doc_id < 400]
    assert sum((r.score >= 0.7) == bool(r.row.doc_id % 2) for r in held) / len(held) > 0.95
    assert [r.score for r in sorted(got, key=lambda r: r.row.doc_id)] == [r.score for r in sorted(quality.score(docs.repartition(3), labels, max_rows=150).collect(), key=lambda r: r.row.doc_id)]
    # every byte is in some chunk
    data = np.arange(5000) % 251
    seen = quality.Network.chunks(data)
    assert seen[0, 0] == 0 and sum((c < 256).sum() for c in seen) >= len(data) and quality.Network.chunks(data[:0]).shape == (1, quality.CHUNK)


def test_quality_network_against_loops():
    """The logit of texts of several stretches, of one chunk, and of none, recomputed filter by filter."""
    rng = np.random.default_rng(1)
    net = quality.Network()
    p = {k: v.astype(float) for k, v in net.p.items()}
    few = quality.STRETCH
    try:
        quality.STRETCH = 3  # so that a short text has several stretches
        for size in (0, 5, quality.CHUNK, quality.CHUNK + 1, 9 * quality.STEP):
            data = rng.integers(0, 256, size).astype(np.uint8)
            outs, at = [], 0
            while True:
                chunk = [int(x) for x in data[at : at + quality.CHUNK]]
                chunk += [256] * (quality.CHUNK - len(chunk))
                best = [max(float(p["embed"][chunk[i : i + quality.WIDTH]].reshape(-1) @ p["filters"][:, f]) for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)) + p["shift"][f] for f in range(quality.FILTERS)]
                outs.append(float(np.tanh(np.maximum(best, 0) @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]))
                if at + quality.CHUNK >= size:
                    break
                at += quality.STEP
            assert abs(net.logit(data) - np.mean(outs)) < 1e-4
    finally:
        quality.STRETCH = few


def test_quality_never_learns_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    learned = [int(t.decode().split()[1]) for t, _ in quality.training_rows(docs, labels, "doc_id", "text", 1000, 1 << 20)]
    assert 20 < len(out) < 80 and sorted(learned) == sorted(set(range(200)) - out)


def test_quality_gradient():
    rng = np.random.default_rng(1)
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks = net.chunks(rng.integers(0, 256, 900))
    out, kept = net.forward(chunks, keep=True)
    g = net.gradient(chunks, kept, np.ones(len(out)))
    for name in ("filters", "embed", "w1", "b1", "w2", "shift"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-6
        up = net.forward(chunks).sum()
        net.p[name][at] -= 2e-6
        down = net.forward(chunks).sum()
        net.p[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert near_dedup.link(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert decontamination.report(none, bench).count() == 0 and decontamination.report(some, bench).first().n_hit == 0
    assert token_count.count_tokens(none, vocabulary={"a": -1.0}).count() == 0
    assert search.top_k(none, none).count() == 0 and search.top_k(some, none).count() == 0
    assert quality.score(none, labels).count() == 0 and quality.score(some, labels).count() == 1


def test_near_dedup_finds_links_inside_a_large_template_region(spark):
    """Pages of one template just below the threshold, with planted pairs above it whose ids are far apart."""
    rng = random.Random(11)
    template = [f"t{k}" for k in range(180)]
    count, planted = 3000, 60

    def page(k):
        return template + [f"p{k}x{i}" for i in range(24)]

    docs = [(k, page(k)) for k in range(count)]
    for k in range(planted):  # a page's own words but the last twelve: similarity 0.89 to it
        docs.append((count + k, page(k * 7)[:-12] + [f"q{k}x{i}" for i in range(12)]))
    rng.shuffle(docs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()}
    assert got == {k: (k - count) * 7 if k >= count else k for k, _ in docs}

"""Hot keys, several blocks of phrases, regions cut by edges, and stages without rows."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from graphloom.llm import common, decontamination, near_dedup, url_filter

from .test_pipeline import tables
from .test_text import WORD, prose


@pytest.mark.parametrize("small", [True, False])
def test_one_url_in_a_third_of_all_pages(spark, monkeypatch, small):
    """Whether rules and token sets are broadcast or dealt over tasks, every page gets its own verdict."""
    if not small:
        monkeypatch.setattr(common, "SMALL", -1)
        monkeypatch.setattr(url_filter, "SMALL", -1)
    hot = "https://hot.example.net/casino/win"
    urls = [hot if k % 3 == 0 else f"https://site{k % 50}.net/{'casino' if k % 5 == 0 else 'news'}/{k % 40}" for k in range(20_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(8)
    labels = spark.createDataFrame([(k, "casino" in urls[k]) for k in range(0, 20_000, 7)], "doc_id long, bad boolean")
    got = url_filter.judge(pages, labels, []).select("page_id", "verdict").collect()
    assert len(got) == 20_000
    assert {(r.page_id, r.verdict) for r in got} == {(k, "block" if "casino" in u else "allow") for k, u in enumerate(urls)}


def test_blocks_of_phrases_find_what_one_block_finds(spark):
    rng = random.Random(3)
    items = [(f"i{k:02}", " ".join(prose(rng, rng.choice([0, 3, 10, 14, 30]), 60))) for k in range(40)] + [("i01", "again one two three"), (None, "a b c"), ("i99", None)]
    docs = [(k, " ".join(prose(rng, 20, 60)) + " " + rng.choice(items[:40])[1] + " x") for k in range(120)] + [(500, None), (501, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda n: sorted(map(str, decontamination.find_hits(d, b, block_bytes=n).select("_row.doc_id", "_n_words", "_hits", "_items").collect()))
    one = rows(1 << 22)
    assert rows(300) == one and sum("_items=['i" in r or "_items=[]" not in r for r in one) > 20


def test_regions_of_any_size_lose_no_link(spark):
    """Groups of 2 to 40 near copies, many of them, over more partitions than groups: an edge of a task cuts some."""
    rng = random.Random(9)
    docs = []
    for size in [2, 5, 9, 10, 11, 14, 17, 18, 19, 25, 40] * 3:
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(150)] = f"n{rng.randrange(9999)}"
            docs.append((len(docs), " ".join(w)))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(16), width=3, percent=85).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sets = {}
    for i, t in docs:
        w = WORD.findall(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    near = defaultdict(set)
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(holders[x] for x in s)) - {i}:
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                near[i].add(j)
    least = {}
    for i in sorted(sets):
        if i not in least:
            front = [i]
            while front:
                x = front.pop()
                if x not in least:
                    least[x] = i
                    front += near[x]
    assert got == least


def test_candidates_of_a_template_follow_its_members(spark, monkeypatch):
    """Pages of one template, nearly all below the threshold: what full sets move for does not grow with their square."""
    confirmed = []
    find = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, sets, percent: confirmed.append(pairs.count()) or find(pairs, sets, percent))
    rng = random.Random(5)
    phrases = [[f"p{k}x{j}" for j in range(9)] for k in range(30)]
    frame = [f"t{k}" for k in range(300)]
    per_page = []
    for n in (250, 1000):
        docs = [(k, " ".join([w for c in range(4) for w in frame[75 * c : 75 * (c + 1)] + rng.choice(phrases)])) for k in range(n)]
        confirmed.clear()
        near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), width=5, percent=95).count()
        per_page.append(sum(confirmed) / n)
    assert per_page[1] < 2.5 * max(per_page[0], 4)


def test_stages_without_rows(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, d)
        assert out.count() == 0 and (k == 4 or out.columns == empty.columns)

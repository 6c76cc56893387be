"""The pipeline over a small corpus: each stage against brute force on what it was given."""

import random
import re

import corpus_pipeline
from graphloom.llm import decontamination, mixing, near_dedup, quality
from graphloom.llm.common import ensure_checkpoint_dir

from .test_text import ALNUM, WORD, lower, prose


def tables(spark, folder):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        text = (" " if good else "&&& ").join(prose(rng, rng.randint(30, 150), 900))
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    passage = [f"bench{k}" for k in range(25)]
    docs[1] = (1, docs[1][1] + " " + " ".join(passage[3:18]) + " after", "en", "s1", 0)
    docs[2] = (2, docs[2][1] + " mail me@example.org now", "en", "s2", 0)
    docs[5] = (5, docs[1][1] + " end", "en", None, 0)  # a near copy of 1
    docs += [(200, docs[7][1], "en", "s1", 0), docs[9], (None, docs[10][1] + " null id", "en", "s1", 0), (201, None, "en", "s1", None)]
    docs.append(docs[-2])  # the row without an id stands twice
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(passage)), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "mixing sources to target weights"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        seen.append((docs.collect(), spark.read.parquet(f"{d}/{k}").collect()))
        if k < 4:
            assert out.columns == columns
        docs = spark.read.parquet(f"{d}/{k}")

    given, kept = seen[0]
    scores = {(r.row.doc_id, bytes(r.text or b"")): r.score for r in quality.score(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")).collect()}
    assert sorted(map(str, kept)) == sorted(str(r) for r in given if scores[(r.doc_id, (r.text or "").encode())] >= corpus_pipeline.QUALITY)
    assert sum(r.doc_id is not None and r.doc_id < 160 and r.doc_id % 4 != 0 for r in kept) > 100

    given, kept = seen[1]
    sets = {}
    for r in given:
        w = WORD.findall(lower(r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    gone = {b for a in sets for b in sets if a is not None and b is not None and a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given} - gone and len(kept) == len({r.doc_id for r in kept})
    assert 5 in gone and 200 in gone

    given, kept = seen[2]
    before = {r.doc_id: r for r in given}
    for r in kept:
        if r.doc_id == 1:
            assert "bench" not in r.text and r.text.endswith("  after") and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id].text
    hits = [ALNUM.findall(lower(r.text)) for r in kept]
    assert not any("bench5" in h for h in hits) and decontamination.WINDOW == 10

    given, kept = seen[3]
    assert {r.doc_id for r in kept} == {r.doc_id for r in given}
    assert not any(re.search(r"[a-z]@[a-z]", r.text or "") for r in kept) and any("mail [EMAIL] now" in (r.text or "") for r in kept)

    given, kept = seen[4]
    sizes = {}
    for r in given:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(given, spark.read.parquet(f"{d}/3").schema)).collect() if r.copies}
    assert {r.doc_id: r.copies for r in kept} == want
    taken = sum(r.copies * len(WORD.findall(r.text or "")) for r in kept)
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    ensure_checkpoint_dir(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "copies" in out.columns and out.count() > 50
    assert near_dedup.link(out).where("not kept").count() == 0

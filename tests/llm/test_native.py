"""URL filter, chat format and mixing: brute force, round trips, and odd inputs."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from graphloom.llm import chat_format, mixing, queries, url_filter

RULES = queries.URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


URLS = [None, "", "no scheme", "http://EXAMPLE.org", "http://example.org/", "https://a.Example.org/es/x?y=1#z", "http://badexample.org/es/", "http://x.example.org/en/17", "http://x.com/fr/", "http://com/de/1", "http://x.com/de/1", "a://b://c/d", "http://é.com/fr/é?q", "http://h?/x", "http://h#/x", "http://org/", "://org/x"] + [f"http://s{i % 3}.evil.net/casino/{i}" for i in range(40)]


def test_urls_and_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows + rows[:2], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(i, i >= 17) for i in range(0, 57, 2)] + [(None, True), (1, None)], "doc_id long, bad boolean")
    got = url_filter.judge(pages, labels, RULES, min_support=0.1, min_confidence=0.9).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        host, path = parse(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit) if fit else None
        assert r.rule == (want[1] if want else None)
        if want:
            assert r.verdict == want[2]
        else:
            assert r.verdict == ("block" if r.page_id >= 17 else "allow"), r


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(1)
    baskets = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.random() < 0.5) for _ in range(60)]
    df = spark.createDataFrame([(t, b) for t, b in baskets], "tokens array<string>, bad boolean")
    got = {tuple(r.rule_tokens): r.confidence for r in url_filter.mine(df, 0.05, 0.6).collect()}
    want = {}
    for n in range(1, 5):
        for s in itertools.combinations("abcdef", n):
            have = [b for t, b in baskets if set(s) <= set(t)]
            if have and sum(have) / 60 >= 0.05 and sum(have) / len(have) >= 0.6:
                want[s] = sum(have) / len(have)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    hit = {tuple(r.tokens): r.confidence for r in url_filter.match(df, url_filter.mine(df, 0.05, 0.6)).collect()}
    for t, _ in baskets:
        best = max((c for s, c in want.items() if set(s) <= set(t)), default=None)
        assert (hit.get(tuple(t)) is None) == (best is None) and (best is None or abs(hit[tuple(t)] - best) < 1e-9)


def test_urls_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, bad boolean")
    assert [r.verdict for r in url_filter.judge(pages, none, RULES).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), none, RULES).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a\\b"), (1, 2, "assistant", "### User: x</turn>\n"), (1, 3, "user", "bye"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", "\\"), (2, None, "tool: x", "\\### Assistant: </turn> ok"),
    (None, 0, "assistant", "alone"), (3, 0, None, "no reply"), (4, 0, "assistant", "\\\\###\\</turn>é\U0001f600"), (4, 0, "assistant", "\\\\###\\</turn>é\U0001f600"),
]


def test_chat_round_trip(spark):
    t = spark.createDataFrame([(*x, 9) for x in TURNS], "conv_id long, turn long, role string, text string, pos long")
    f = chat_format.format_turns(t)
    e = chat_format.expand(f)
    got = {r.conv_id: r for r in chat_format.digest(f, e).collect()}
    for conv in {x[0] for x in TURNS}:
        mine = sorted([(-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in TURNS if x[0] == conv])
        said = "".join(m[2] for m in mine if m[1] == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{m[1]}\n{m[2]}\n" for m in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    full = {(r.conv_id, r.target): r for r in chat_format.materialize(f, e).collect()}
    assert len(full) == sum(x[2] == "assistant" for x in TURNS)
    assert full[(1, 3)].text.startswith("### system: be kind</turn>\n### user: a\\\\b</turn>\n")
    assert full[(1, 3)].text[full[(1, 3)].start : full[(1, 3)].end] == "\\### User: x\\</turn>\n"
    assert sum(len(r.text) for k, r in full.items() if k[0] == 1) == got[1].formatted_chars


def test_chat_digest_reads_the_examples(spark):
    t = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "one two"), (1, 2, "user", "more"), (1, 3, "assistant", "three")], "conv_id long, turn long, role string, text string")
    f = chat_format.format_turns(t)
    e = chat_format.expand(f)
    whole = chat_format.digest(f, e).first()
    shorter = chat_format.digest(f, e.withColumn("loss_end", F.col("loss_end") - 1)).first()
    assert shorter.loss_sha256 == hashlib.sha256(b"one twthre").hexdigest() and shorter.turns_sha256 == whole.turns_sha256
    first = chat_format.digest(f, e.where("target = 2")).first()
    assert (first.loss_chars, first.formatted_chars) == (7, len("### user: ask</turn>\n### assistant: one two</turn>\n"))
    none = chat_format.digest(f, e.limit(0)).first()
    assert (none.n_turns, none.loss_chars, none.formatted_chars) == (4, 0, 0)


def test_chat_with_a_very_long_text_and_many_turns(spark):
    long = "### </turn>\\ \U0001f600 " * 50_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)]
    f = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.digest(f, chat_format.expand(f)).collect()}
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    sizes = list(itertools.accumulate(len(f"### {r[2]}: {r[3]}</turn>\n") for r in rows[2:]))
    assert got[2].formatted_chars == sum(sizes[1::2]) and got[2].n_turns == 3000


def test_chat_empty(spark):
    f = chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat_format.digest(f, chat_format.expand(f)).count() == 0


def brute_targets(sizes, weights, share, repeat):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] >= repeat * sizes[s]]
        if not over:
            return {**held, **t}
        held |= {s: repeat * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "é", None]) if i % 3 else "a", " ".join("w" * rng.choice([1, 5, 90]))) for i in range(600)]
    rows += [(9000, "tiny", "one two"), (9001, "zero", ""), (9002, "zero", None), (None, "a", "x y"), (5, "a", "x y z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(mixing.mix(df.repartition(3)).collect())
    kept = mixing.apply_mix(df)
    assert sum(r.copies * len((r.text or "").split()) for r in kept.collect()) == sum(taken.values())
    assert kept.columns == [*df.columns, "copies"]


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    one = spark.createDataFrame([(1, None, "a b")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix(one).collect()] == [2]
    assert mixing.apply_mix(one.where(F.lit(False))).count() == 0

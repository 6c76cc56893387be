"""Vector codes, conversation repair and line dedup against brute force, with odd inputs."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, conversation_repair, line_dedup, vector_codes

# --- vector codes


def lloyd(rows, rounds=6, entries=16):
    """[(vec_id, label, code, error)] and the codebooks' digest, every part compared with every entry in each round."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    full = [(i, [math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v)), lab) for i, v, lab in kept]
    top = math.isqrt((1 << 62) // (8 * width)) // 2
    fit = [r for r in full if all(abs(x) < top for x in r[1])]
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            held = defaultdict(list)
            for _, v, _ in fit:
                held[near(v, p)[1]].append(part(v, p))
            books[p] = [[sum(col) // len(held[e]) for col in zip(*held[e])] if e in held else c for e, c in enumerate(books[p])]
    out = [(i, lab, "".join(f"{near(v, p)[1]:02x}" for p in range(8)), sum(near(v, p)[0] for p in range(8))) for i, v, lab in fit]
    out += [(i, lab, None, None) for i, v, lab in full if not all(abs(x) < top for x in v)]
    digest = hashlib.sha256(",".join(str(x) for p in range(8) for c in books[p] for x in c).encode()).hexdigest()
    return out, digest


def vectors(kind):
    rng = random.Random(5)
    if kind == "few":
        return [(k, [rng.uniform(-1, 1) for _ in range(16)], 1) for k in range(3)]
    if kind == "one":
        return [(7, [0.5], None)]
    if kind == "none kept":
        return [(1, None, 1), (2, [None, 1.0], 2), (3, [math.nan] * 16, 3)]
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(9)]
    rows = [(k, [c + rng.gauss(0, 0.05) for c in centres[k % 9]], rng.choice([1, 2, None])) for k in range(300)]
    rows += [(500 + k, [0.25, -0.25] * 8, 4) for k in range(150)]  # one vector in a third of the rows
    rows += [(1000, None, 1), (1001, [], 1), (1002, [math.inf] + [0.0] * 15, 1), (1003, [0.1] * 5, 1), (1004, [1e9] + [0.0] * 15, 2), (1005, [3e4] * 16, 9), (None, [0.3] * 16, 3), (None, [0.2] * 16, 3)]
    return rows + rows[:5] + [(0, [9.0] * 16, 1)]


@pytest.mark.parametrize("kind", ["many", "few", "one", "none kept"])
def test_vector_codes(spark, kind):
    rows = vectors(kind)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    frame = spark.createDataFrame([(i, v, lab, "clash", "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, slot string").repartition(5)
    coded, books = vector_codes.compress(frame)
    want, digest = lloyd(rows)
    got = vector_codes.with_label_errors(coded).collect()
    assert (None if books is None else vector_codes.codebooks_digest(books)) == digest
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r.label_error == (sum(e for _, lab, _, e in want if lab == r.label and e is not None) if any(lab == r.label and e is not None for _, lab, _, e in want) else None)


def test_no_vectors(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert books is None and coded.count() == 0


def test_heaps_pop_what_drift_reaches_only():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8, 4))
    data = (centres[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8, 4))).astype(np.int32)
    books = centres.transpose(1, 0, 2).astype(np.int64) + 40
    drift = np.zeros((8, 16))
    block, popped = vector_codes.Block(data, 16), []
    for _ in range(5):
        before = block.popped
        state = block.state(block.assign(books, drift))
        popped.append(block.popped - before)
        block = vector_codes.Block.of(state, 4, 16)
        for p in range(8):
            assert (vector_codes.distances(data[:, p], books[p]).argmin(1) == block.codes[:, p]).all()
            for keys in block.keys[p]:  # a heap stays one through a state
                assert all(keys[(k - 1) // 2] <= keys[k] for k in range(1, len(keys)))
        moved = rng.integers(-3, 4, books.shape)
        books = books + moved
        drift += np.sqrt((moved**2).sum(2)) + np.sqrt((moved**2).sum(2)).max(1, keepdims=True)
        block.popped = 0
    assert popped[0] == 3000 * 8 and max(popped[1:]) < 3000 * 8 / 4


# --- conversation repair


def cheapest(rows):
    """(cost, letters) by listing all edits with costs up to the least, rows: (initial, fault)."""
    fits = lambda s, end: (s in ("", "s") or all(a != b and a + b in ("ua", "au", "su") for a, b in itertools.pairwise(s))) and s[:1] != "a" and (not end or s == "" or s.endswith("a"))
    heap, bound, found = [(0, "", 0, "")], 2 * len(rows), []
    while heap:
        cost, letters, k, roles = heap.pop()
        if cost > bound or not fits(roles, False):
            continue
        if k == len(rows) and fits(roles, True):
            found.append((cost, letters))
            bound = min(bound, cost)
        for r in "ua":
            heap.append((cost + 5, letters + "I", k, roles + r))
        if k < len(rows):
            initial, fault = rows[k]
            heap.append((cost + 2, letters + "D", k + 1, roles))
            if fault != conversation_repair.GONE:
                more = 5 if fault == conversation_repair.CUT else 0
                heap += [(cost + more, letters + "K", k + 1, roles + initial)] if initial in "sua" else []
                heap += [(cost + 1 + more, letters + "R", k + 1, roles + r) for r in "ua"]
    return min(found)


def test_trie_answers_are_the_cheapest_edits():
    rng = random.Random(2)
    cases = [[(rng.choice("suaxuaua"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 5))] for _ in range(250)]
    code = lambda rows: bytes(f * 4 + conversation_repair.INITIALS.get(i, 0) for i, f in rows)
    found = conversation_repair.answers([code(c) for c in cases])
    for c in cases:
        assert found[code(c)] == cheapest(c), c


def test_trie_layers_are_shared(monkeypatch):
    made = []
    layer = conversation_repair.next_layer
    monkeypatch.setattr(conversation_repair, "next_layer", lambda a, s: made.append(s) or layer(a, s))
    stem = bytes([2, 3] * 50)
    signatures = [stem + bytes([s]) for s in (2, 3, 1)] * 100 + [stem]
    found = conversation_repair.answers(signatures)
    assert len(made) == 103 and found[stem] == (0, "K" * 100)


SPACE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """The contract's digest columns of one conversation's original rows (conv_id, turn, role, text)."""
    after = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols = set(), []
    for _, role, text in after:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        symbols.append((role[:1], fault))
        seen.add((role, text))
    turns = {t for t, _, _ in after if t is not None}
    kinds = {"blank": 2, "duplicate": 2, "truncated": 1, None: 0}
    code = bytes(kinds[f] * 4 + conversation_repair.INITIALS.get(i, 0) for i, f in symbols)
    cost, audit = conversation_repair.answers([code])[code] if len(symbols) > 5 else cheapest([(i or "x", kinds[f]) for i, f in symbols])
    said, k, state = [], 0, ""
    for e in audit:
        role, text = ("", "") if e == "I" else after[k][1:]
        k += e != "I"
        if e == "D":
            continue
        if e in "IR":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        said.append(f"{role}:{'' if e == 'I' else text}")
    count = lambda f: sum(x == f for _, x in symbols)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def test_conversation_repair(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SPOOL", 1 << 12)
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "cut", "", " \n", None, "why? ", "é\U0001f600.", "a\nb."])))
    rows += [(900, k, "user" if k % 2 == 0 else "assistant", "line %d." % (k % 40)) for k in range(2000)]
    rows += [(901, 0, "user", "x" * 500_000 + "."), (901, 1, "assistant", "ok.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "hello.")] + rows[:20]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, copies string").repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damage(frame)).collect()}
    per = defaultdict(list)
    for r in rows:
        per[r[0]].append(r)
    assert got.keys() == per.keys()
    for conv, own in per.items():
        assert got[conv] == repaired(own), conv
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(conversation_repair.damage(empty)).count() == 0


# --- line dedup


def without_repeats(docs, least_chars=40, least_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = {x for x in held[key(line)] if x is not None}
            if len(key(line)) < least_chars or len(ids) < least_docs or i == max(ids):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_line_dedup(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(common, "SMALL", -1)
    rng = random.Random(4)
    common_line = "All rights reserved by the owners of this Invented page"
    lines = [f"line number {k} of those that stand in a few documents only" for k in range(30)] + [f"short {k}" for k in range(5)] + ["É" * 40, "é" * 39, "e" * 40, "E" * 40 + " \t", "  " + "e" * 40]
    docs = [(k, "\n".join([rng.choice(lines) for _ in range(rng.randint(0, 6))] + ([common_line.upper() if k % 2 else f"\t{common_line} "] if k % 3 == 0 else []))) for k in range(200)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, common_line * 4000), (304, "\n".join(f"own line {k} of a long document that nobody else has" for k in range(20_000)) + "\n" + common_line)]
    docs += [(None, common_line + "\nshort"), (None, None), (5, common_line + "\nanother text of the same id")] + docs[:3]
    frame = spark.createDataFrame([(i, t, "clash", "x") for i, t in docs], "doc_id long, text string, key string, row string").repartition(6)
    got = line_dedup.dedup(frame).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(map(tuple, got), key=order) == sorted(without_repeats(docs), key=order)


def test_a_full_filter_costs_no_line(spark):
    docs = [(k, f"a line of at least forty characters number {k // 6}\nand one more that is long enough for itself {k}") for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup(frame, bits=64).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept")).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(docs))


def test_no_documents(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_suspects_are_shuffled():
    """Of lines that all differ, the merged filter knows next to none; of repeated ones it knows all."""
    rng = np.random.default_rng(2)
    own, twice = rng.integers(0, 1 << 62, (20_000, 2)).astype(np.uint64), rng.integers(0, 1 << 62, (500, 2)).astype(np.uint64)
    once, again = np.zeros(1 << 17, np.uint8), np.zeros(1 << 17, np.uint8)
    for part in (np.concatenate([own[:10_000], twice]), np.concatenate([own[10_000:], twice])):
        places = line_dedup._places(part, 1 << 20)
        line_dedup._add(again, places[line_dedup.known(once, places)])
        line_dedup._add(once, places)
    assert line_dedup.known(again, line_dedup._places(twice, 1 << 20)).all()
    assert line_dedup.known(again, line_dedup._places(own, 1 << 20)).sum() < 200

"""Repair of the structure of conversations: the cheapest edits that make their roles alternate.

A row's part in the repair is one byte, its role's initial with its fault, and a conversation's
signature is these bytes in order.  The rows are shuffled once, by conversation, and stream through
tasks in order of turns.  A task sorts the signatures of a block of conversations and walks the
trie of their prefixes depth first: a signature keeps the layers of the prefix that it shares with
the one before, so each node's layer - the least cost of each state of the automaton - is computed
once.  At a terminal node the layers above it give the cost and the edits, once for all
conversations of that signature.  A conversation's texts are hashed from a spooled file, so a
long one needs no memory beyond its signature and its rows' sizes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CLEAN, CUT, GONE = range(3)
#: Conversations and bytes of text that a task holds as one block; a conversation above SPOOL bytes waits on disk.
BLOCK_ROWS, BLOCK_BYTES, SPOOL = 20_000, 16 << 20, 4 << 20

#: States: nothing yet, after system, after user, after assistant; the first and the last may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: State -> the state after an inserted or re-roled turn, whose role follows from the state.
ALTERNATE = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Layer = tuple[int, int, int, int]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each original row after damage, and copies: 0 for a dropped row, 2 for a repeated one.

    What happens to a row follows from crc32(conv_id:turn) mod 20: 0 drops it, 1 empties its text, 2
    takes out its ``[.!?]``, 3 repeats it, 4 makes its role user.  Nulls are read as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# --- the dynamic program


def _with_inserts(costs: list[int]) -> Layer:
    """A layer after any number of inserted turns; two close the only cycle."""
    for q in (START, SYSTEM, USER, ASSISTANT, USER):
        to = ALTERNATE[q]
        costs[to] = min(costs[to], costs[q] + INSERT)
    return tuple(costs)


def moves(symbol: int) -> list[tuple[str, int, list[int]]]:
    """Edits of a row: letter, cost and the state that each state goes to (-1: none), the ASCII-least letter first."""
    fault, role = divmod(symbol, 4)
    out = [("D", DELETE, [START, SYSTEM, USER, ASSISTANT])]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        keep = {SYSTEM: [SYSTEM, -1, -1, -1], USER: [USER, USER, -1, USER], ASSISTANT: [-1, -1, ASSISTANT, -1]}.get(role, [-1] * 4)
        out += [("K", KEEP + more, keep), ("R", REROLE + more, list(ALTERNATE))]
    return out


MOVES = [moves(s) for s in range(12)]
ROOT = _with_inserts([0, FAR, FAR, FAR])


def next_layer(layer: Layer, symbol: int) -> Layer:
    costs = [FAR] * 4
    for _, cost, to in MOVES[symbol]:
        for q in range(4):
            if to[q] >= 0 and layer[q] + cost < costs[to[q]]:
                costs[to[q]] = layer[q] + cost
    return _with_inserts(costs)


def read_off(signature: bytes, layers: list[Layer]) -> tuple[int, str]:
    """The least cost and, of the cheapest edits, the ASCII-least letters, from the layers of all prefixes."""
    n = len(signature)
    best = min(layers[n][START], layers[n][ASSISTANT])
    # alive: the states of each layer that lie on a cheapest way, from the end back
    alive: list[int] = [0] * (n + 1)
    alive[n] = sum(1 << q for q in (START, ASSISTANT) if layers[n][q] == best)
    for k in range(n, -1, -1):
        at, now = layers[k], alive[k]
        for _ in range(3):  # through inserts, back
            for q in range(4):
                to = ALTERNATE[q]
                if now >> to & 1 and at[q] + INSERT == at[to]:
                    now |= 1 << q
        alive[k] = now
        if k:
            for _, cost, to in MOVES[signature[k - 1]]:
                for q in range(4):
                    if to[q] >= 0 and now >> to[q] & 1 and layers[k - 1][q] + cost == at[to[q]]:
                        alive[k - 1] |= 1 << q
    out, q, k = [], START, 0
    while True:
        here, step = layers[k][q], None
        if k < n:
            for letter, cost, to in MOVES[signature[k]]:
                if to[q] >= 0 and alive[k + 1] >> to[q] & 1 and here + cost == layers[k + 1][to[q]]:
                    step = (letter, to[q], k + 1)
                    break
        if step is None or step[0] > "I":
            to = ALTERNATE[q]
            if alive[k] >> to & 1 and here + INSERT == layers[k][to]:
                step = ("I", to, k)
        if step is None:
            return best, "".join(out)
        out.append(step[0])
        q, k = step[1], step[2]


def answers(signatures: list[bytes]) -> dict[bytes, tuple[int, str]]:
    """(cost, edits) of each distinct signature, by a walk through the trie of their prefixes."""
    out: dict[bytes, tuple[int, str]] = {}
    layers, before = [ROOT], b""
    for s in sorted(set(signatures)):
        shared = next((i for i, (a, b) in enumerate(zip(s, before)) if a != b), min(len(s), len(before)))
        del layers[shared + 1 :]
        for symbol in s[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        out[s], before = read_off(s, layers), s
    return out


# --- conversations


class Conversation:
    """The rows of one conversation, one after the other."""

    def __init__(self, ident):
        self.ident, self.signature, self.sizes = ident, bytearray(), []
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.seen: set[bytes] = set()
        self.faults = [0, 0, 0]
        self.illegal, self.last, self.bytes = 0, None, 0
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, body: bytes) -> None:
        said = role.encode()
        end = body.rstrip(b" \t\n\x0b\x0c\r")
        key = hashlib.blake2b(said + body, digest_size=16, key=len(said).to_bytes(8)).digest()
        fault = CLEAN
        if not end:
            self.faults[0] += 1
            fault = GONE
        elif key in self.seen:
            self.faults[1] += 1
            fault = GONE
        elif end[-1:] not in (b".", b"!", b"?"):
            self.faults[2] += 1
            fault = CUT
        self.seen.add(key)
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.signature.append(fault * 4 + INITIALS.get(role[:1], 0))
        self.spool.write(said + body)
        self.sizes.append((len(said), len(body)))
        self.bytes += len(said) + len(body) + 64

    def repaired(self, edits: str) -> str:
        """Digest of the repaired rows."""
        h, state, row, first = hashlib.sha256(), START, 0, True
        self.spool.seek(0)
        for e in edits:
            said = text = b""
            if e != "I":
                said, text = (self.spool.read(n) for n in self.sizes[row])
                row += 1
            if e == "D":
                continue
            if e == "K":
                state = INITIALS[said[:1].decode()]
            else:
                state = ALTERNATE[state]
                said = ROLE_OF[state].encode()
            h.update((b"" if first else b"\n") + said + b":")
            h.update(text)
            first = False
        self.spool.close()
        return h.hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _told(block: list[Conversation], id_type: pa.DataType) -> pa.RecordBatch:
    found = answers([bytes(c.signature) for c in block])
    rows = [found[bytes(c.signature)] for c in block]
    numbers = [((c.high - c.low + 1 - c.turns) if c.turns else 0, *c.faults, c.illegal, cost) for c, (cost, _) in zip(block, rows)]
    out = {"conv_id": pa.array([c.ident for c in block], id_type)}
    out |= {name: pa.array([n[k] for n in numbers], pa.int64()) for k, name in enumerate(COLUMNS)}
    out["audit"] = pa.array([edits for _, edits in rows], pa.string())
    out["repaired_sha256"] = pa.array([c.repaired(edits) for c, (_, edits) in zip(block, rows)], pa.string())
    return pa.RecordBatch.from_pydict(out)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: list[Conversation] = []
    held, now, id_type = 0, None, None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for ident, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or ident != now.ident:
                if now is not None:
                    now.seen.clear()
                    block.append(now)
                    held += min(now.bytes, SPOOL)
                    if len(block) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                        yield _told(block, id_type)
                        block, held = [], 0
                now = Conversation(ident)
            for _ in range(copies):
                now.add(turn, role, text)
    if now is not None:
        block.append(now)
    if block:
        yield _told(block, id_type)


def repair(damaged: DataFrame) -> DataFrame:
    """Per conversation of ``damage``'s rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, and of one turn by role and text; a repeat stands next to
    its row.  Each row has its first fault: blank, seen before (role and text), cut short.  Edits
    are Keep (0), Rerole (1), Delete (2; blanks and duplicates have to go) and Insert (5), and a cut
    row that stays adds 5; ``audit`` has the letters of the cheapest edits whose roles' initials are
    ``(s?(ua)+)?``, the ASCII-least of several.  ``gaps`` are the turns missing between the first and
    the last.  A null conv_id is a conversation.  One of which no row is left has zeros, no edits and
    the hash of nothing; an empty table gives no rows.
    """
    ident = damaged.schema["conv_id"].dataType
    rows = damaged.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").cast("binary").alias("text"), "copies")
    parts = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = T.StructType([T.StructField("conv_id", ident), *(T.StructField(c, T.LongType()) for c in COLUMNS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return rows.mapInArrow(_repair, schema)


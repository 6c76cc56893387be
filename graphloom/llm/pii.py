"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression over one row, so there is no shuffle.  Positions come from
the pieces between matches: a match starts after the pieces and matches before it.  Patterns
start only where a run of their characters starts, and take runs and groups possessively; that
finds the same matches as plain leftmost search, in linear time and without recursion on texts of
any length.  Matches are walked in blocks, so that the time grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

#: Fixed patterns.  Kinds in the order in which spans with the same start are listed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An account number: two letters, two check digits, 11 to 30 letters or digits, alone or in groups of four.
#: IBAN finds the first four; ACCOUNT reads on from there, at most ACCOUNT_LENGTH characters and the one that follows.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9]{4})"
ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCOUNT_LENGTH = 4 + 7 * 5 + 4
#: A national number in groups 3-2-4; it counts only with a context word nearby.
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "national")

#: Fixed words that raise a score, by kind, looked for in the REACH characters before and after a match.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national": "ssn|social|national|security|insurance",
}
REACH = 40
#: Texts are also held in chunks of so many characters, so that a window costs the same wherever it lies.
CHUNK = 1024
SPAN = "struct<start:int,rank:int,end:int,score:double>"
#: Score of a match without and with a context word; spans below THRESHOLD are dropped, base kinds never are.
SCORES = {"email": (0.8, 0.95), "ip": (0.6, 0.8), "card": (0.8, 0.95), "phone": (0.6, 0.85), "iban": (0.9, 0.99), "national": (0.3, 0.7)}
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's remainder by 97 is 1, with its first four characters moved to the end."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc, c):
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda x: F.regexp_replace(x, "^0+", "").rlike("^(|[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)
    return F.lit(True)


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The characters of a text from ``start`` up to ``end``, or as many as there are."""

    def cut(k):
        first, last = k["a"], k["b"]
        head = F.coalesce(F.get(chunks, first), F.lit(""))
        tail = F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), k["y"])
        middle = F.when(last > first + 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), lambda j: F.get(chunks, j)), "")).otherwise("")
        return F.when(first == last, F.substring(head, k["x"] + 1, k["y"] - k["x"])).otherwise(F.concat(F.substring(head, k["x"] + 1, F.lit(CHUNK)), middle, tail))

    at = F.struct(*[(F.floor(v / CHUNK) if whole else v % CHUNK).cast("int").alias(n) for n, v, whole in (("a", start, True), ("b", end, True), ("x", start, False), ("y", end, False))])
    return let(at, cut)


def _account(ahead: Column) -> Column:
    """The longest account number that begins a text, ends with one of its groups and is confirmed; null if there is none."""
    groups = F.split(F.regexp_extract(ahead, ACCOUNT, 0), " ")
    upto = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    return F.get(F.filter(upto, lambda m: _ok("iban", m)), F.lit(0))


def spans_of(text: Column, chunks: Column, kind: str, pattern: str, may: Column) -> Column:
    """array<struct<start,rank,end,score>> of the confirmed matches of one kind, in order of start."""
    rank = KINDS.index(kind)
    low, high = SCORES[kind]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def span(start, end):
        # the context is the text on both sides, other matches included, but not the match itself
        near = F.lower(F.concat_ws("\n", _between(chunks, F.greatest(start - REACH, F.lit(0)), start), _between(chunks, end, end + REACH)))
        score = F.when(near.rlike(CONTEXT[kind]), F.lit(high)).otherwise(F.lit(low))
        return let(score, lambda x: F.when(x >= THRESHOLD, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x.alias("score"))))

    def placed(made):
        """``made(start, match)`` of each match; a match starts after the end of the one before and the gap."""
        return lambda p: F.zip_with(p, running(p, lambda at, x: at + x["gap"] + F.length(x["m"])), lambda x, at: let(at + x["gap"], lambda start: made(start, x["m"])))

    def some(a):
        return F.filter(a, lambda x: x.isNotNull())

    def apart(numbers):
        """Inside a confirmed number none begins."""
        past = running(numbers, lambda past, x: F.when(x["start"] >= past, x["end"]).otherwise(past))
        return F.zip_with(numbers, past, lambda x, past: F.when(x["start"] >= past, span(x["start"], x["end"])))

    def number(start, _):  # the match is only where a number may begin
        account = _account(_between(chunks, start, start + (ACCOUNT_LENGTH + 1)))
        return let(F.length(account), lambda n: F.when(n.isNotNull(), F.struct(start.alias("start"), (start + n).alias("end"))))

    matches = F.filter(pairs, lambda x: x["m"].isNotNull())
    if kind == "iban":
        found = some(let(some(let(matches, placed(number))), apart))
    else:
        found = some(let(matches, placed(lambda start, m: F.when(_ok(kind, m), span(start, start + F.length(m))))))
    return F.when(may, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, its spans by kind (arrays of start, rank, end, score), _t (the text) and _chunks (its pieces).

    Offsets are code points, ends exclusive.  A null text is empty and has no spans; repeated
    rows give repeated results; columns other than the two named are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    t = F.col("_t")
    # no kind is without a digit or an at sign
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    d = d.withColumn("_chunks", F.when(t.rlike("[0-9@]"), pieces).otherwise(F.array().cast("array<string>")))
    digit = t.rlike("[0-9]")
    by_kind = {
        "email": (EMAIL, t.contains("@")),
        "ip": (IP, t.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, digit & t.rlike(CARD)),
        "phone": (PHONE, t.rlike(r"\+[0-9]")),
        "iban": (IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}")),
        "national": (NATIONAL, t.rlike(r"[0-9]-[0-9]{2}-[0-9]")),
    }
    return d.select("*", *[spans_of(t, F.col("_chunks"), kind, *by_kind[kind]).alias(f"_{kind}") for kind in KINDS])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, the digest of base spans, all spans as text, and the highest score.

    Nulls, repeated rows and other columns are as in ``detect``; an empty table gives no rows, and a
    document without spans has counts of 0, empty ``spans`` and a null ``top_score``.
    """
    d = detect(docs, id_col, text_col)
    base = F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS[:4]]))
    d = d.withColumn("_every", F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    counts = [F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return d.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_every")).alias("spans"), F.array_max(F.transform("_every", lambda s: s["score"])).alias("top_score"))


def redact(docs: DataFrame, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span whose score is at least ``least`` replaced by its kind in brackets; all columns kept.

    Of spans that overlap, all their characters go and the first one's kind stands for them (of
    those with one start, the kind listed first).  A null text stays null, texts without spans
    and repeated rows stay as they are, and an empty table gives no rows.
    """
    carried = docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    d = detect(carried.select(F.col("_row").alias("doc_id"), "_t"), "doc_id", "_t")
    d = d.withColumn("_every", F.filter(F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS])), lambda s: s["score"] >= least))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    chunks = F.col("_chunks")

    def text_of(every):
        at = running(every, lambda at, s: F.greatest(at, s["end"]))
        pieces = F.zip_with(every, at, lambda s, at: F.when(s["start"] >= at, F.concat(_between(chunks, at, s["start"]), F.element_at(names, s["rank"] + 1))))
        return F.concat(F.array_join(pieces, ""), _between(chunks, F.array_max(F.transform(every, lambda s: s["end"])), F.length("_t")))

    text = let(F.col("_every"), text_of)
    old = F.col(f"doc_id.`{text_col}`")
    new = F.when(F.size("_every") == 0, old).otherwise(text)
    return d.select(*[(new if c == text_col else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])

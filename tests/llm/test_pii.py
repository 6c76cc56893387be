"""Base spans against a brute-force reading of the plain patterns."""

import hashlib
import re
import time

from graphloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        if kind == "email" and "@" not in (text or ""):
            continue  # the plain pattern takes time quadratic in a run without an at sign
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and passes_luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end(), kind))
    return sorted(spans)


TEXTS = [
    None,
    "",
    "nothing here",
    "a@b.c_d@e.f",
    "a@b@c.d. x@y..z a@b.c.",
    "mail\U0001f600 me@x.org, call +1 (269) 555-3296 or +49 30 1234567-",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.255 9.9.9.9.9",
    "4539 5787 6362 1486 4539578763621486 4539-5787-6362-1486-1 12 34",
    "card 4111111111111111+1234567890123 +1+1+12345678 9",
    "00000000000000000000000000000000 000000000000",
    "1 1 1 1 1 1 1 1 1 1 1 1  79927398713",
    "y" * 5000 + "@" + "z" * 5000,
    "1" * 20000 + " " + "a" * 20000 + " q@w.de " + "1-" * 4000,
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 DE00 3704 0044 0532 0130 00",
    "social security 123-45-6789; 123-45-6789 alone in a long sentence that goes on and on and on, 987-65-4321",
    "é@é.com ü1@ü.de a_b%c@d-e.f-g",
]


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")


def test_base_spans_equal_brute_force(spark):
    for r in pii.find(rows(spark)).collect():
        want = brute(TEXTS[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r, said)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))


def test_checksums_and_context_add_spans(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.find(rows(spark)).collect()}
    assert "iban:0:27" in got[13] and "iban:32:54" in got[13] and got[13].count("iban") == 2
    assert "national:16:27,national:29:40" in got[14] and got[14].count("national") == 2  # the third is out of reach


def test_redaction_keeps_columns_and_other_text(spark):
    out = {r["doc_id"]: r for r in pii.redact(rows(spark)).collect()}
    assert out[2].text == "nothing here" and out[0].text is None and out[1].text == ""
    assert out[3].text == "[EMAIL][EMAIL]"
    assert set(out[2].asDict()) == {"doc_id", "text", "spans"}


def test_empty_table(spark):
    assert pii.find(rows(spark).limit(0)).count() == 0


def test_context_is_taken_from_the_whole_text(spark):
    far = "x" * 41
    texts = {
        "SSN: 123-45-6789, 987-65-4321": 2,
        "SSN: 123-45-6789, 987-65-4321, 111-22-3333": 3,
        "123-45-6789 is my SSN": 1,
        f"ssn{far}123-45-6789{far}ssn": 0,
        f"{'y ' * 505}ssn {'z' * 12} 123-45-6789{far}": 1,  # the window crosses a chunk's end
        f"\U0001f600{'y' * 1022} 123-45-6789 ssn": 1,
        "123-45-6789": 0,
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].count("national") for r in pii.find(d).collect()}
    assert got == dict(enumerate(texts.values()))
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert out[0] == "SSN: [NATIONAL], [NATIONAL]" and out[2] == "[NATIONAL] is my SSN"


def test_account_numbers_end_at_the_group_that_confirms_them(spark):
    texts = [
        ("BE68 5390 0754 7034 EUR", ["0:19"]),
        ("AT61 1904 3002 3457 3201 BIC", ["0:24"]),
        ("ES91 2100 0418 4502 0005 1332 OK", ["0:29"]),
        ("AT611904300234573201 1000", ["0:20"]),
        ("XX12 BE68 5390 0754 7034 AT61 1904 3002 3457 3201 ABCD 12", ["5:24", "25:49"]),
        ("NO93 8601 1117 947 EUR, DE89 3704 0044 0532 0130 00 EUR", ["0:18", "24:51"]),
        ("BE68 5390 0754 7034EUR BE68 5390 0754 7035 EUR", []),
        (f"{'y' * 1015} BE68 5390 0754 7034 EUR", ["1016:1035"]),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("iban")] for r in pii.find(d).collect()}
    assert got == {i: [f"iban:{w}" for w in want] for i, (_, want) in enumerate(texts)}
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert out[0] == "[IBAN] EUR" and out[4] == "XX12 [IBAN] [IBAN] ABCD 12"


def test_very_long_texts_end_soon_and_equal_brute_force(spark):
    texts = [
        "a@" + "b." * 500_000 + "c and x@y.z",
        " ".join(f"u{k}@host{k % 7}.org" for k in range(30_000)),
        "10.0.0.1 " * 50_000,
        "1." * 500_000,
        "4111 1111 1111 1111, " * 15_000,
        "+49 30 1234567, " * 15_000,
        "\U0001f600 ssn 123-45-6789 " * 30_000,
        "DE89 3704 0044 0532 0130 00, " * 8_000,
        "XX12 ABCD " * 20_000,
        "+1" + "(" * 500_000 + "a@" * 300_000,
        "[" + "x" * 3000 + "]" + "a@b.c" * 5000,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.monotonic()
    got = {r["doc_id"]: r for r in pii.find(d).collect()}
    assert time.monotonic() - start < 120
    for i, text in enumerate(texts):
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(text))
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), i
    assert got[6]["spans"].count("national") == 30_000 and got[7]["spans"].count("iban") == 8_000
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert out[0] == "[EMAIL] and [EMAIL]"
    assert out[1] == " ".join(["[EMAIL]"] * 30_000)
    assert out[6] == "\U0001f600 ssn [NATIONAL] " * 30_000 and out[7] == "[IBAN], " * 8_000
    assert out[8] == texts[8]


def test_redaction_of_overlapping_spans_and_odd_columns(spark):
    rows = [(1, "call +378282246310005 now", 3), (1, "call +378282246310005 now", 3), (None, None, 4), (2, "", 5)]
    d = spark.createDataFrame(rows, "`doc.id` long, `the text` string, _t long")
    got = sorted((r["doc.id"] or 0, r["the text"], r["_t"]) for r in pii.redact(d, text_col="the text").collect())
    assert got == [(0, None, 4), (1, "call [PHONE] now", 3), (1, "call [PHONE] now", 3), (2, "", 5)]
    assert pii.redact(d.limit(0), text_col="the text").count() == 0

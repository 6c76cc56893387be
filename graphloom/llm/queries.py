"""The thin queries over the standard tables, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontamination, line_dedup, mixing, near_dedup, pii, quality, search, substring_dedup, token_count, url_filter, vector_codes
from .common import table

#: verdict, host, path prefix
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("row.doc_id", "n_pretokens", "n_tokens", "log_prob")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for k, role in enumerate(("user", "assistant"))]))
    more = spark.range(1).select(said.alias("t")).select(*[F.col(f"t.{f.name}").cast(f.dataType).alias(f.name) for f in turns.schema])
    formatted = chat_format.format_turns(turns.unionByName(more))
    return chat_format.digest(formatted, chat_format.expand(formatted))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.array_size("removed")
    n_removed = F.aggregate(F.sequence(F.lit(1), size, F.lit(2)), F.lit(0), lambda a, i: a + F.element_at("removed", i + 1) - F.element_at("removed", i))
    return cleaned.select("row.doc_id", "n_words", F.when(size == 0, 0).otherwise(n_removed).cast("bigint").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), keep_text=False)
    held_out = quality.held_out(F.col("row.doc_id"))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None if books is None else vector_codes.codebooks_digest(books)).cast("string")
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_count": op2_token_count,
        "op3_near_dedup": op3_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_mixing": op5_mixing,
        "op6_search": op6_search,
        "op7_pii": op7_pii,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality": op9_quality,
        "op10_decontamination": op10_decontamination,
        "op11_vector_codes": op11_vector_codes,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_line_dedup": op13_line_dedup,
    }


_OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, length('### ' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\:') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10)) AS n
  FROM turns),
run AS (
  SELECT *, row_number() OVER w AS pos, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM esc
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""

_OP5 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM sizes),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM numbered),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT level AS l FROM levels WHERE w * level < cap ORDER BY cap / w, i LIMIT 1),
plan AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies
  FROM (SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, w * l) END AS target FROM levels LEFT JOIN water ON true)),
budgets AS (SELECT *, target - copies * source_size AS budget FROM plan),
run AS (
  SELECT b.doc_id, b.size, b.h, p.*, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS upto
  FROM base b JOIN budgets p ON b.source IS NOT DISTINCT FROM p.source),
edge AS (SELECT source, min(h) AS h FROM run WHERE upto > budget GROUP BY source),
sums AS (
  SELECT e.source, e.h, max(r.upto) AS upto, sum(r.size) AS n
  FROM edge e JOIN run r ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h GROUP BY e.source, e.h)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN budget > 0 AND (s.h IS NULL OR run.h < s.h OR (run.h = s.h AND s.upto - budget < budget - (s.upto - s.n))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run LEFT JOIN sums s ON run.source IS NOT DISTINCT FROM s.source
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, len(p) AS n, p FROM (
    SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i : i + 9] END AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT doc_id, i, n, w[i : i + n - 1] AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT a.doc_id, a.i, a.n, p.item_id FROM places a JOIN phrases p ON a.n = p.n AND a.p = p.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM places),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _op11() -> str:
    """Lloyd's rounds one after the other, each part compared with all entries."""
    squared = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    ctes = [
        "base AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM base, range(8) AS t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM base ORDER BY vec_id LIMIT 16))",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min(struct_pack(d := {squared}::BIGINT, e := e)) AS near FROM parts JOIN b{k} USING (p) GROUP BY vec_id, p)")
        if k < vector_codes.ROUNDS:
            ctes.append(f"m{k} AS (SELECT p, near.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS y FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL)")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM m{k} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)")
    last = vector_codes.ROUNDS
    ctes.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(c, ',') AS s FROM b{last}))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest"


def _op12() -> str:
    """The edits' program forward over each conversation's rows: per state the cost in six digits and then the letters, so that the least text is the cheapest."""
    bits = "list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
    add = lambda v, cost, letter: f"(lpad((substr({v}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({v}, 7) || '{letter}')"
    far = "'900000'"
    after = {"q0": "q2", "q1": "q2", "q2": "q3", "q3": "q2"}
    more = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"

    def moved(to: str) -> str:
        options = [add(to, 2, "D")]
        for q, t in after.items():
            if t == to:
                options.append(f"CASE WHEN fault NOT IN (1, 2) THEN {add(q, f'1 + {more}', 'R')} ELSE {far} END")
        keeps = {"q1": [("q0", "s")], "q2": [("q0", "u"), ("q1", "u"), ("q3", "u")], "q3": [("q2", "a")]}.get(to, [])
        options += [f"CASE WHEN fault NOT IN (1, 2) AND ini = '{i}' THEN {add(q, more, 'K')} ELSE {far} END" for q, i in keeps]
        return f"least({', '.join(options)}) AS {to}"

    def inserted(q2: str, q3: str) -> str:
        two = f"least({q2}, {add('q0', 5, 'I')}, {add('q1', 5, 'I')}, {add(q3, 5, 'I')})"
        return two

    step1 = f"SELECT r.conv_id, r.k + 1 AS k, {', '.join(moved(q) for q in after)} FROM run r JOIN sym s ON s.conv_id = r.conv_id AND s.k = r.k + 1"
    step2 = f"SELECT conv_id, k, q0, q1, {inserted('q2', 'q3')} AS q2, q3 FROM ({step1})"
    step3 = f"SELECT conv_id, k, q0, q1, q2, least(q3, {add('q2', 5, 'I')}) AS q3 FROM ({step2})"
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    cut = r"right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?')"
    return rf"""
WITH RECURSIVE crcs AS (SELECT list(v ORDER BY n) AS crc FROM (SELECT n, {bits} AS v FROM range(256) AS t(n))),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
sym AS MATERIALIZED (
  SELECT conv_id, k, turn, role, text, left(role, 1) AS ini,
         CASE WHEN {blank} THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN {cut} THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed),
run(conv_id, k, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000', {far}, '000005I', '000010II' FROM conversations
  UNION ALL {step3}),
ended AS (SELECT conv_id, k, least(q0, q3) AS best FROM run QUALIFY k = max(k) OVER (PARTITION BY conv_id)),
letters AS (SELECT conv_id, substr(best, 7) AS audit, unnest(range(1, length(best) - 5)) AS i FROM ended),
edits AS (
  SELECT conv_id, i, substr(audit, i, 1) AS e,
         count(*) FILTER (substr(audit, i, 1) <> 'I') OVER w AS k, count(*) FILTER (substr(audit, i, 1) <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
written AS (
  SELECT e.conv_id, e.i, e.e, e.place, s.role, s.text, max(CASE WHEN e.e = 'K' AND s.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN sym s ON e.e <> 'I' AND s.conv_id = e.conv_id AND s.k = e.k WHERE e.e <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h
  FROM written GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM sym GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       substr(best, 1, 6)::BIGINT AS cost, substr(best, 7) AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ended e LEFT JOIN counts USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": _op11(), "op12_conversation_repair": _op12(), "op13_line_dedup": _OP13, "op3_near_dedup": _OP3, "op8_substring_dedup": _OP8, "op4_chat_format": _OP4, "op5_mixing": _OP5, "op10_decontamination": _OP10}

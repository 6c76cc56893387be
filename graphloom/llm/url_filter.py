"""URL filters: hand-written host/path rules first, then association rules mined by FP-growth.

FP-growth mines token combinations of labelled URLs; rules that lead to the label "block"
are kept above a confidence and a support, and matched through an inverted index: each rule
is filed under its rarest token only, so a URL meets a rule once, and is then checked for the
rule's other tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, lookup, lower_ascii

BLOCKED = "label=block"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path prefix) that fits, as struct(rule, verdict); null if none does."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, host labels with their distance from the end, path words and query keys.

    Digits in a path word become '0', so that serial numbers don't make tokens of their own.
    """
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.filter(F.split(host, "[.]"), lambda x: x != ""))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(4)).cast("string"), F.lit("="), x))
    words = F.transform(F.regexp_extract_all(F.regexp_replace(lower_ascii(path), "[0-9]+", "0"), F.lit("[^/._-]+"), F.lit(0)), lambda x: F.concat(F.lit("p="), x))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"[?]([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    scheme = F.array(F.concat(F.lit("s="), lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(scheme, hosts, words, keys))), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(tokens, bad) -> rules (rule_tokens, rarest, confidence, support) whose tokens foretell ``bad``."""
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", BLOCKED)).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED)).select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support")
    rules = cut(rules)
    seen = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = rules.select("*", F.explode("rule_tokens").alias("token")).join(seen, "token")
    return filed.groupBy("rule_tokens", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (column ``tokens``) with the highest confidence of a rule all of whose tokens they have."""
    sets = urls.select("tokens").distinct()
    filed = F.broadcast(rules) if rules.count() <= SMALL else rules  # a token of every URL then gathers nothing in one task
    hit = sets.select("tokens", F.explode("tokens").alias("rarest")).join(filed, "rarest").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hit.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], min_support: float = 0.005, min_confidence: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence (of the mined rule, else null).

    ``labels``: (id, bad boolean).  A null URL or one without ``://`` has an empty host and path
    and no tokens but its empty scheme; without a matching rule the verdict is allow.  With no
    labelled page nothing is mined.  Repeated pages are judged alike; other columns are not read.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    p = p.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), tokens(F.col("_url")).alias("tokens"))
    taught = p.join(labels.select(F.col(labels.columns[0]).alias("page_id"), F.col(labels.columns[1]).alias("bad")).where("bad is not null"), "page_id").select("tokens", "bad")
    taught = cut(taught)
    out = p.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    if taught.where("bad").isEmpty():
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    else:
        found = cut(match(p, cut(mine(taught, min_support, min_confidence))))
        out = lookup(out, found, "tokens", "page_id")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), mined).alias("verdict"), "confidence")

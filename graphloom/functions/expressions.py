"""Functions on terms, as columns.  An argument that a function cannot take gives null, which is "unbound"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BAD_IRI, XSD, datatype, iri_col, is_blank, is_iri, is_literal, lang, lexical, literal_col, number, plain


def _like(text: Column, term: Column) -> Column:
    """``text`` as a literal with the language tag of ``term``, if it has one."""
    tag = lang(term)
    return F.when(tag != "", F.concat(literal_col(text), F.lit("@"), tag)).otherwise(literal_col(text))


def typed(value: Column, kind: str) -> Column:
    return literal_col(value, XSD + kind)


def truth(value: Column) -> Column:
    return typed(value.cast("string"), "boolean")


# --- strings


def strlen(t: Column) -> Column:
    return typed(F.length(lexical(t)), "integer")


def substr(t: Column, start: int, length: int | None = None) -> Column:
    return _like(F.substring(lexical(t), start, length if length is not None else 1 << 30), t)


def ucase(t: Column) -> Column:
    return _like(F.upper(lexical(t)), t)


def lcase(t: Column) -> Column:
    return _like(F.lower(lexical(t)), t)


def contains(t: Column, part: Column) -> Column:
    return lexical(t).contains(lexical(part))


def strstarts(t: Column, part: Column) -> Column:
    return plain(t).startswith(plain(part))


def strends(t: Column, part: Column) -> Column:
    return lexical(t).endswith(lexical(part))


def strbefore(t: Column, part: Column) -> Column:
    at = F.position(lexical(part), lexical(t))
    return F.when(at > 0, _like(F.substring(lexical(t), F.lit(1), at - 1), t)).otherwise(literal_col(F.lit("")))


def strafter(t: Column, part: Column) -> Column:
    at = F.position(lexical(part), lexical(t))
    return F.when(at > 0, _like(F.substring(lexical(t), at + F.length(lexical(part)), F.length(lexical(t))), t)).otherwise(literal_col(F.lit("")))


def concat(*terms: Column) -> Column:
    return literal_col(F.concat(*map(lexical, terms)))


def replace(t: Column, regex: str, by: str) -> Column:
    return _like(F.regexp_replace(lexical(t), regex, by), t)


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    return lexical(t).rlike(f"(?{flags}){pattern}" if flags else pattern)


def encode_for_uri(t: Column) -> Column:
    return literal_col(F.replace(F.url_encode(lexical(t)), F.lit("+"), F.lit("%20")))


# --- numbers, dates, hashes


def numeric(t: Column, f) -> Column:
    """``f`` (abs, ceil, floor, round, or arithmetic) on the number of a term, as a decimal or double column."""
    return f(number(t))


def moment(t: Column) -> Column:
    return lexical(t).try_cast("timestamp")


def year(t: Column) -> Column:
    return F.year(moment(t))


def month(t: Column) -> Column:
    return F.month(moment(t))


def day(t: Column) -> Column:
    return F.dayofmonth(moment(t))


def hours(t: Column) -> Column:
    return F.hour(moment(t))


def minutes(t: Column) -> Column:
    return F.minute(moment(t))


def seconds(t: Column) -> Column:
    """With the fraction, as a decimal."""
    return F.date_part(F.lit("SECONDS"), moment(t))


def tz(t: Column) -> Column:
    """The zone as it is written: Z, an offset, or the empty literal."""
    return literal_col(F.when(moment(t).isNotNull(), F.regexp_extract(lexical(t), r"(Z|[+-]\d\d:\d\d)$", 1)))


def now() -> Column:
    """The moment at which the query began."""
    return literal_col(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), f"{XSD}dateTime")


def digest(t: Column, name: str = "sha256") -> Column:
    text = lexical(t)
    return literal_col({"md5": F.md5, "sha1": F.sha1}[name](text) if name in ("md5", "sha1") else F.sha2(text, int(name[3:])))


# --- terms


def same_term(a: Column, b: Column) -> Column:
    return a == b


def equal(a: Column, b: Column) -> Column:
    """Values that are equal: numbers by their value, all else as terms."""
    x, y = number(a), number(b)
    both = is_literal(a) & is_literal(b) & x.isNotNull() & y.isNotNull() & ~datatype(a).endswith("string") & ~datatype(b).endswith("string")
    return F.when(both, x == y).otherwise(a == b)


def same_value(t: Column) -> Column:
    """A text that two terms share if ``equal`` holds of them, and only then."""
    n = number(t)
    return F.when(is_literal(t) & n.isNotNull() & ~datatype(t).endswith("string"), F.concat(F.lit("#"), (n + 0.0).cast("string"))).otherwise(t)


def lang_matches(t: Column, wanted: str) -> Column:
    tag = F.lower(lang(t))
    return tag != "" if wanted == "*" else (tag == wanted.lower()) | tag.startswith(wanted.lower() + "-")


def str_dt(t: Column, kind: str) -> Column:
    return literal_col(lexical(t), kind)


def str_lang(t: Column, tag: str) -> Column:
    return literal_col(lexical(t), lang=tag)


def to_iri(t: Column, base: str = "") -> Column:
    """An IRI of an IRI or a plain literal; a text without a scheme is put after ``base``."""
    text = lexical(t)
    whole = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(base), text))
    return F.when(t.startswith("<"), t).when(~text.rlike(BAD_IRI), iri_col(whole))


def bnode(*key: Column) -> Column:
    """A blank node that is the same for rows with the same key and differs for others."""
    return F.concat(F.lit("_:b"), F.substring(F.sha2(F.to_json(F.struct(*key)), 256), 1, 16))


def is_numeric(t: Column) -> Column:
    kinds = [XSD + k for k in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
    return datatype(t).isin(*kinds) & number(t).isNotNull()


def first_bound(*terms: Column) -> Column:
    return F.coalesce(*terms)


def one_of(t: Column, *terms: Column) -> Column:
    return reduce(lambda a, b: a | b, [equal(t, x) for x in terms], F.lit(False))


# --- aggregates over a column of terms


def total(t: Column) -> Column:
    """SUM; an error, and so null, where a term is no number."""
    return F.when(F.count_if(t.isNotNull() & number(t).isNull()) == 0, F.coalesce(F.sum(number(t)), F.lit(0.0)))


def average(t: Column) -> Column:
    return F.when(F.count_if(t.isNotNull() & number(t).isNull()) == 0, F.coalesce(F.avg(number(t)), F.lit(0.0)))


def sample(t: Column) -> Column:
    """The least term, so that reruns agree."""
    return F.min(t)


def group_concat(t: Column, between: str = " ") -> Column:
    """The texts of a group's terms, sorted, as one literal; a group's texts must fit in one row."""
    return literal_col(F.array_join(F.sort_array(F.collect_list(plain(t))), between))


KIND_TESTS = {"iri": is_iri, "blank": is_blank, "literal": is_literal, "numeric": is_numeric}

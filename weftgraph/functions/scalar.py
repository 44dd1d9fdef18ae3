"""Scalar functions on TERM columns. A null result is an error, which filters take as false and BIND as unbound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.terms import BNODE, INTEGERS, IRI, LITERAL, NUMERICS, XSD, iri, literal, term


def c(x: Column | str) -> Column:
    return F.col(x.lstrip("?")) if isinstance(x, str) else x


def lex(x) -> Column:
    """STR(): the lexical form of a literal, the IRI of an IRI; an error for blank nodes."""
    t = c(x)
    return F.when(t["kind"] != BNODE, t["lex"])


def string(x) -> Column:
    """The lexical form of a string literal, plain or with a language; else an error."""
    t = c(x)
    return F.when((t["kind"] == LITERAL) & (t["lang"].isNotNull() | (t["dt"] == XSD + "string")), t["lex"])


def number(x) -> Column:
    """The value of a numeric literal as a double."""
    t = c(x)
    return F.when((t["kind"] == LITERAL) & t["dt"].isin(*NUMERICS), t["lex"].try_cast("double"))


def integer(x) -> Column:
    """The value of an integer literal as a long."""
    t = c(x)
    return F.when((t["kind"] == LITERAL) & t["dt"].isin(*INTEGERS), t["lex"].try_cast("bigint"))


def decimal(x) -> Column:
    t = c(x)
    return F.when((t["kind"] == LITERAL) & t["dt"].isin(*NUMERICS), t["lex"].try_cast("decimal(38,10)"))


def boolean(x) -> Column:
    t = c(x)
    return F.when((t["kind"] == LITERAL) & (t["dt"] == XSD + "boolean"), t["lex"].isin("true", "1"))


def timestamp(x) -> Column:
    t = c(x)
    return F.when((t["kind"] == LITERAL) & t["dt"].isin(XSD + "dateTime", XSD + "date"), F.try_to_timestamp(t["lex"]))


def truth(x) -> Column:
    """The effective boolean value: of booleans, numbers (not 0, not NaN) and strings (not empty)."""
    t = c(x)
    return F.coalesce(boolean(t), F.when(number(t).isNotNull(), (number(t) != 0) & ~F.isnan(number(t))), F.length(string(t)) > 0)


def both(a: Column, b: Column) -> Column:
    return a & b


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """IF: an error in the condition is an error."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def same_term(a, b) -> Column:
    return c(a) == c(b)


def equal(a, b) -> Column:
    """=: by value for numbers, booleans and times, else by term; literals of unlike unknown types are an error."""
    x, y = c(a), c(b)
    plain = (x["kind"] != LITERAL) | (y["kind"] != LITERAL) | string(x).isNotNull() & string(y).isNotNull()
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None))
        .when(number(x).isNotNull() & number(y).isNotNull(), number(x) == number(y))
        .when(boolean(x).isNotNull() & boolean(y).isNotNull(), boolean(x) == boolean(y))
        .when(timestamp(x).isNotNull() & timestamp(y).isNotNull(), timestamp(x) == timestamp(y))
        .when((x == y) | plain, x == y)
    )


def less(a, b) -> Column:
    x, y = c(a), c(b)
    return F.coalesce(number(x) < number(y), timestamp(x) < timestamp(y), string(x) < string(y), boolean(x) < boolean(y))


def is_in(a, *options) -> Column:
    return reduce(lambda p, q: p | q, (equal(a, o) for o in options), F.lit(False))


def bound(x) -> Column:
    return c(x).isNotNull()


def is_iri(x) -> Column:
    return c(x)["kind"] == IRI


def is_blank(x) -> Column:
    return c(x)["kind"] == BNODE


def is_literal(x) -> Column:
    return c(x)["kind"] == LITERAL


def is_numeric(x) -> Column:
    return F.when(c(x).isNotNull(), number(x).isNotNull())


def lang(x) -> Column:
    t = c(x)
    return F.when(t["kind"] == LITERAL, F.coalesce(t["lang"], F.lit("")))


def lang_matches(tag: Column, wanted: str) -> Column:
    if wanted == "*":
        return tag != ""
    low = F.lower(tag)
    return (low == wanted.lower()) | low.startswith(wanted.lower() + "-")


def datatype(x) -> Column:
    t = c(x)
    return F.when(t["kind"] == LITERAL, iri(t["dt"]))


def to_iri(text: Column) -> Column:
    return iri(text)


def with_lang(text: Column, tag: str) -> Column:
    return term(F.lit(LITERAL), text, F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), F.lit(tag))


def with_type(text: Column, dt: str) -> Column:
    return literal(text, dt)


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """The characters from place start, counted from 1, to before start + length; places before the first are none."""
    first = max(1, start)
    return F.substring(text, first, (1 << 30) if length is None else max(0, start + length - first))


def before(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.left(text, at - 1)).when(text.isNotNull(), F.lit(""))


def after(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).when(text.isNotNull(), F.lit(""))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, f"(?{flags}){pattern}" if flags else pattern, by)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def timezone(x) -> Column:
    """TZ(): the zone of a dateTime as written, or an empty string."""
    return F.regexp_extract(c(x)["lex"], r"(Z|[+-]\d\d:\d\d)$", 1)


def hash_of(text: Column, kind: str) -> Column:
    return {"md5": F.md5, "sha1": F.sha1}[kind](text) if kind in ("md5", "sha1") else F.sha2(text, int(kind[3:]))


def encode_for_uri(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def sort_key(x) -> Column:
    """Orders terms as ORDER BY does: unbound, blank nodes, IRIs, literals; numbers by value, before others."""
    t = c(x)
    rank = F.when(t.isNull(), 0).when(t["kind"] == BNODE, 1).when(t["kind"] == IRI, 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.when(number(t).isNull(), 1).otherwise(0).alias("no_number"), number(t).alias("value"), t["lex"].alias("lex"))


def least_term(x) -> Column:
    """MIN of terms by sort_key; unbound ones do not count."""
    return F.min_by(c(x), F.when(c(x).isNotNull(), sort_key(x)))


def greatest_term(x) -> Column:
    return F.max_by(c(x), F.when(c(x).isNotNull(), sort_key(x)))


def _exact(value: Column, dt: str) -> Column:
    """A decimal's shortest form as a literal."""
    text = F.regexp_replace(value.cast("string"), r"\.?0+$", "") if dt == XSD + "decimal" else value.cast("string")
    text = F.when(value.cast("string").contains("."), text).otherwise(value.cast("string"))
    return literal(text, dt)


def _added(x, mean: bool) -> Column:
    """Integers, decimals and doubles are added apart, so that each sum is exact for its type; the widest type that a
    group has is the result's."""
    t = c(x)
    is_number = (t["kind"] == LITERAL) & t["dt"].isin(*NUMERICS)
    whole, wide = t["dt"].isin(*INTEGERS), t["dt"].isin(XSD + "double", XSD + "float")
    value = lambda kind: t["lex"].try_cast(kind)
    right = F.coalesce(is_number & F.when(whole, value("decimal(38,0)").isNotNull()).when(wide, value("double").isNotNull()).otherwise(value("decimal(38,10)").isNotNull()), F.lit(False))
    n, n_whole, n_wide = F.count(t), F.count_if(right & whole), F.count_if(right & wide)
    zero = lambda kind: F.lit(0).cast(kind)
    ints = F.coalesce(F.sum(F.when(right & whole, value("decimal(38,0)"))), zero("decimal(38,0)"))
    decimals = F.coalesce(F.sum(F.when(right & ~whole & ~wide, value("decimal(38,10)"))), zero("decimal(38,10)"))
    doubles = F.coalesce(F.sum(F.when(right & wide, value("double"))), F.lit(0.0)) + ints.cast("double") + decimals.cast("double")
    exact = (ints.cast("decimal(38,10)") + decimals).cast("decimal(38,10)")
    if mean:
        by = F.when(n > 0, n)
        typed = F.when(n_wide > 0, literal(doubles / by, XSD + "double")).otherwise(_exact((exact / by.cast("decimal(20,0)")).cast("decimal(38,10)"), XSD + "decimal"))
        typed = F.when(n == 0, literal(F.lit("0"), XSD + "integer")).otherwise(typed)
    else:
        typed = F.when(n_wide > 0, literal(doubles, XSD + "double")).when(n_whole == n, _exact(ints, XSD + "integer")).otherwise(_exact(exact, XSD + "decimal"))
    return F.when(F.count_if(t.isNotNull() & ~right) == 0, typed)


def total(x) -> Column:
    """SUM as a term: an integer of integers (exact to 38 digits), a decimal if there are decimals, a double if there are
    doubles; 0 of nothing. A value that is no number is an error. Unbound ones do not count."""
    return _added(x, False)


def mean(x) -> Column:
    """AVG as a term: a decimal of integers and decimals (ten places), a double if there are doubles; 0 of nothing."""
    return _added(x, True)


def group_concat(text: Column, separator: str = " ") -> Column:
    """Texts of a group in sorted order."""
    return F.array_join(F.array_sort(F.collect_list(text)), separator)


def sample(x) -> Column:
    return least_term(x)


def now() -> Column:
    """The query's time as a dateTime literal."""
    return literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), XSD + "dateTime")


def uuid_iri() -> Column:
    return iri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def uuid_text() -> Column:
    return F.uuid()


def new_bnode(*variables: str) -> Column:
    """BNODE(): a blank node for each different solution of some variables."""
    return term(F.lit(BNODE), F.sha2(F.to_json(F.struct(*(c(v) for v in variables))), 256))

"""The scalar functions of the query language, as columns: every one stays inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .typed import BOOL, DOUBLE, LONG, STRING, Typed, element, items, null, number, text, to_common

FUNCTIONS: dict[str, Callable[..., Typed]] = {}
WHITE = r"[\s\x85\p{Z}]"


class FunctionProblem(ValueError):
    """A function that doesn't exist, or that isn't called with so many arguments."""


def function(*names: str):
    def keep(f: Callable[..., Typed]):
        for n in names:
            FUNCTIONS[n.lower()] = f
        return f

    return keep


def call(name: str, args: list[Typed], now: Column) -> Typed:
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise FunctionProblem(f"unknown function {name}")
    try:
        return f(*args, now=now) if getattr(f, "timed", False) else f(*args)
    except TypeError as e:
        raise FunctionProblem(f"{name}: {e}") from e


def timed(f):
    f.timed = True
    return f


# strings


@function("toUpper", "upper")
def to_upper(s: Typed) -> Typed:
    return Typed(F.upper(text(s)), STRING)


@function("toLower", "lower")
def to_lower(s: Typed) -> Typed:
    return Typed(F.lower(text(s)), STRING)


@function("trim")
def trim(s: Typed) -> Typed:
    return Typed(F.regexp_replace(text(s), f"^{WHITE}+|{WHITE}+$", ""), STRING)


@function("ltrim")
def ltrim(s: Typed) -> Typed:
    return Typed(F.ltrim(text(s), F.lit(" \t")), STRING)


@function("rtrim")
def rtrim(s: Typed) -> Typed:
    return Typed(F.rtrim(text(s), F.lit(" \t")), STRING)


@function("reverse")
def reverse(s: Typed) -> Typed:
    return Typed(F.reverse(s.col), s.kind) if s.is_list else Typed(F.reverse(text(s)), STRING)


@function("size", "length")
def size(x: Typed) -> Typed:
    if x.is_list:
        return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("long"), LONG)
    if isinstance(x.kind, T.StructType) and "length" in x.kind.names:  # a path
        return Typed(x.col["length"].cast("long"), LONG)
    return Typed(F.char_length(text(x)).cast("long"), LONG)


@function("byteSize")
def byte_size(x: Typed) -> Typed:
    return Typed(F.octet_length(text(x)).cast("long"), LONG)


@function("toString")
def to_string(x: Typed) -> Typed:
    return Typed(text(x), STRING)


@function("substring")
def substring(s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    first = F.greatest(start.col.cast("int"), F.lit(0))
    count = F.lit(2**31 - 1) if length is None else F.greatest(length.col.cast("int"), F.lit(0))
    return Typed(F.substring(text(s), first + 1, count), STRING)


@function("replace")
def replace(s: Typed, a: Typed, b: Typed) -> Typed:
    # an empty search goes between all characters
    between = F.concat(text(b), F.array_join(F.split(text(s), "(?!^)"), "\x00"), text(b))
    between = F.replace(between, F.lit("\x00"), text(b))
    plain = F.replace(text(s), text(a), text(b))
    return Typed(F.when(text(a) == "", F.when(text(s) == "", text(b)).otherwise(between)).otherwise(plain), STRING)


@function("split")
def split(s: Typed, d: Typed) -> Typed:
    quoted = F.concat(F.lit("\\Q"), F.replace(text(d), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Typed(F.when(text(d) == "", F.split(text(s), "(?!^)")).otherwise(F.split(text(s), quoted)), T.ArrayType(STRING))


@function("left")
def left(s: Typed, n: Typed) -> Typed:
    return Typed(F.left(text(s), F.greatest(n.col.cast("int"), F.lit(0))), STRING)


@function("right")
def right(s: Typed, n: Typed) -> Typed:
    return Typed(F.right(text(s), F.greatest(n.col.cast("int"), F.lit(0))), STRING)


@function("join")
def join(values: Typed, d: Typed) -> Typed:
    inner = element(values)
    joined = F.transform(items(values), lambda v: F.coalesce(text(Typed(v, inner)), F.lit("<nil>")))
    return Typed(F.aggregate(joined, F.lit(None).cast("string"), lambda a, v: F.when(a.isNull(), v).otherwise(F.concat(a, text(d), v)), lambda a: F.coalesce(a, F.lit(""))), STRING)


# conversion


@function("toInteger", "toInt")
def to_integer(x: Typed) -> Typed:
    if x.is_text:
        return Typed(F.coalesce(x.col.try_cast("long"), _whole(x.col.try_cast("double"))), LONG)
    return Typed(_whole(number(x)), LONG)


def _whole(d: Column) -> Column:
    return d.try_cast("decimal(38,6)").try_cast("long")


@function("toFloat")
def to_float(x: Typed) -> Typed:
    return Typed(number(x), DOUBLE)


@function("toBoolean")
def to_boolean(x: Typed) -> Typed:
    if isinstance(x.kind, T.BooleanType):
        return x
    low = F.lower(text(x))
    return Typed(F.when(low == "true", True).when(low == "false", False), BOOL)


@function("coalesce")
def coalesce(*values: Typed) -> Typed:
    columns, kind = to_common(list(values))
    return Typed(F.coalesce(*columns), kind)


# mathematics: everything is a double

for _name, _f in {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "round": F.round,
}.items():
    FUNCTIONS[_name] = lambda x, f=_f: Typed(f(number(x)).cast("double"), DOUBLE)


def _logarithm(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    """IEEE results outside the domain: minus infinity at zero, NaN below."""
    return lambda x: Typed(F.when(number(x) > 0, f(number(x))).when(number(x) == 0, F.lit(float("-inf"))).when(number(x).isNotNull(), F.lit(float("nan"))), DOUBLE)


FUNCTIONS["log"] = FUNCTIONS["ln"] = _logarithm(F.ln)
FUNCTIONS["log10"] = _logarithm(F.log10)


@function("pow")
def power(a: Typed, b: Typed) -> Typed:
    return Typed(F.pow(number(a), number(b)), DOUBLE)


@function("rand")
def rand() -> Typed:
    return Typed(F.rand(), DOUBLE)


@function("pi")
def pi() -> Typed:
    return Typed(F.pi(), DOUBLE)


@function("e")
def e() -> Typed:
    return Typed(F.e(), DOUBLE)


# time: dates and times are ISO text on the surface

_LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def instant(x: Typed) -> Column:
    """A timestamp of a time or of text in one of the known layouts; null otherwise."""
    if x.is_time:
        return x.col.cast("timestamp_ntz")
    s = text(x)
    iso = F.regexp_replace(s, r"(\.\d+)?(Z|[+-]\d\d:\d\d)$", "")
    known = s.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$")
    plain = iso.try_cast("timestamp_ntz")
    zone = F.regexp_extract(s, r"([+-])(\d\d):(\d\d)$", 0)
    minutes = F.when(zone == "", 0).otherwise((F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int")) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    return F.when(known, plain - F.make_interval(mins=minutes))


@function("timestamp")
@timed
def timestamp(now: Column) -> Typed:
    return Typed(F.unix_millis(now.cast("timestamp")), LONG)


@function("date")
@timed
def date(s: Typed | None = None, *, now: Column) -> Typed:
    return Typed(F.date_format(now if s is None else instant(s), "yyyy-MM-dd"), STRING)


@function("datetime")
@timed
def datetime(s: Typed | None = None, *, now: Column) -> Typed:
    shape = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    if s is None:
        return Typed(F.date_format(now, shape), STRING)
    return Typed(F.coalesce(F.date_format(instant(s), shape), text(s)), STRING)


@function("localdatetime")
@timed
def localdatetime(s: Typed | None = None, *, now: Column) -> Typed:
    return Typed(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss") if s is None else text(s), STRING)


@function("localtime", "time")
@timed
def time(s: Typed | None = None, *, now: Column) -> Typed:
    return Typed(F.date_format(now, "HH:mm:ss") if s is None else text(s), STRING)


COMPONENTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "millisecond": lambda t: F.date_format(t, "SSS").cast("int"), "dayofweek": lambda t: F.dayofweek(t) - 1, "dayofyear": F.dayofyear,
}


def component(x: Typed, name: str) -> Typed | None:
    """A part of a time, or of text that is one; Sunday is day 0 of the week."""
    f = COMPONENTS.get(name.lower())
    return Typed(f(instant(x)).cast("long"), LONG) if f and (x.is_text or x.is_time) else None


# lists


@function("range")
def range_(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    low, high = a.col.cast("long"), b.col.cast("long")
    by = F.lit(1).cast("long") if step is None else F.when(step.col.cast("long") == 0, F.lit(1)).otherwise(step.col).cast("long")
    right_way = ((by > 0) & (low <= high)) | ((by < 0) & (low >= high))
    # the ends are turned where the direction is wrong, since the sequence is built before the choice
    return Typed(F.when(right_way, F.sequence(low, F.when(right_way, high).otherwise(low), by)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


@function("head")
def head(x: Typed) -> Typed:
    return Typed(F.get(items(x), F.lit(0)), element(x))


@function("last")
def last(x: Typed) -> Typed:
    return Typed(F.get(items(x), F.size(items(x)) - 1), element(x))


@function("nodes")
def nodes(p: Typed) -> Typed:
    return Typed(p.col["node_ids"], p.kind["node_ids"].dataType) if isinstance(p.kind, T.StructType) and "node_ids" in p.kind.names else null()


@function("exists")
def exists(x: Typed) -> Typed:
    return Typed(x.col.isNotNull(), BOOL)

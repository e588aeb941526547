"""A column with its type as far as it is known, and the coercions of the query language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE, LONG, STRING, BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: T.DataType | None = None

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, (T.StringType, T.CharType, T.VarcharType))

    @property
    def is_number(self) -> bool:
        return isinstance(self.kind, T.NumericType)

    @property
    def is_list(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def is_null(self) -> bool:
        return isinstance(self.kind, T.NullType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def null() -> Typed:
    return Typed(F.lit(None), T.NullType())


def number(x: Typed) -> Column:
    """As a double; numeric strings count, anything else is null."""
    if x.is_number:
        return x.col.cast("double")
    if x.is_text or x.kind is None:
        return x.col.cast("string").try_cast("double")
    return F.lit(None).cast("double")


def text(x: Typed) -> Column:
    """As text: whole numbers without a fraction, times in ISO form, lists in brackets."""
    if x.is_text:
        return x.col
    if isinstance(x.kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(x.col.cast("string"), r"\.0$", "")
    if isinstance(x.kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(x.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return x.col.cast("string")


def items(x: Typed) -> Column:
    return x.col if x.is_list else F.lit(None).cast("array<string>")


def element(x: Typed) -> T.DataType | None:
    return x.kind.elementType if isinstance(x.kind, T.ArrayType) else None


def common(kinds: list[T.DataType | None]) -> T.DataType | None:
    """The type that values of all these take together: numbers widen, nulls follow, anything mixed is text."""
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if not known:
        return T.NullType()
    if any(k is None for k in known):
        return None
    if all(k == known[0] for k in known):
        return known[0]
    if all(isinstance(k, T.NumericType) for k in known):
        return DOUBLE if any(isinstance(k, (T.FractionalType,)) for k in known) else LONG
    return STRING


def to_common(values: list[Typed]) -> tuple[list[Column], T.DataType | None]:
    kind = common([v.kind for v in values])
    if kind is None:
        return [v.col for v in values], None
    if kind == STRING:
        return [text(v) for v in values], STRING
    return [v.col if v.kind == kind else v.col.cast(kind) for v in values], kind

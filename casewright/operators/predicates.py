"""Row predicates over stored events. Every predicate is two-valued, so NOT never turns an absent value into
an unknown: a leaf over a missing field is false.

A dotted path that passes through an array fans out: the predicate holds when any element satisfies it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import net
from casewright.schema import STORED_EVENT

Leaf = Callable[[Column, T.DataType], Column]
OPEN_PREFIX = "unmapped."


class UnknownPath(ValueError):
    """A path that no stored event can have."""


@dataclass(frozen=True)
class Path:
    """A resolved path: its column, the type of one value, and whether it fans out over an array."""

    column: Column
    value_type: T.DataType
    fans_out: bool


def located(path: str, schema: T.StructType = STORED_EVENT) -> tuple[T.DataType, bool]:
    """The type of one value at ``path`` and whether it fans out; needs no session."""
    if path.startswith(OPEN_PREFIX):
        return T.StringType(), False
    kind: T.DataType = schema
    fans_out = False
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            fans_out, kind = True, kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise UnknownPath(f"unknown field '{path}'")
        kind = kind[part].dataType
    if isinstance(kind, T.ArrayType):
        fans_out, kind = True, kind.elementType
    if isinstance(kind, (T.StructType, T.MapType)):
        raise UnknownPath(f"'{path}' is not a single value")
    return kind, fans_out


def resolve(path: str, schema: T.StructType = STORED_EVENT) -> Path:
    """Find ``path`` in the schema; ``unmapped.<key>`` is the only free-form part."""
    kind, fans_out = located(path, schema)
    if path.startswith(OPEN_PREFIX):
        return Path(F.try_element_at(F.col("unmapped"), F.lit(path[len(OPEN_PREFIX) :])), kind, fans_out)
    return Path(F.col(path), kind, fans_out)


def values_at(path: str) -> Column:
    """Every value at ``path`` as an array; nulls yield nothing."""
    found = resolve(path)
    return F.array_compact(found.column if found.fans_out else F.array(found.column))


def first_value(path: str) -> Column:
    """The first value at ``path`` as text, null when there is none."""
    found = resolve(path)
    value = F.get(F.array_compact(found.column), F.lit(0)) if found.fans_out else found.column
    return as_text(value, found.value_type)


def as_text(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, T.StringType) else value.cast("string")


def field_match(paths: Sequence[str], leaf: Leaf) -> Column:
    """True when any value at any of the paths satisfies the leaf."""

    def one(path: str) -> Column:
        found = resolve(path)
        if found.fans_out:
            test = F.exists(found.column, lambda v: F.coalesce(leaf(v, found.value_type), F.lit(False)))
        else:
            test = leaf(found.column, found.value_type)
        return F.coalesce(test, F.lit(False))

    return any_of([one(path) for path in paths])


def field_exists(paths: Sequence[str], expected: bool = True) -> Column:
    """Whether any path has a value."""
    present = field_match(paths, lambda value, kind: value.isNotNull())
    return present if expected else ~present


def field_is_null(paths: Sequence[str]) -> Column:
    return field_exists(paths, False)


def all_of(children: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, children) if children else F.lit(True)


def any_of(children: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, children) if children else F.lit(False)


def negate(child: Column) -> Column:
    return ~child


# ---------------------------------------------------------------------------------------------------- leaves
def glob(pattern: str, *, cased: bool = False, open_start: bool = False, open_end: bool = False) -> Leaf:
    """Whole-value match with ``*`` and ``?``; a backslash keeps the next wildcard literal.

    The common shapes become contains, startswith, endswith or equality on the lowered value; only a wildcard
    in the middle needs a regular expression. ``open_start``/``open_end`` allow anything before or after.
    """
    tokens = [*(["*"] if open_start else []), *_glob_tokens(pattern), *(["*"] if open_end else [])]

    def leaf(value: Column, kind: T.DataType) -> Column:
        text = as_text(value, kind)
        return _glob_test(text if cased else F.lower(text), tokens, cased)

    return leaf


def _glob_tokens(pattern: str) -> list[str | tuple[str]]:
    """The pattern as literal runs (in one-element tuples) and the wildcards ``*`` and ``?``."""
    tokens: list[str | tuple[str]] = []
    literal = ""
    escaped = False
    for char in pattern:
        if escaped:
            literal += char if char in "*?\\" else "\\" + char
            escaped = False
        elif char == "\\":
            escaped = True
        elif char in "*?":
            if literal:
                tokens.append((literal,))
            literal = ""
            tokens.append(char)
        else:
            literal += char
    literal += "\\" if escaped else ""
    if literal:
        tokens.append((literal,))
    return tokens


def _glob_test(text: Column, tokens: list, cased: bool) -> Column:
    fold = (lambda s: s) if cased else str.lower
    squeezed = [t for i, t in enumerate(tokens) if not (t == "*" and i and tokens[i - 1] == "*")]
    literals = [fold(t[0]) for t in squeezed if isinstance(t, tuple)]
    shape = "".join("L" if isinstance(t, tuple) else t for t in squeezed)
    if shape == "":
        return text == ""
    if shape == "*":
        return text.isNotNull()
    if shape == "L":
        return text == literals[0]
    if shape == "*L*":
        return text.contains(literals[0])
    if shape == "L*":
        return text.startswith(literals[0])
    if shape == "*L":
        return text.endswith(literals[0])
    body = "".join(_java_quote(fold(t[0])) if isinstance(t, tuple) else {"*": ".*", "?": "."}[t] for t in squeezed)
    return text.rlike(rf"(?s)\A{body}\z")


def _java_quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", text)


def regex(pattern: str, flags: str = "") -> Leaf:
    """An unanchored search; ``flags`` out of i, m and s."""
    prefix = f"(?{''.join('iu' if f == 'i' else f for f in flags)})" if flags else ""
    return lambda value, kind: as_text(value, kind).rlike(prefix + pattern)


def _number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    return F.trim(value).try_cast("double") if isinstance(kind, T.StringType) else value.cast("double")


def number_equals(number: float) -> Leaf:
    """Numeric equality; numeric text counts, booleans do not."""
    return lambda value, kind: _number(value, kind) == F.lit(float(number))


def number_compare(op: str, number: float) -> Leaf:
    """``lt``, ``lte``, ``gt``, ``gte`` or ``neq``; what is not a number never matches."""
    tests = {
        "lt": lambda a, b: a < b,
        "lte": lambda a, b: a <= b,
        "gt": lambda a, b: a > b,
        "gte": lambda a, b: a >= b,
        "neq": lambda a, b: a != b,
    }
    return lambda value, kind: tests[op](_number(value, kind), F.lit(float(number)))


def bool_equals(expected: bool) -> Leaf:
    return lambda value, kind: (value == F.lit(expected)) if isinstance(kind, T.BooleanType) else F.lit(False)


def cidr(network: str) -> Leaf:
    return lambda value, kind: net.in_network(as_text(value, kind), network)


def external_ip() -> Leaf:
    return lambda value, kind: net.is_external_ip(as_text(value, kind))


def equals(expected: object) -> Leaf:
    """Numbers compare as numbers, text without case, booleans only with booleans."""
    if isinstance(expected, bool):
        return bool_equals(expected)
    if isinstance(expected, (int, float)):

        def numeric(value: Column, kind: T.DataType) -> Column:
            # Integer columns compare as integers, so the test can be pushed into the scan.
            if isinstance(kind, (T.IntegerType, T.LongType)) and float(expected).is_integer():
                return value == F.lit(int(expected))
            return number_equals(expected)(value, kind)

        return numeric

    def text(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BooleanType):
            return F.lit(False)
        return F.lower(as_text(value, kind)) == F.lit(str(expected).lower())

    return text


def is_successful_logon() -> Column:
    """A logon that succeeded: class 3002, activity 1, status 1."""
    return (F.col("class_uid") == 3002) & (F.col("activity_id") == 1) & (F.col("status_id") == 1)

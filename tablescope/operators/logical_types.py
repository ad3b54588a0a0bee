"""Semantic column types: ordered rules, each an aggregate over a bounded head of the table.

All columns are checked in one aggregation (a few for very wide tables). A rule matches a column
that has values, all of which pass it; the first match in order of priority names the column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INSTANTS, is_boolean, is_floating, is_integer, is_string, named, quoted

# The patterns, vocabularies, labels and their order decide results.
PATTERNS = {
    "CreditCard": r"^(?:\d{4}[-\s]?){3}\d{4}$|^\d{15,16}$",
    "SSN": r"^[1-8]\d{2}[-\s]?\d{2}[-\s]?\d{4}$",
    "Email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$",
    "SWIFT": r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$",
    "TaxID": r"^\d{2}-\d{7}$",
    "ISIN": r"^[A-Z]{2}[A-Z0-9]{9}\d$",
    "JSON": r"^\s*(?:\{.*\}|\[.*\])\s*$",
    "URL": r"^(?:http|ftp)s?://(?:(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:[a-zA-Z]{2,6}\.?|[a-zA-Z0-9-]{2,}\.?)|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$",
    "IPAddress": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$|^(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}$|^::1$|^([a-fA-F0-9]{1,4}:){1,7}:|^:([a-fA-F0-9]{1,4}:){1,7}|^[a-fA-F0-9]{1,4}(:[a-fA-F0-9]{1,4}){0,6}::([a-fA-F0-9]{1,4}(:[a-fA-F0-9]{1,4}){0,6})?$",
    "DateTime": r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$",
    "USZipCode": r"^\d{5}(?:-\d{4})?$",
    "PhoneNumber": r"^(?:\+?[0-9]{1,3}[-.\s]?)?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}(?:[-.\s]?[0-9]{1,9})?$",
    "MACAddress": r"^(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})$",
    "CountryCode": r"^[A-Z]{2,3}$",
    "FilePath": r"^(?:\/|[a-zA-Z]:\\|s3:\/\/|gs:\/\/).+$",
    "Complex": r"^-?\d+(?:\.\d+)?(?:[+-]\d+(?:\.\d+)?)?j$",
    "Geometry": r"(?i)^(?:POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s?\(.+\)$",
    "Currency": r"^[$€£¥]\s?-?\d+(?:,\d{3})*(?:\.\d{2})?$",
    "Count": r"^\d+$",
    "UUID": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "CUID": r"^c[a-z0-9]{24}$",
    "NanoID": r"^[a-zA-Z0-9_-]{21}$",
    "Passport": r"^[A-Z0-9]{6,9}$",
    "LanguageCode": r"^[a-z]{2}$",
    "Integer": r"^-?\d+$",
    "Decimal": r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$",
    "StockTicker": r"^[A-Z]{1,5}$",
}
VOCABULARIES = {
    "USState": ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC"],
    "USTerritory": ["PR", "VI", "GU", "AS", "MP"],
    "USMilitaryMail": ["AA", "AE", "AP"],
    "Boolean": ["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"],
    "Gender": ["male", "female", "m", "f", "nb", "non-binary", "nonbinary", "other", "unknown", "u"],
}
ORDERS = (
    ("low", "medium", "high"),
    ("small", "medium", "large"),
    ("first", "second", "third"),
    ("very low", "low", "medium", "high", "very high"),
    ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    ("mon", "tue", "wed", "thu", "fri", "sat", "sun"),
)
PRIORITY = ["CreditCard", "SSN", "Email", "IBAN", "SWIFT", "TaxID", "ISIN", "JSON", "URL", "IPAddress", "DateTime", "USZipCode", "PhoneNumber", "MACAddress", "USState", "USTerritory", "USMilitaryMail", "CountryCode", "FilePath", "Complex", "Geometry", "Currency", "Boolean", "Age", "Ordinal", "Count", "UUID", "CUID", "NanoID", "Passport", "LanguageCode", "Gender", "Integer", "Decimal", "Categorical", "StockTicker", "String"]
LABELS = {"SWIFT": "SWIFT/BIC", "TaxID": "Tax ID (EIN)", "IPAddress": "IP Address", "DateTime": "Date Time", "USZipCode": "US Zip Code", "PhoneNumber": "Phone Number", "MACAddress": "MAC Address", "USState": "US State", "USTerritory": "US Territory", "USMilitaryMail": "US Military Mail", "CountryCode": "Country Code", "FilePath": "File Path", "CreditCard": "Credit Card", "StockTicker": "Stock Ticker", "LanguageCode": "Language Code"}

COLUMNS_AT_ONCE = 25


def ends(pattern: str, end: str) -> str:
    """The pattern with ``end`` for every ``$`` that stands for the end."""
    out, escaped, bracket = "", False, False
    for ch in pattern:
        out += end if ch == "$" and not escaped and not bracket else ch
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == "[":
            bracket = True
        elif ch == "]":
            bracket = False
    return out


def java(pattern: str) -> str:
    """A pattern for Java: ``$`` matches at the very end only, and a dot matches line breaks too."""
    return "(?s)" + ends(pattern, r"\z")


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class LogicalType:
    """``value(column, type)`` gets the column as quoted SQL: True where the physical type decides, None where it
    never fits, else a test that every value must pass, as SQL (cheapest to build) or as a Column.
    ``whole(column, type)``: an aggregate that must hold as well."""

    name: str
    value: Callable[[str, T.DataType], str | Column | bool | None] = field(repr=False)
    whole: Callable[[Column, T.DataType], Column] | None = field(default=None, repr=False)

    @property
    def label(self) -> str:
        return LABELS.get(self.name, self.name)


def rule(name: str, pattern: str | None = None, values: list[str] | None = None, accepts: Callable[[T.DataType], bool] = is_string) -> LogicalType:
    """A type of texts that match a pattern, or are in a vocabulary whatever their case."""
    if (pattern is None) == (values is None):
        raise ValueError("give a pattern or values")

    def test(c: str, kind: T.DataType) -> str | None:
        if not accepts(kind):
            return None
        c = f"CAST({c} AS STRING)"
        return f"{c} RLIKE {text(java(pattern))}" if pattern else f"lower({c}) IN ({', '.join(text(v) for v in sorted({v.lower() for v in values}))})"

    return LogicalType(name, test)


def _native(name: str, native: Callable[[T.DataType], bool], texts: LogicalType, integers: str | None = None) -> LogicalType:
    def test(c: str, kind: T.DataType) -> str | bool | None:
        if native(kind):
            return True
        if is_integer(kind):
            return f"{c} {integers}" if integers else None
        return texts.value(c, kind)

    return LogicalType(name, test)


def _few(c: Column, kind: T.DataType) -> Column:
    n, total = F.count_distinct(c), F.count(F.lit(1))
    few = (n < 20) | (n / F.nullif(total, F.lit(0)) < 0.05)
    repeated = F.when(total < 50, n < total * 0.5).otherwise(n < total * 0.8)
    return (total > 0) & few & repeated


def ordered_groups() -> list[LogicalType]:
    """One rule for each vocabulary; the type named Ordinal stands for any of them."""
    return [rule("Ordinal", values=list(g)) for g in ORDERS]


def built_in() -> list[LogicalType]:
    """The 37 types in order of priority."""
    texts = {n: rule(n, p) for n, p in PATTERNS.items()} | {n: rule(n, values=v) for n, v in VOCABULARIES.items()}
    special = {
        "DateTime": _native("DateTime", lambda k: isinstance(k, INSTANTS), texts["DateTime"]),
        "Boolean": _native("Boolean", is_boolean, texts["Boolean"], "IN (0, 1)"),
        "Age": LogicalType("Age", lambda c, k: f"{c} BETWEEN 0 AND 120" if is_integer(k) else None, lambda c, k: F.coalesce(F.avg((c > 14).cast("double")), F.lit(0.0)) > 0.5),
        "Ordinal": LogicalType("Ordinal", lambda c, k: None),
        "Count": _native("Count", lambda k: False, texts["Count"], ">= 0"),
        "Integer": _native("Integer", is_integer, texts["Integer"]),
        "Decimal": _native("Decimal", lambda k: is_floating(k) or isinstance(k, T.DecimalType), texts["Decimal"]),
        "Categorical": LogicalType("Categorical", lambda c, k: True if is_string(k) or is_integer(k) else None, _few),
        "String": LogicalType("String", lambda c, k: True if is_string(k) else None),
    }
    return [special.get(n) or texts[n] for n in PRIORITY]


#: The types in use; insert into it to add one of your own.
types: list[LogicalType] = built_in()
_BUILT_IN = tuple(types)


def by_physical_type(kind: T.DataType) -> LogicalType:
    """What a column is called without looking at its values."""
    name = "String"
    if is_integer(kind):
        name = "Integer"
    elif is_floating(kind) or isinstance(kind, T.DecimalType):
        name = "Decimal"
    elif isinstance(kind, INSTANTS):
        name = "DateTime"
    elif is_boolean(kind):
        name = "Boolean"
    return next(t for t in types if t.name == name)


def expanded() -> list[LogicalType]:
    """The types in use, with a rule of its own for each ordered vocabulary."""
    return [own for t in types for own in (ordered_groups() if t.name == "Ordinal" else [t])]


def plan(df: DataFrame, columns: list[str], skip_categorical: bool = False) -> list[list[tuple[LogicalType, int | None, str | Column | None]]]:
    """For each column its possible types in order, with the bit of the value test and the test (None: no test)."""
    out = []
    for c in columns:
        kind, own, bit = df.schema[c].dataType, [], 0
        for t in expanded():
            test = None if skip_categorical and t.name == "Categorical" else t.value(quoted(c), kind)
            if test is None:
                continue
            own.append((t, None if test is True else bit, test if test is not True else None))
            bit += test is not True
        out.append(own)
    return out


def evidence(df: DataFrame, columns: list[str], plans: list) -> DataFrame:
    """One row. For each column: how many values, the tests that all of them pass as a bit mask, and its aggregates.

    A mask is one aggregate, however many rules there are; 60 tests fit one.
    """
    out = []
    for i, (c, own) in enumerate(zip(columns, plans, strict=True)):
        column = named(c)
        out.append(F.count(column).alias(f"n{i}"))
        tests = [(bit, test) for _, bit, test in own if bit is not None]
        for part in range(0, max(1, len(tests)), 60):
            own_tests = [(1 << (bit - part), test) for bit, test in tests[part : part + 60]]
            mask = F.expr(" | ".join(["0L", *(f"CASE WHEN {test} THEN {weight}L ELSE 0L END" for weight, test in own_tests if isinstance(test, str))]))
            for weight, test in own_tests:
                if not isinstance(test, str):
                    mask = mask.bitwiseOR(F.when(test, F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long")))
            out.append(F.bit_and(F.when(column.isNotNull(), mask)).alias(f"m{i}_{part // 60}"))
        out += [t.whole(column, df.schema[c].dataType).alias(f"w{i}_{j}") for j, (t, _, _) in enumerate(own) if t.whole]
    return df.agg(*out)


def verdicts(df: DataFrame, columns: list[str], skip_categorical: bool = False) -> DataFrame:
    """One row: for each column the label of its first matching type, or null."""
    plans, out = plan(df, columns, skip_categorical), []
    for i, own in enumerate(plans):
        whens = []
        for j, (t, bit, _) in enumerate(own):
            holds = [] if bit is None else [f"n{i} > 0", f"(m{i}_{bit // 60} & {1 << bit % 60}L) <> 0"]
            holds += [f"coalesce(w{i}_{j}, false)"] if t.whole else []
            whens.append(f"WHEN {' AND '.join(holds) or 'true'} THEN {text(t.name)}")
        out.append(F.expr(f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS STRING)").alias(f"c{i}"))
    return evidence(df, columns, plans).select(*out)


class Evidence:
    """What the values of one column leave of the built-in types: the same rules as ``plan``, for values in batches.

    A bounded head is judged here, as compiling dozens of patterns into one plan takes longer than
    matching them. Each distinct value is matched once for every type that is still possible.
    """

    def __init__(self, kind: T.DataType):
        self.kind, self.n, self.rows, self.above = kind, 0, 0, 0
        self.groups = [set(g) for g in ORDERS]
        if is_string(kind):
            self.tests = {n: re.compile(ends(p, r"\Z"), re.S | re.ASCII).search for n, p in PATTERNS.items()}
            self.tests |= {n: (lambda v, own=frozenset(x.lower() for x in vs): v.lower() in own) for n, vs in VOCABULARIES.items()}
        elif is_integer(kind):
            self.tests = {"Boolean": lambda v: v in (0, 1), "Age": lambda v: 0 <= v <= 120, "Count": lambda v: v >= 0}
        else:
            self.tests = {}
        self.seen: set[int] = set()

    def add(self, column: pa.ChunkedArray | pa.Array) -> None:
        self.rows += len(column)
        values = pc.value_counts(column.drop_null()).to_pylist()
        for own in values:
            v, count = own["values"], own["counts"]
            self.n += count
            if is_integer(self.kind):
                self.above += count * (v > 14)
            if (key := hash(v)) in self.seen:
                continue
            self.seen.add(key)
            for name in [n for n, test in self.tests.items() if not test(v)]:
                del self.tests[name]
            if is_string(self.kind):
                low = v.lower()
                self.groups = [g for g in self.groups if low in g]

    def verdict(self, skip_categorical: bool) -> str | None:
        k = self.kind
        native = {"DateTime": isinstance(k, INSTANTS), "Boolean": is_boolean(k), "Integer": is_integer(k), "Decimal": is_floating(k) or isinstance(k, T.DecimalType), "String": is_string(k)}
        few = len(self.seen) < 20 or (self.rows and len(self.seen) / self.rows < 0.05)
        repeated = len(self.seen) < self.rows * (0.5 if self.rows < 50 else 0.8)
        for name in PRIORITY:
            if native.get(name):
                return name
            if name == "Categorical":
                if (is_string(k) or is_integer(k)) and not skip_categorical and self.rows and few and repeated:
                    return name
            elif name == "Ordinal":
                if is_string(k) and self.n and self.groups:
                    return name
            elif name in self.tests and self.n and (name != "Age" or self.above > 0.5 * self.n):
                return name
        return None


def of_head(head: DataFrame, kinds: dict[str, T.DataType], skip_categorical: bool) -> list[str | None]:
    """The built-in type of each column, from all rows of a bounded table, in one task."""
    kinds_ = list(kinds.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Evidence(k) for k in kinds_]
        for b in batches:
            for i, own in enumerate(found):
                if own.tests or is_string(own.kind) or is_integer(own.kind):
                    own.add(b.column(i))
        yield pa.RecordBatch.from_arrays([pa.array([[e.verdict(skip_categorical) for e in found]], pa.list_(pa.string()))], ["names"])

    # Other types are decided by the schema alone; their values stay where they are.
    plain = head.select(*[named(c).cast("string" if is_string(k) else "long") if is_string(k) or is_integer(k) else F.lit(None).cast("long").alias(f"x{i}") for i, (c, k) in enumerate(kinds.items())])
    return plain.coalesce(1).mapInArrow(run, "names array<string>").first()[0]


def infer(df: DataFrame, columns: list[str] | None = None, sample: int | None = 10_000, minimal: bool = False, skip_categorical: bool = False) -> dict[str, LogicalType]:
    """The logical type of each column, from at most ``sample`` rows (None: all)."""
    columns = df.columns if columns is None else columns
    kinds = {c: df.schema[c].dataType for c in columns}
    found = {c: by_physical_type(kinds[c]) for c in columns}
    if minimal or not columns:
        return found
    head = df.select(*[named(c) for c in columns])
    names: list[str | None] = []
    if sample is not None:
        head = head.limit(sample)
        if tuple(types) == _BUILT_IN:
            try:
                names = of_head(head, kinds, skip_categorical)
            except Exception:  # the plan below may still judge some of the columns
                names = []
    if not names:
        head = head.cache() if sample is not None else head
        try:
            for a in range(0, len(columns), COLUMNS_AT_ONCE):
                own = columns[a : a + COLUMNS_AT_ONCE]
                try:
                    names += verdicts(head, own, skip_categorical).first()
                except Exception:  # a column that can't be checked keeps its physical type
                    names += [None] * len(own)
        finally:
            if sample is not None:
                head.unpersist()
    return found | {c: next(t for t in types if t.name == name) for c, name in zip(columns, names, strict=True) if name is not None}


def long_verdicts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, logical_type for a query, from all rows."""
    labels = F.create_map(*[x for t in types for x in (F.lit(t.name), F.lit(t.label))])
    row = verdicts(df, columns)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), labels[F.col(f"c{i}")].alias("logical_type")) for i, c in enumerate(columns)])).alias("r")).select("r.*")

"""Text catalogues by a scanf formatter, and two-column tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INT, _HEX, _OCTAL = r"[+-]?\d", r"[+-]?(?:0[xX])?[0-9a-fA-F]", r"[+-]?[0-7]"
_FLOAT = r"[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_SPEC = re.compile(r"%(?:%|(?P<skip>\*)?(?P<width>\d+)?(?P<size>hh|h|ll|l|j|z|t|L)?(?P<kind>[diouxXaAeEfFgGcsp]|\[\^?\]?[^\]]*\]))")
_BREAK = "\x01"


class FormatError(ValueError):
    """A formatter or an edge file that cannot be used."""


@dataclass(frozen=True)
class Field:
    """One conversion of a formatter: the pattern of its text, its type, and whether it is a column."""

    pattern: str
    type: str
    kept: bool


def parse_formatter(text: str) -> tuple[list[Field], list[str]]:
    """The conversions and the literal patterns before, between and behind them."""
    fields: list[Field] = []
    literals, held, at = [], "", 0
    while at < len(text):
        c = text[at]
        if c == "%":
            m = _SPEC.match(text, at)
            if not m or m["width"] and not int(m["width"]):
                raise FormatError(f"bad conversion at {text[at : at + 8]!r}")
            at = m.end()
            if m[0] == "%%":
                held += r"\s*%"
                continue
            literals.append(held)
            fields.append(_field(m))
            held = ""
        elif c.isspace():
            held += r"\s*"
            at += 1
        else:
            held += re.escape(c)
            at += 1
    if not any(f.kept for f in fields):
        raise FormatError("the formatter has no column")
    return fields, [*literals, held]


def _field(m: re.Match) -> Field:
    kind, width = m["kind"], m["width"]
    some = f"{{1,{width}}}" if width else "+"
    if kind == "c":
        pattern, of = f"(.{{{width or 1}}})", "string"
    elif kind[0] == "[":
        pattern, of = f"({kind.replace(chr(92), chr(92) * 2)}{some})", "string"
    elif kind == "s":
        pattern, of = rf"\s*(\S{some})", "string"
    elif kind in "diu":
        pattern, of = rf"\s*({_INT}{some})", "int" if m["size"] in (None, "h", "hh") and kind != "u" else "long"
    elif kind in "oxXp":
        pattern, of = rf"\s*({_OCTAL if kind == 'o' else _HEX}{some})", "octal" if kind == "o" else "hex"
    else:
        pattern, of = rf"\s*((?=\S{some})?{_FLOAT})" if width else rf"\s*({_FLOAT})", "float" if m["size"] is None else "double"
    return Field(pattern, of, not m["skip"])


def _value(text: Column, kind: str) -> Column:
    if kind in ("hex", "octal"):
        digits = F.regexp_replace(text, "^[+-]?(0[xX])?", "")
        return F.conv(digits, 16 if kind == "hex" else 8, 10).cast("bigint") * F.when(text.startswith("-"), -1).otherwise(1)
    if kind in ("float", "double"):
        word = F.lower(F.regexp_replace(text, "^[+]", ""))
        return F.when(word.rlike("^-?inf"), F.when(word.startswith("-"), float("-inf")).otherwise(float("inf"))).when(word.rlike("nan"), float("nan")).otherwise(F.when(word.rlike("inf|nan"), "0").otherwise(word).cast("double"))
    return text.cast({"int": "int", "long": "bigint", "string": "string"}[kind])


def _lines(spark: SparkSession, path: str, skip: int, comment: str) -> DataFrame:
    """The lines that hold data. The first `skip` lines of each file are dropped before comments and blanks are looked at.

    They lie in a file's first split. Its lines have consecutive numbers in their task, but the task may hold other
    files before it; where there are several files, one more pass finds the number of each one's first line.
    """
    lines = spark.read.text(path)
    if skip:
        several = len(lines.inputFiles()) > 1
        meta = F.col("_metadata")
        numbered = lines.select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("n"))
        if several:
            first = numbered.where("start = 0").groupBy("file").agg(F.min("n").alias("first"))
            numbered = numbered.join(first.withColumnRenamed("file", "f"), F.col("file") == F.col("f"), "left")
        else:
            numbered = numbered.withColumn("first", F.shiftleft(F.shiftright("n", 33), 33))
        lines = numbered.where((F.col("start") > 0) | (F.col("n") - F.col("first") >= skip)).select("value")
    lines = lines.select(F.regexp_replace("value", r"^\s+", "").alias("value")).where("value <> ''")
    return lines.where(~F.col("value").startswith(comment)) if comment else lines


def read_ascii(spark: SparkSession, path: str, formatter: str, *, skip: int = 0, comment: str = "", used: set[int] | None = None) -> DataFrame:
    """A text catalogue as columns c1, c2, ...; a line that does not fit the formatter fails the job.

    used: numbers of the columns wanted; what lies behind the last of them is not parsed. Suppressed conversions have
    no number. One pattern, with groups for the wanted columns only, is matched once a line.
    """
    fields, literals = parse_formatter(formatter)
    numbers = [n for n, f in enumerate(fields) if f.kept]
    if used:
        if max(used) > len(numbers):
            raise FormatError(f"column {max(used)} is not in the formatter")
        fields = fields[: numbers[max(used) - 1] + 1]
    pattern, groups, column = "^", [], 0
    for literal, f in zip(literals, fields):
        column += f.kept
        take = f.kept and (used is None or column in used)
        pattern += literal + (f.pattern if take else re.sub(r"(?<!\\)\((?!\?)", "(?:", f.pattern, count=1))
        if take:
            groups.append((column, f.type))
    lines = _lines(spark, path, skip, comment)
    joined = F.regexp_replace("value", pattern + ".*$", _BREAK.join(f"${n + 1}" for n in range(len(groups))))
    checked = F.when(F.col("value").rlike(pattern), F.split(joined, _BREAK)).otherwise(F.raise_error(F.concat(F.lit("line does not fit the formatter: "), "value")).cast("array<string>"))
    return lines.select(checked.alias("f")).select(*[_value(F.col("f")[n], kind).alias(f"c{c}") for n, (c, kind) in enumerate(groups)])


def read_table(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The first two numbers of each line; # starts a comment. For tables of the driver's size (knots, edges)."""
    out = []
    for row in _lines(spark, path, 0, "#").collect():
        parts = row["value"].split()
        try:
            out.append((float(parts[0]), float(parts[1])))
        except (ValueError, IndexError):
            raise FormatError(f"two numbers are expected: {row['value'][:80]!r}") from None
    if not out:
        raise FormatError(f"{path} has no rows")
    return out

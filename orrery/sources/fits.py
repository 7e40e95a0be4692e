"""Binary tables of FITS files, by numpy alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
# Fixed values of the public format: the letter of a column's form, its numpy kind and its Spark type.
FORMS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}

# Fixed values of the public format: the shifts by which signed integers (for bytes: unsigned ones) stand for the others.
SHIFTS = {"B": -128.0, "I": 32768.0, "J": 2147483648.0, "K": 9223372036854775808.0}


class FitsError(ValueError):
    """A file that is no FITS file, has no binary table, or has columns that are no plain cells."""


def _header(data: memoryview, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while True:
        block = bytes(data[at : at + BLOCK])
        if len(block) < BLOCK:
            raise FitsError("the header does not end")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:]
                cards[key] = value.split("'")[1].strip() if value.lstrip().startswith("'") else value.split("/")[0].strip()


class Column(NamedTuple):
    """A column of a table: where its cells lie in a row, and by how much stored numbers are scaled and shifted."""

    name: str
    letter: str
    offset: int
    width: int
    repeat: int
    scale: float
    zero: float

    @property
    def scaled(self) -> bool:
        return self.scale != 1 or self.zero != 0

    @property
    def kind(self) -> str:
        """The Spark type: scaled numbers are doubles, but integers shifted by half their range (or a byte's) stay integers."""
        plain = FORMS[self.letter][1]
        if self.scaled:
            shifted = {"B": "short", "I": "int", "J": "bigint", "K": "decimal(20,0)"}
            plain = shifted[self.letter] if self.scale == 1 and SHIFTS.get(self.letter) == self.zero else "double"
        return plain if self.letter == "A" or self.repeat == 1 else f"array<{plain}>"


def table_layout(data: memoryview) -> tuple[int, int, list[Column]]:
    """Of the first binary table: offset of its rows, their number, and its columns."""
    if bytes(data[:6]) != b"SIMPLE":
        raise FitsError("no FITS file")
    at = 0
    while at < len(data):
        cards, at = _header(data, at)
        sizes = [int(cards[f"NAXIS{n + 1}"]) for n in range(int(cards.get("NAXIS", "0")))]
        if cards.get("XTENSION") == "BINTABLE":
            columns, offset = [], 0
            for n in range(1, int(cards["TFIELDS"]) + 1):
                form = cards[f"TFORM{n}"]
                letter = form.lstrip("0123456789")[:1]
                repeat = int(form[: -len(form.lstrip("0123456789"))] or 1) if form[:1].isdigit() else 1
                if letter not in FORMS:
                    raise FitsError(f"column {n} has form {form}")
                width = repeat * (1 if letter == "A" else np.dtype(FORMS[letter][0]).itemsize)
                number = lambda key: float(cards[key].replace("D", "E"))  # noqa: E731, B023
                scale, zero = (number(f"{k}{n}") if f"{k}{n}" in cards else x for k, x in (("TSCAL", 1.0), ("TZERO", 0.0)))
                if letter in "LA" and (scale, zero) != (1, 0):
                    raise FitsError(f"column {n} has form {form} and a scale")
                columns.append(Column(cards.get(f"TTYPE{n}", f"COL{n}"), letter, offset, width, repeat, scale, zero))
                offset += width
            if offset != sizes[0]:
                raise FitsError("the columns do not fill a row")
            return at, sizes[1], columns
        size = abs(int(cards.get("BITPIX", "8"))) // 8 * int(np.prod(sizes)) if sizes else 0
        at += -(-size // BLOCK) * BLOCK
    raise FitsError("the file has no binary table")


def _column(raw: np.ndarray, c: Column) -> pa.Array:
    cell = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width])
    if c.letter == "A":
        return pa.array([bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in cell], pa.string())
    flat = cell.reshape(-1).view(FORMS[c.letter][0])
    if c.letter == "L":
        found = pa.array(flat == b"T", pa.bool_())
    elif not c.scaled:
        found = pa.array(flat.astype({"B": np.int16, "I": np.int16, "J": np.int32, "K": np.int64, "E": np.float32, "D": np.float64}[c.letter]))
    elif c.kind.removeprefix("array<").startswith("double"):
        found = pa.array(flat.astype(np.float64) * c.scale + c.zero)
    elif c.letter == "K":
        found = pa.array([int(x) + (1 << 63) for x in flat], pa.decimal128(20, 0))
    else:
        found = pa.array((flat.astype(np.int64) + int(c.zero)).astype({"B": np.int16, "I": np.int32, "J": np.int64}[c.letter]))
    if c.repeat == 1:
        return found
    return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * c.repeat, pa.int32()), found)


def read_fits(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = 65_536) -> DataFrame:
    """The first binary table of each file under path, or the named columns (names without regard to case).

    A file is read whole by one task (so up to 2 GB each); its rows leave in batches. All files need the first one's
    columns. Numbers are scaled and shifted as TSCAL and TZERO say; cells of several values become arrays. Integers that
    a shift makes unsigned stay integers, of the next wider type.
    """
    files = spark.read.format("binaryFile").load(path)
    # rows of a file can only be laid out once its header is known: the first file's, read by one small job
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                layout = table_layout(memoryview(data.as_buffer()).cast("B"))[2]
                yield pa.RecordBatch.from_arrays([pa.array([c.name for c in layout]), pa.array([c.kind for c in layout])], ["name", "kind"])

    found = files.select("content").limit(1).mapInArrow(names, "name string, kind string").collect()
    by_name = {r["name"].lower(): (r["name"], r["kind"]) for r in found}
    wanted = [c.lower() for c in columns] if columns else [r["name"].lower() for r in found]
    if missing := [c for c in wanted if c not in by_name]:
        raise FitsError(f"no column {', '.join(missing)}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                view = memoryview(data.as_buffer()).cast("B")
                at, n, layout = table_layout(view)
                places = {c.name.lower(): c for c in layout}
                if odd := [w for w in wanted if w not in places or places[w].kind != by_name[w][1]]:
                    raise FitsError(f"a file lacks column {odd[0]}, or has another type of it than the first")
                width = sum(c.width for c in layout)
                raw = np.frombuffer(view, np.uint8, n * width, at).reshape(n, width)
                for i in range(0, n, rows):
                    yield pa.RecordBatch.from_arrays([_column(raw[i : i + rows], places[w]) for w in wanted], [by_name[w][0] for w in wanted])

    return files.select("content").mapInArrow(read, ", ".join(f"`{by_name[w][0]}` {by_name[w][1]}" for w in wanted))

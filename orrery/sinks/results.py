"""Pair-count files (binary and text), correlation functions, multipoles and projections as text."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import __version__
from orrery.operators.bins import Binning
from orrery.operators.pairs import Box

# Fixed values of the file format: codes of the schemes, names of their columns in text files.
SCHEMES = {"iso": 0, "smu": 1, "spi": 2}
COLUMNS = {"iso": ("s_min", "s_max"), "smu": ("s_min", "s_max", "mu_min", "mu_max"), "spi": ("s_perp_min", "s_perp_max", "pi_min", "pi_max")}


class ResultError(ValueError):
    """A pair-count file that is broken or does not fit the bins asked for."""


@dataclass
class PairFile:
    """What a pair-count file holds; counts run over s first, then over the second kind of bins."""

    scheme: str
    s: np.ndarray
    second: int
    pi: np.ndarray | None
    box: np.ndarray | None
    weighted: bool
    mu_one: bool
    numbers: tuple[float, ...]
    norm: float
    ncnt: np.ndarray
    cnt: np.ndarray


def _ordered(df: DataFrame, *columns: str) -> list[tuple]:
    """A result's rows in the files' order; results have as many rows as bins."""
    return [tuple(r[c] for c in columns) for r in df.orderBy("j_idx", "s_idx").select(*columns).collect()]


def _header(form: int) -> str:
    major, minor, patch = (int(x) for x in __version__.split("."))
    return f"# Created by orrery v{__version__} ({major * 10000 + minor * 100 + patch}) ; format = {form}\n"


def write_pairs_binary(df: DataFrame, path: str, binning: Binning, box: Box | None, numbers: tuple[float, ...], weighted: bool) -> None:
    """A header line, then blocks of bytes between two copies of their length: settings, box, edges, numbers of
    points (or sums of weights), norm, normalised counts, counts."""
    rows = _ordered(df, "norm", "ncnt", "cnt")
    spec = [1, int(binning.mu_one), int(box is not None), len(numbers) - 1, int(weighted), SCHEMES[binning.scheme], len(binning.s)]
    if binning.scheme != "iso":
        spec.append(binning.second)
    blocks = [np.array(spec, "<i4").tobytes()]
    if box:
        blocks.append(np.array(box.sides, "<f8").tobytes())
    blocks.append(np.array(binning.s.edges, "<f8").tobytes())
    if binning.scheme == "spi":
        blocks.append(np.array(binning.pi.edges, "<f8").tobytes())
    blocks.append(np.array(numbers, "<f8" if weighted else "<u8").tobytes())
    blocks += [struct.pack("<d", rows[0][0]), np.array([r[1] for r in rows], "<f8").tobytes(), np.array([r[2] for r in rows], "<f8" if weighted else "<i8").tobytes()]
    with open(path, "wb") as f:
        f.write(_header(0).encode())
        for b in blocks:
            f.write(struct.pack("<Q", len(b)) + b + struct.pack("<Q", len(b)))


def read_pairs_binary(path: str) -> PairFile:
    with open(path, "rb") as f:
        head = f.readline().split()
        if head[:3] != [b"#", b"Created", b"by"] or head[-1] != b"0":
            raise ResultError(f"{path} is no binary pair-count file")

        def block(kind: str, n: int | None = None) -> np.ndarray:
            raw = f.read(8)
            size = struct.unpack("<Q", raw)[0] if len(raw) == 8 else -1
            data, again = f.read(max(size, 0)), f.read(8)
            if len(data) != size or again != raw or n is not None and size != n * np.dtype(kind).itemsize:
                raise ResultError(f"{path} has a block of the wrong length")
            return np.frombuffer(data, kind)

        spec = block("<i4")
        if len(spec) not in (7, 8):
            raise ResultError(f"{path} has {len(spec)} settings")
        real = "<f8" if spec[0] else "<f4"
        scheme = {v: k for k, v in SCHEMES.items()}.get(int(spec[5]))
        if scheme is None or (scheme != "iso") != (len(spec) == 8):
            raise ResultError(f"{path} has an unknown scheme")
        n, second, weighted = int(spec[6]), int(spec[7]) if scheme != "iso" else 1, bool(spec[4])
        box = block(real, 3) if spec[2] else None
        s = block(real, n + 1)
        pi = block(real, second + 1) if scheme == "spi" else None
        numbers = block("<f8" if weighted else "<u8", int(spec[3]) + 1)
        norm = block("<f8", 1)[0]
        ncnt, cnt = block("<f8", n * second), block("<f8" if weighted else "<i8", n * second)
    return PairFile(scheme, s, second, pi, box, weighted, bool(spec[1]), tuple(numbers.tolist()), float(norm), ncnt, cnt)


def pair_table(spark: SparkSession, path: str, binning: Binning, box: Box | None, tolerance: float = 1e-8) -> DataFrame:
    """The normalised counts of a binary or text pair-count file as an estimator wants them, if it has these very bins."""
    with open(path, "rb") as f:
        form = f.readline().split()[-1:]
    if form == [b"0"]:
        p = read_pairs_binary(path)
        edges = [(p.s, binning.s.edges)] + ([(p.pi, binning.pi.edges)] if binning.scheme == "spi" else [])
        if p.scheme != binning.scheme or p.second != binning.second or (p.box is not None) != (box is not None):
            raise ResultError(f"{path} has other kinds of bins")
        if any(len(a) != len(b) or not np.allclose(a, b, rtol=tolerance, atol=tolerance) for a, b in edges):
            raise ResultError(f"{path} has other bin edges")
        ncnt = p.ncnt.tolist()
    else:
        with open(path) as f:
            lines = f.read().splitlines()
        named = next((x for x in lines if x.startswith("# Columns:")), "")
        if tuple(named.split(":")[-1].split()[:-1]) != tuple(f"{c}({n + 1})" for n, c in enumerate(COLUMNS[binning.scheme])):
            raise ResultError(f"{path} has other kinds of bins")
        ncnt = [float(x.split()[-1]) for x in lines if x and not x.startswith("#")]
    if len(ncnt) != len(binning.s) * binning.second:
        raise ResultError(f"{path} has {len(ncnt)} bins")
    n = len(binning.s)
    counts = spark.createDataFrame([(i % n, i // n, v) for i, v in enumerate(ncnt)], "s_idx int, j_idx int, ncnt double")
    return binning.table(spark).join(counts, ["s_idx", "j_idx"])


def _number(x: float) -> str:
    return f"{x:.10g}"


def write_pairs_text(df: DataFrame, path: str, binning: Binning, numbers: tuple[float, ...], weighted: bool) -> None:
    edges = ("s_min", "s_max") if binning.scheme == "iso" else ("s_min", "s_max", "j_min", "j_max")
    rows = _ordered(df, *edges, "ncnt", "norm")
    what = "Weighted numbers" if weighted else "Numbers"
    head = [f"# {what} of tracers: {' '.join(_number(x) for x in numbers)}\n", f"# Normalization: {_number(rows[0][-1])}\n"]
    _write(path, [_header(1), *head], (*COLUMNS[binning.scheme], "npc"), [r[:-1] for r in rows])


def write_xi(df: DataFrame, path: str, binning: Binning) -> None:
    edges = ("s_cen", "s_min", "s_max") if binning.scheme == "iso" else ("s_min", "s_max", "j_min", "j_max")
    names = ("s_cen", "s_min", "s_max", "xi_iso") if binning.scheme == "iso" else (*COLUMNS[binning.scheme], "xi")
    _write(path, [_header(1)], names, _ordered(df, *edges, "xi"))


def write_multipoles(df: DataFrame, path: str) -> None:
    orders = sorted((c for c in df.columns if c.startswith("xi_")), key=lambda c: int(c[3:]))
    names = ("s_cen", "s_min", "s_max", *orders)
    _write(path, [_header(1)], names, _ordered(df.withColumn("j_idx", F.lit(0)), *names))


def write_projected(df: DataFrame, path: str) -> None:
    rows = _ordered(df.withColumn("j_idx", F.lit(0)), "s_cen", "s_min", "s_max", "wp")
    _write(path, [_header(1)], ("s_perp_cen", "s_perp_min", "s_perp_max", "wp"), rows)


def _write(path: str, head: list[str], names: tuple[str, ...], rows: list[tuple]) -> None:
    with open(path, "w") as f:
        f.writelines([*head, "# Columns: " + " ".join(f"{c}({n + 1})" for n, c in enumerate(names)) + "\n"])
        f.writelines(" ".join(map(_number, r)) + "\n" for r in rows)


def may_write(path: str, overwrite: int, pairs: bool, ask=input) -> bool:
    """Whether a result is to be computed and written: not where it exists and is to be used again.

    overwrite 0: an existing file is an error; 1: pair counts are used again, other results written anew; 2 and above:
    all are written anew; below 0: a question, put at most that many times.
    """
    if not os.path.exists(path):
        return True
    if overwrite == 0:
        raise FileExistsError(f"{path} exists")
    if overwrite > 0:
        return overwrite > 1 or not pairs
    for _ in range(-overwrite):
        answer = ask(f"{path} exists; overwrite it (y/n)? ").strip().lower()
        if answer in ("y", "n"):
            if answer == "n" and not pairs:
                raise FileExistsError(f"{path} exists")
            return answer == "y"
    raise FileExistsError(f"{path} exists")

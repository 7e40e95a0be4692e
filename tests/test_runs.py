import math
import struct

import numpy as np
import pytest

from orrery.operators import counts
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box
from orrery.plans import config
from orrery.plans.run import execute
from orrery.sinks import results
from orrery.sources import ascii, fits

BOX = Box.of(100.0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_ascii(spark, tmp_path):
    p = f"{tmp_path}/a.txt"
    with open(p, "w") as f:
        f.write("junk 1\n# junk 2\n# note\n\n  1.5 2 -3e1 YES 7\n+4 nan inf NO 8")
    got = rows(ascii.read_ascii(spark, p, "%lf %lf %lf %s %d", skip=2, comment="#"))
    assert got[0] == (1.5, 2.0, -30.0, "YES", 7)
    assert got[1][0] == 4 and math.isnan(got[1][1]) and got[1][2:] == (math.inf, "NO", 8)
    assert rows(ascii.read_ascii(spark, p, "%lf %*f %lf %s", skip=2, comment="#", used={1})) == [(1.5,), (4.0,)]
    with open(p, "w") as f:
        f.write("1,ab,0x1F,2.5\n2,cd,-1a,3\n")
    assert rows(ascii.read_ascii(spark, p, "%*d,%2s,%x,%lf")) == [("ab", 31, 2.5), ("cd", -26, 3.0)]
    with open(p, "w") as f:
        f.write("1 2\n3\n")
    with pytest.raises(Exception, match="does not fit"):
        ascii.read_ascii(spark, p, "%lf %lf").collect()
    for bad in ("%0d", "%[ab", "%", "%y", "%*d", "abc"):
        with pytest.raises(ascii.FormatError):
            ascii.parse_formatter(bad)
    with open(p, "w") as f:
        f.write("# z d\n 0.5 10 x\n0 0\n")
    assert ascii.read_table(spark, p) == [(0.5, 10.0), (0.0, 0.0)]


def test_skip_in_several_files(spark, tmp_path):
    for n in range(5):
        with open(f"{tmp_path}/{n}.txt", "w") as f:
            f.write(f"head\nhead two\n{n} 1\n{n} 2\n")
    assert sorted(rows(ascii.read_ascii(spark, str(tmp_path), "%d %d", skip=2))) == [(n, k) for n in range(5) for k in (1, 2)]


def write_fits(path, names, forms, columns, scales={}):  # noqa: B006
    def card(key, value):
        return f"{key:<8}= {value:>20}".ljust(80)

    def pad(b, fill):
        return b + fill * (-len(b) % 2880)

    head = card("SIMPLE", "T") + card("BITPIX", "8") + card("NAXIS", "0") + "END".ljust(80)
    kinds = {"D": ">f8", "J": ">i4", "I": ">i2", "B": "u1", "K": ">i8", "E": ">f4", "2J": (">i4", 2), "3A": "S3", "L": "S1"}
    data = np.zeros(len(columns[0]), np.dtype([(n, *(k if isinstance(k := kinds[f], tuple) else (k,))) for n, f in zip(names, forms)]))
    for n, c in zip(names, columns):
        data[n] = c
    table = card("XTENSION", "'BINTABLE'") + card("BITPIX", "8") + card("NAXIS", "2") + card("NAXIS1", data.itemsize) + card("NAXIS2", len(data)) + card("PCOUNT", "0") + card("GCOUNT", "1") + card("TFIELDS", len(names))
    for n, (name, form) in enumerate(zip(names, forms), 1):
        table += card(f"TTYPE{n}", f"'{name}'") + card(f"TFORM{n}", f"'{form}'")
        for key, value in zip(("TSCAL", "TZERO"), scales.get(name, ())):
            table += card(f"{key}{n}", value)
    with open(path, "wb") as f:
        f.write(pad(head.encode(), b" ") + pad((table + "END".ljust(80)).encode(), b" ") + pad(data.tobytes(), b"\0"))


def test_fits(spark, tmp_path):
    p = f"{tmp_path}/a.fits"
    write_fits(p, ["X", "N", "Name", "Ok"], ["D", "J", "3A", "L"], [[1.5, -2.0], [7, -8], [b"ab", b"xyz"], [b"T", b"F"]])
    assert rows(fits.read_fits(spark, p)) == [(1.5, 7, "ab", True), (-2.0, -8, "xyz", False)]
    assert rows(fits.read_fits(spark, p, ["name", "x"])) == [("ab", 1.5), ("xyz", -2.0)]
    with pytest.raises(fits.FitsError):
        fits.read_fits(spark, p, ["nope"])


def test_scaled_fits(spark, tmp_path):
    p = f"{tmp_path}/s.fits"
    half = {"U": ("1", "32768"), "V": ("1.0", "2147483648"), "S": ("1", "-128"), "Q": ("1", "9223372036854775808"), "F": ("0.5", "10"), "G": ("2D0", "0")}
    write_fits(p, ["U", "V", "S", "Q", "F", "G", "W"], ["I", "J", "B", "K", "I", "E", "2J"], [[-32768, 7], [0, -1], [0, 255], [0, 2**63 - 1], [4, -4], [1.5, 2.0], [[1, 2], [3, 4]]], half)
    got = fits.read_fits(spark, p)
    assert [k for _, k in got.dtypes] == ["int", "bigint", "smallint", "decimal(20,0)", "double", "double", "array<int>"]
    assert rows(got) == [(0, 2**31, -128, 2**63, 12.0, 3.0, [1, 2]), (32775, 2**31 - 1, 127, 2**64 - 1, 8.0, 4.0, [3, 4])]


def _catalog(spark, n=60, seed=4):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, p), float(1 + i % 3)) for i, p in enumerate(np.floor(r.uniform(0, 100, (n, 3))))], "id long, x double, y double, z double, w double")


@pytest.mark.parametrize("binning", [Binning("iso", Edges.linear(0, 30, 10)), Binning("smu", Edges.linear(0, 30, 10), n_mu=4), Binning("spi", Edges.linear(0, 30, 10), pi=Edges.linear(0, 20, 10))])
@pytest.mark.parametrize("weighted", [False, True])
def test_pair_files(spark, tmp_path, binning, weighted):
    df = counts.pair_counts(_catalog(spark), None, binning, BOX, weighted=weighted).persist()
    p, t = f"{tmp_path}/dd.bin", f"{tmp_path}/dd.txt"
    results.write_pairs_binary(df, p, binning, BOX, (60,), weighted)
    results.write_pairs_text(df, t, binning, (60,), weighted)
    held = results.read_pairs_binary(p)
    assert held.weighted == weighted and held.norm == df.first().norm and held.box.tolist() == [100.0] * 3
    want = {(r.s_idx, r.j_idx): r.ncnt for r in df.collect()}
    for path, close in ((p, 0), (t, 1e-9)):
        for r in results.pair_table(spark, path, binning, BOX).collect():
            assert r.ncnt == pytest.approx(want[r.s_idx, r.j_idx], rel=close or None)
    with pytest.raises(results.ResultError):
        results.pair_table(spark, p, Binning("iso", Edges.linear(0, 40, 10)), BOX)
    data = open(p, "rb").read()
    at = data.index(b"\n") + 1
    assert struct.unpack("<Q", data[at : at + 8])[0] == (28 if binning.scheme == "iso" else 32)
    open(p, "wb").write(data[:-3])
    with pytest.raises(results.ResultError):
        results.read_pairs_binary(p)


def test_config(tmp_path):
    held = config.parse_file("CATALOG = [a.txt, 'b#c.txt'] # two\nPOSITION = ['$1', $2, \\\n $3, $1, $2, $3]\nASCII_FORMATTER = ['%lf %lf %lf', \"%lf,%lf,%lf\"]\nBOX_SIZE = 100\nBOX_SIZE = 200\nPAIR_COUNT = [AA, AB]\nPAIR_COUNT_FILE = [x.aa, x.ab]\nSEP_BIN_MIN = 0\nSEP_BIN_MAX = 20\nSEP_BIN_SIZE = 5\nUNKNOWN = 3\n")
    assert held["CATALOG"] == ["a.txt", "b#c.txt"] and held["BOX_SIZE"] == [100.0] and held["POSITION"][2] == "$3"
    assert held["ASCII_FORMATTER"] == ["%lf %lf %lf", "%lf,%lf,%lf"]
    run = config.check(held, None)
    assert run.box == BOX and set(run.pairs) == {"AA", "AB"} and len(run.binning.s) == 4
    for change in ({"PAIR_COUNT": ["AA", "AA"]}, {"PAIR_COUNT": ["AC", "AB"]}, {"BINNING_SCHEME": 3}, {"MULTIPOLE": [0]}, {"CF_ESTIMATOR": ["AA/ZZ"]}, {"POSITION": ["$1"]}, {"CATALOG_LABEL": ["A", "A"]}, {"CATALOG_LABEL": ["a", "B"]}, {"PROJECTED_CF": True}, {"PAIR_COUNT_FILE": ["x"]}, {"SEP_BIN_SIZE": None}, {"BINNING_SCHEME": 1}, {"BINNING_SCHEME": 1, "MU_BIN_NUM": 1}):
        with pytest.raises(ValueError):
            config.check(held | change, None)
    assert config.check(held | {"PAIR_COUNT_FILE": ["a", "b", "c"]}, None).notes
    assert config.check(held | {"BINNING_SCHEME": 1, "MU_BIN_NUM": 4, "MU_ONE": True}, None).binning.mu_one and not run.binning.mu_one
    given, other = config.parse_command(["-b", "50", "--pair-count=[DD]", "-v", "-c", "f", "-h"])
    assert given == {"BOX_SIZE": [50.0], "PAIR_COUNT": ["DD"], "VERBOSE": True} and other == {"conf": "f", "help": ""}
    for bad in (["-q"], ["--nope=1"], ["-b"], ["-b", "x"]):
        with pytest.raises(config.ConfigError):
            config.parse_command(bad)
    assert set(config.KEYS) <= {x.split(" ")[0] for x in config.template().splitlines()}
    assert "--box-size" in config.usage()


def test_overwrite(tmp_path):
    p = f"{tmp_path}/x"
    assert results.may_write(p, 0, True)
    open(p, "w").close()
    with pytest.raises(FileExistsError):
        results.may_write(p, 0, True)
    assert not results.may_write(p, 1, True) and results.may_write(p, 1, False) and results.may_write(p, 2, True)
    said = iter(["?", "y"])
    assert results.may_write(p, -2, True, ask=lambda _: next(said))
    assert not results.may_write(p, -1, True, ask=lambda _: "n")
    with pytest.raises(FileExistsError):
        results.may_write(p, -1, True, ask=lambda _: "?")


def test_whole_run(spark, tmp_path):
    r = np.random.default_rng(1)
    for name in "dr":
        np.savetxt(f"{tmp_path}/{name}.txt", np.c_[r.uniform(0, 360, 150), r.uniform(-30, 30, 150), r.uniform(0.1, 0.12, 150), r.integers(1, 4, 150)], fmt="%.6f")
    base = {
        "CATALOG": [f"{tmp_path}/d.txt", f"{tmp_path}/r.txt"], "CATALOG_LABEL": ["D", "R"], "ASCII_FORMATTER": ["%lf %lf %lf %lf"] * 2, "POSITION": ["$1", "$2", "$3"] * 2, "WEIGHT": ["$4", "1"],
        "SELECTION": ["isfinite($1) && $4 < 4", ""], "COORD_CONVERT": [True], "OMEGA_M": 0.31, "BINNING_SCHEME": 1, "MU_BIN_NUM": 2, "SEP_BIN_MIN": 0.0, "SEP_BIN_MAX": 200.0, "SEP_BIN_SIZE": 100.0,
        "PAIR_COUNT": ["DD", "DR", "RR"], "PAIR_COUNT_FILE": [f"{tmp_path}/{p}" for p in ("dd", "dr", "rr")], "CF_ESTIMATOR": ["(DD - 2*DR + RR) / RR"], "CF_OUTPUT_FILE": [f"{tmp_path}/xi"],
        "MULTIPOLE": [2, 0], "MULTIPOLE_FILE": [f"{tmp_path}/mp"], "VERBOSE": False,
    }
    first = {tuple(x[:2]): x.xi for x in execute(spark, config.check(base, None))[f"{tmp_path}/xi"].collect()}
    assert len(first) == 4 and all(map(math.isfinite, first.values()))
    assert open(f"{tmp_path}/mp").read().splitlines()[1] == "# Columns: s_cen(1) s_min(2) s_max(3) xi_0(4) xi_2(5)"
    again = config.check(base | {"OVERWRITE": 1, "CATALOG": ["/nowhere", "/nowhere"]}, None)
    assert {tuple(x[:2]): x.xi for x in execute(spark, again)[f"{tmp_path}/xi"].collect()} == pytest.approx(first)
    with pytest.raises(FileExistsError):
        execute(spark, config.check(base, None))

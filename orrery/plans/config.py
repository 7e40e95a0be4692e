"""Configuration files and command lines of a run."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from orrery.functions.cosmology import Cosmology
from orrery.operators import estimators
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box

# Fixed values of the configuration language: key, flag, type, default, and whether it is a list.
#: s: string, i: integer, d: number, b: boolean, c: character.
KEYS: dict[str, tuple[str, str, Any, bool]] = {
    "CATALOG": ("i", "s", None, True),
    "CATALOG_LABEL": ("l", "c", None, True),
    "CATALOG_TYPE": ("T", "i", 0, True),
    "ASCII_SKIP": ("", "i", 0, True),
    "ASCII_COMMENT": ("", "c", "", True),
    "ASCII_FORMATTER": ("f", "s", None, True),
    "POSITION": ("x", "s", None, True),
    "WEIGHT": ("w", "s", "", True),
    "SELECTION": ("s", "s", "", True),
    "COORD_CONVERT": ("", "b", False, True),
    "OMEGA_M": ("d", "d", None, False),
    "OMEGA_LAMBDA": ("", "d", None, False),
    "DE_EOS_W": ("", "d", -1.0, False),
    "CMVDST_ERR": ("", "d", 1e-8, False),
    "Z_CMVDST_FILE": ("", "s", None, False),
    "BOX_SIZE": ("b", "d", None, True),
    "DATA_STRUCT": ("S", "i", 0, False),
    "BINNING_SCHEME": ("B", "i", 0, False),
    "PAIR_COUNT": ("p", "s", None, True),
    "PAIR_COUNT_FILE": ("P", "s", None, True),
    "CF_ESTIMATOR": ("e", "s", None, True),
    "CF_OUTPUT_FILE": ("E", "s", None, True),
    "MULTIPOLE": ("m", "i", None, True),
    "MULTIPOLE_FILE": ("M", "s", None, True),
    "PROJECTED_CF": ("u", "b", False, False),
    "PROJECTED_FILE": ("U", "s", None, True),
    "SEP_BIN_FILE": ("", "s", None, False),
    "SEP_BIN_MIN": ("", "d", None, False),
    "SEP_BIN_MAX": ("", "d", None, False),
    "SEP_BIN_SIZE": ("", "d", None, False),
    "MU_BIN_NUM": ("", "i", None, False),
    "MU_ONE": ("", "b", False, False),
    "PI_BIN_FILE": ("", "s", None, False),
    "PI_BIN_MIN": ("", "d", None, False),
    "PI_BIN_MAX": ("", "d", None, False),
    "PI_BIN_SIZE": ("", "d", None, False),
    "OUTPUT_FORMAT": ("F", "i", 0, False),
    "OVERWRITE": ("O", "i", 0, False),
    "VERBOSE": ("v", "b", True, False),
}
_TRUE, _FALSE = {"1", "T", "t", "true", "TRUE", "True"}, {"0", "F", "f", "false", "FALSE", "False"}


class ConfigError(ValueError):
    """A configuration that does not parse or does not make sense."""


def _items(text: str) -> list[str]:
    """The values of `a`, `'a b'` or `[a, b]`; quotes protect commas, brackets and #."""
    text = text.strip()
    if text.startswith("["):
        if not text.endswith("]"):
            raise ConfigError(f"an array is not closed: {text!r}")
        text = text[1:-1]
        found = re.findall(r"""((?:"[^"]*"|'[^']*'|[^,"'])+)""", text)
        return [_bare(f) for f in found]
    return [_bare(text)]


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" and text[0] not in text[1:-1] else text


def _cast(key: str, text: str) -> Any:
    kind = KEYS[key][1]
    try:
        if kind == "i":
            return int(text)
        if kind == "d":
            return float(text)
    except ValueError:
        raise ConfigError(f"{key} takes numbers, not {text!r}") from None
    if kind == "b":
        if text not in _TRUE | _FALSE:
            raise ConfigError(f"{key} takes T or F, not {text!r}")
        return text in _TRUE
    if kind == "c" and len(text) > 1:
        raise ConfigError(f"{key} takes single characters, not {text!r}")
    return text


def _assign(out: dict[str, Any], key: str, text: str) -> None:
    values = [_cast(key, t) for t in _items(text)]
    if not KEYS[key][3] and len(values) != 1:
        raise ConfigError(f"{key} takes one value")
    out[key] = values if KEYS[key][3] else values[0]


def parse_file(text: str) -> dict[str, Any]:
    """KEY = value lines; # starts a comment outside quotes; a backslash at the end goes on; the first of two values holds."""
    out: dict[str, Any] = {}
    lines = text.splitlines()
    n = 0
    while n < len(lines):
        line = re.sub(r"""^((?:"[^"]*"|'[^']*'|[^#"'])*)#.*$""", r"\1", lines[n]).strip()
        n += 1
        while line.endswith("\\") and n < len(lines):
            line = line[:-1].rstrip() + " " + re.sub(r"""^((?:"[^"]*"|'[^']*'|[^#"'])*)#.*$""", r"\1", lines[n]).strip()
            n += 1
        if not line:
            continue
        key, equals, value = line.partition("=")
        key = key.strip()
        if not equals:
            raise ConfigError(f"no value: {line!r}")
        if key in KEYS and key not in out and value.strip():
            _assign(out, key, value)
    return out


def parse_command(args: list[str]) -> tuple[dict[str, Any], dict[str, str]]:
    """(values by key, {"conf": file, "help"/"version"/"template": ""}) of a command line: -b 100, --box-size=100, -v."""
    flags = {f: k for k, (f, *_) in KEYS.items() if f}
    out: dict[str, Any] = {}
    other: dict[str, str] = {}
    n = 0
    while n < len(args):
        arg = args[n]
        n += 1
        name, equals, value = arg.partition("=")
        special = {"-h": "help", "--help": "help", "-V": "version", "--version": "version", "-t": "template", "--template": "template"}.get(name)
        if special:
            other[special] = ""
            continue
        if name in ("-c", "--conf"):
            key = "conf"
        elif name.startswith("--") and name[2:].upper().replace("-", "_") in KEYS:
            key = name[2:].upper().replace("-", "_")
        elif len(name) == 2 and name[0] == "-" and name[1] in flags:
            key = flags[name[1]]
        else:
            raise ConfigError(f"unknown option {arg!r}")
        if not equals:
            if n < len(args) and not re.match(r"-[A-Za-z-]", args[n]):
                value = args[n]
                n += 1
            elif key != "conf" and KEYS[key][1] == "b":
                value = "T"
            else:
                raise ConfigError(f"{arg} needs a value")
        if key == "conf":
            other["conf"] = value
        elif key not in out:
            _assign(out, key, value)
    return out, other


def template() -> str:
    """An empty configuration file."""
    lines = ["# Options of a run; lists are written [a, b]. Command lines take precedence."]
    for key, (flag, kind, default, many) in KEYS.items():
        said = {"s": "text", "i": "integer", "d": "number", "b": "T or F", "c": "character"}[kind]
        lines.append(f"{key} =  # {'list of ' * many}{said}{f', -{flag}' if flag else ''}{f', default {default}' if default not in (None, '') else ''}")
    return "\n".join(lines) + "\n"


def usage() -> str:
    lines = ["Usage: python -m orrery [-c FILE] [OPTION VALUE]...", "  -h help  -V version  -t template of a configuration file"]
    return "\n".join([*lines, *(f"  {f'-{f}, ' if f else '    '}--{k.lower().replace('_', '-')}" for k, (f, *_) in KEYS.items())]) + "\n"


@dataclass
class Catalog:
    label: str
    path: str
    kind: int
    position: list[str]
    weight: str | None
    selection: str | None
    convert: bool
    skip: int = 0
    comment: str = ""
    formatter: str | None = None


@dataclass
class Run:
    """A checked configuration."""

    catalogs: dict[str, Catalog]
    binning: Binning
    box: Box | None
    cosmology: Cosmology | None
    knots: str | None
    error: float
    pairs: dict[str, str]
    estimators: list[tuple[str, str]]
    multipoles: list[int]
    multipole_files: list[str]
    projected_files: list[str]
    text: bool
    overwrite: int
    verbose: bool
    notes: list[str] = field(default_factory=list)


def _spread(values: dict, key: str, n: int, notes: list[str], default: Any = None) -> list:
    """n values: the given ones, or the default n times; a single one is not repeated."""
    given = values.get(key)
    if given is None:
        return [default] * n
    if len(given) < n:
        raise ConfigError(f"{key} has {len(given)} values, {n} are needed")
    if len(given) > n:
        notes.append(f"{key}: values after the first {n} are not used")
    return given[:n]


def _edges(values: dict, kind: str, read) -> Edges:
    if values.get(f"{kind}_BIN_FILE"):
        return Edges.pairs(read(values[f"{kind}_BIN_FILE"]))
    low, high, step = (values.get(f"{kind}_BIN_{x}") for x in ("MIN", "MAX", "SIZE"))
    if low is None or high is None or step is None:
        raise ConfigError(f"{kind}_BIN_FILE or {kind}_BIN_MIN, _MAX and _SIZE are needed")
    return Edges.linear(low, high, step)


def check(values: dict[str, Any], read) -> Run:
    """A Run of values by key; read(path) gives the (low, high) rows of an edge file."""
    notes: list[str] = []
    paths = values.get("CATALOG") or []
    labels = values.get("CATALOG_LABEL") or [chr(65 + n) for n in range(len(paths))]
    if len(paths) > 26 or len(labels) < len(paths) or len(set(labels)) != len(labels) or any(not re.fullmatch("[A-Z]", x) for x in labels):
        raise ConfigError("catalogues need different labels, one of A to Z each")
    n = len(paths)
    kinds = _spread(values, "CATALOG_TYPE", n, notes, 0)
    if any(k not in (0, 1, 2, 3) for k in kinds):
        raise ConfigError("CATALOG_TYPE is 0 (text), 1 (FITS), 2 (HDF5) or 3 (Parquet)")
    formatter = _spread(values, "ASCII_FORMATTER", n, notes) if 0 in kinds else [None] * n
    if any(k == 0 and not f for k, f in zip(kinds, formatter)):
        raise ConfigError("ASCII_FORMATTER is needed for text catalogues")
    position = _spread(values, "POSITION", 3 * n, notes)
    if n and None in position:
        raise ConfigError("POSITION needs three expressions for each catalogue")
    weight, selection = _spread(values, "WEIGHT", n, notes, ""), _spread(values, "SELECTION", n, notes, "")
    flags = values.get("COORD_CONVERT") or [False]
    flags = flags * n if len(flags) == 1 else _spread(values, "COORD_CONVERT", n, notes)
    skip, comment = _spread(values, "ASCII_SKIP", n, notes, 0), _spread(values, "ASCII_COMMENT", n, notes, "")
    catalogs = {labels[i]: Catalog(labels[i], paths[i], kinds[i], position[3 * i : 3 * i + 3], None if weight[i] in ("", "1") else weight[i], selection[i] or None, flags[i], skip[i], comment[i], formatter[i]) for i in range(n)}
    scheme = {0: "iso", 1: "smu", 2: "spi"}.get(values.get("BINNING_SCHEME", 0))
    if scheme is None:
        raise ConfigError("BINNING_SCHEME is 0, 1 or 2")
    if values.get("DATA_STRUCT", 0) not in (0, 1):
        raise ConfigError("DATA_STRUCT is 0 or 1")
    binning = Binning(scheme, _edges(values, "SEP", read), values.get("MU_BIN_NUM") if scheme == "smu" else None, _edges(values, "PI", read) if scheme == "spi" else None, bool(values.get("MU_ONE", False)))
    box = Box.of(values["BOX_SIZE"]) if values.get("BOX_SIZE") else None
    cosmology = None
    if any(flags) and not box and not values.get("Z_CMVDST_FILE"):
        if values.get("OMEGA_M") is None:
            raise ConfigError("OMEGA_M or Z_CMVDST_FILE is needed to convert coordinates")
        cosmology = Cosmology(values["OMEGA_M"], values.get("OMEGA_LAMBDA"), values.get("DE_EOS_W", -1.0))
    pairs = values.get("PAIR_COUNT") or []
    if not pairs:
        raise ConfigError("PAIR_COUNT is needed")
    if len(set(pairs)) != len(pairs) or any(not re.fullmatch("[A-Z]{2}", p) for p in pairs):
        raise ConfigError("PAIR_COUNT takes different pairs of labels, such as DD")
    files = dict(zip(pairs, _spread(values, "PAIR_COUNT_FILE", len(pairs), notes), strict=True))
    if None in files.values():
        raise ConfigError("PAIR_COUNT_FILE is needed for each pair")
    for p, path in files.items():
        if any(c not in catalogs for c in p) and not os.path.exists(path):
            raise ConfigError(f"pair {p} has no catalogue and no file")
    wanted = values.get("CF_ESTIMATOR") or []
    for e in wanted:
        for u in estimators.labels(e):
            if u not in pairs and not (u == estimators.ANALYTIC and box):
                raise ConfigError(f"{u} in {e!r} is not counted")
        estimators.parse(e)
    outputs = _spread(values, "CF_OUTPUT_FILE", len(wanted), notes)
    if wanted and None in outputs:
        raise ConfigError("CF_OUTPUT_FILE is needed for each estimator")
    orders = sorted(set(values.get("MULTIPOLE") or []))
    projected = bool(values.get("PROJECTED_CF", False))
    estimators.check_products(binning, orders, projected)
    multipole_files = _spread(values, "MULTIPOLE_FILE", len(wanted) if orders else 0, notes)
    projected_files = _spread(values, "PROJECTED_FILE", len(wanted) if projected else 0, notes)
    if None in multipole_files or None in projected_files:
        raise ConfigError("MULTIPOLE_FILE or PROJECTED_FILE is needed for each estimator")
    return Run(catalogs, binning, box, cosmology, values.get("Z_CMVDST_FILE"), values.get("CMVDST_ERR", 1e-8), files, list(zip(wanted, outputs, strict=True)), orders, multipole_files, projected_files, values.get("OUTPUT_FORMAT", 0) == 1, values.get("OVERWRITE", 0), values.get("VERBOSE", True), notes)

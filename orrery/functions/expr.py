"""The expression language of catalogues and estimators, compiled to Spark columns.

Columns are $1 to $9, ${10} or ${name}; strings are quoted; the functions are abs, sqrt, ln, log (base 10) and
isfinite. Binary operators all group to the left, ** included, and bind, from the loosest: || && | ^ & (== !=)
(< <= > >=) (<< >>) (+ -) (* / %) ** and then the unary - ! ~.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import ieee

FUNCTIONS = ("abs", "sqrt", "ln", "log", "isfinite")
_LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("**",))
_POWER = {op: n for n, ops in enumerate(_LEVELS) for op in ops}
_TOKEN = re.compile(
    r"""\s*(?:
      (?P<number>0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<variable>\$(?:[1-9]|\{[^{}]+\}))
    | (?P<string>'[^']*'|"[^"]*")
    | (?P<function>[A-Za-z]\w*)\(
    | (?P<op>\*\*|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%<>&|^!~()])
    )""",
    re.VERBOSE,
)


class ExpressionError(ValueError):
    """An expression that does not parse, or does not fit the type asked for."""


@dataclass(frozen=True)
class Node:
    """op is a literal kind (long, double, string, variable), a function, an operator, or neg."""

    op: str
    value: object = None
    args: tuple[Node, ...] = ()


def parse(text: str) -> Node:
    tokens, at = [], 0
    stop = len(text.rstrip())
    while at < stop:
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at : at + 12].strip()!r} in {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def closed(node: Node) -> Node:
        if take() != ("op", ")"):
            raise ExpressionError(f"a parenthesis is not closed in {text!r}")
        return node

    def operand() -> Node:
        kind, value = take()
        if kind == "number":
            if re.fullmatch(r"\d+", value):
                return Node("long", int(value))
            return Node("double", float.fromhex(value) if value[:2].lower() == "0x" else float(value))
        if kind == "string":
            return Node("string", value[1:-1])
        if kind == "variable":
            return Node("variable", value[1:].strip("{}").strip())
        if kind == "function":
            if value not in FUNCTIONS:
                raise ExpressionError(f"unknown function {value} in {text!r}")
            return Node(value, args=(closed(binary(0)),))
        if (kind, value) == ("op", "("):
            return closed(binary(0))
        if kind == "op" and value in "-!~":
            return Node("neg" if value == "-" else value, args=(operand(),))
        raise ExpressionError(f"a value is missing in {text!r}")

    def binary(least: int) -> Node:
        left = operand()
        while (power := _POWER.get(tokens[place][1], -1) if tokens[place][0] == "op" else -1) >= least:
            op = take()[1]
            left = Node(op, args=(left, binary(power + 1)))
        return left

    tree = binary(0)
    if tokens[place][0] != "end":
        raise ExpressionError(f"unexpected {tokens[place][1]!r} in {text!r}")
    return tree


def variables(tree: Node) -> list[str]:
    """Names in order of first use."""
    found = [tree.value] if tree.op == "variable" else [v for a in tree.args for v in variables(a)]
    return list(dict.fromkeys(found))


Resolver = Callable[[str], Column]


def as_double(tree: Node, column: Resolver) -> Column:
    """The tree as a DOUBLE: arithmetic and abs, sqrt, ln, log only."""
    if tree.op in ("long", "double"):
        return F.lit(float(tree.value))
    if tree.op == "variable":
        return column(tree.value).cast("double")
    if tree.op not in ("abs", "sqrt", "ln", "log", "neg", "+", "-", "*", "/", "%", "**"):
        raise ExpressionError(f"{tree.op!r} has no place in a numeric expression")
    return _double(tree.op, [as_double(a, column) for a in tree.args])


def _double(op: str, x: list[Column]) -> Column:
    match op:
        case "abs":
            return F.abs(x[0])
        case "sqrt":
            return F.sqrt(x[0])
        case "ln":
            return ieee.ln(x[0])
        case "log":
            return ieee.log10(x[0])
        case "neg":
            return -x[0]
        case "+":
            return x[0] + x[1]
        case "-":
            return x[0] - x[1]
        case "*":
            return x[0] * x[1]
        case "/":
            return ieee.divide(*x)
        case "%":
            return ieee.remainder(*x)
        case _:
            return F.pow(*x)


def as_bool(tree: Node, column: Resolver, types: Callable[[str], str]) -> Column:
    """The tree as a BOOL. types gives a column's type: bool, long, double or string."""
    found, kind = _typed(tree, column, types)
    if kind != "bool":
        raise ExpressionError(f"a selection has to be a condition, not a {kind}")
    return found


def _typed(tree: Node, column: Resolver, types: Callable[[str], str]) -> tuple[Column, str]:
    op = tree.op
    if op in ("long", "double", "string"):
        return F.lit(tree.value).cast({"long": "bigint", "double": "double", "string": "string"}[op]), op
    if op == "variable":
        kind = types(tree.value)
        return column(tree.value).cast({"bool": "boolean", "long": "bigint", "double": "double", "string": "string"}[kind]), kind
    args = [_typed(a, column, types) for a in tree.args]
    x, kinds = [a[0] for a in args], [a[1] for a in args]

    def need(*allowed: str) -> None:
        if any(k not in allowed for k in kinds):
            raise ExpressionError(f"{op!r} does not take {', '.join(kinds)}")

    if op in ("&&", "||"):
        need("bool")
        return (x[0] & x[1] if op == "&&" else x[0] | x[1]), "bool"
    if op == "!":
        need("bool", "long", "double")
        return (~x[0] if kinds[0] == "bool" else x[0] == 0), "bool"
    if op == "isfinite":
        need("long", "double")
        return ieee.is_finite(x[0].cast("double")), "bool"
    if op in ("==", "!=") and set(kinds) <= {"string"} or op in ("==", "!=") and set(kinds) <= {"bool"}:
        return (x[0] == x[1] if op == "==" else x[0] != x[1]), "bool"
    if op in ("==", "!=", "<", "<=", ">", ">="):
        need("long", "double")
        if kinds == ["long", "long"]:
            return {"<": x[0] < x[1], "<=": x[0] <= x[1], ">": x[0] > x[1], ">=": x[0] >= x[1], "==": x[0] == x[1], "!=": x[0] != x[1]}[op], "bool"
        return ieee.compare(op, x[0].cast("double"), x[1].cast("double")), "bool"
    if op in ("&", "|", "^", "<<", ">>", "~"):
        need("long")
        if op == "~":
            return F.bitwise_not(x[0]), "long"
        shift = x[1].cast("int") if op in ("<<", ">>") else None
        made = {"&": x[0].bitwiseAND, "|": x[0].bitwiseOR, "^": x[0].bitwiseXOR}
        if op in made:
            return made[op](x[1]), "long"
        return F.call_function("shiftleft" if op == "<<" else "shiftright", x[0], shift), "long"
    need("long", "double")
    if op in ("sqrt", "ln", "log") or "double" in kinds:
        return _double(op, [c.cast("double") for c in x]), "double"
    a, b = x[0], x[-1]
    safe = F.when(b == 0, F.lit(None).cast("bigint")).otherwise(b)
    match op:
        case "abs":
            return F.abs(a), "long"
        case "neg":
            return -a, "long"
        case "+":
            return a + b, "long"
        case "-":
            return a - b, "long"
        case "*":
            return a * b, "long"
        case "/":
            return F.call_function("div", a, safe), "long"
        case "%":
            return a % safe, "long"
        case _:
            return F.pow(a.cast("double"), b.cast("double")).cast("bigint"), "long"


def evaluate(tree: Node, values: dict[str, object]) -> object:
    """The tree's value in Python, for small tables and for tests."""
    import math

    if tree.op in ("long", "double", "string"):
        return tree.value
    if tree.op == "variable":
        return values[tree.value]
    x = [evaluate(a, values) for a in tree.args]
    a, b = x[0], x[-1]
    whole = isinstance(a, int) and isinstance(b, int)

    def quotient() -> float | int:
        if whole:
            return int(math.copysign(abs(a) // abs(b), a * b)) if a else 0
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
        return a / b

    table: dict[str, Callable[[], object]] = {
        "abs": lambda: abs(a), "neg": lambda: -a, "!": lambda: not a, "~": lambda: ~a,
        "sqrt": lambda: math.sqrt(a) if a >= 0 else math.nan,
        "ln": lambda: math.log(a) if a > 0 else -math.inf if a == 0 else math.nan,
        "log": lambda: math.log10(a) if a > 0 else -math.inf if a == 0 else math.nan,
        "isfinite": lambda: math.isfinite(a),
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": quotient, "**": lambda: a**b,
        "%": lambda: int(math.fmod(a, b)) if whole else math.fmod(a, b) if b else math.nan,
        "<<": lambda: a << b, ">>": lambda: a >> b, "&": lambda: a & b, "^": lambda: a ^ b, "|": lambda: a | b,
        "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b,
        "&&": lambda: bool(a) and bool(b), "||": lambda: bool(a) or bool(b),
    }
    return table[tree.op]()

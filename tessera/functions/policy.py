"""A typed decision-table language, compiled to columns.

A policy text has a header `policy Name`, sections `inputs:`, `constants:`, `requires:`, `output:`,
`rules:`, `invariants:`, `examples:` and blocks `derive name: type`, in any order. A rule is `rule
Name:` with `when <condition>` or `otherwise`, `then <target> = <expression>` lines and `because
"..."`. Types are money, percent, number, integer and boolean; amounts are decimal(18,8) columns, so
that a product is exact before it is cast back. The first rule whose condition holds fires.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(18,8)"
TYPES = ("money", "percent", "number", "integer", "boolean")
_TOKEN = re.compile(r"\s*(?:(\$[\d,]*\d(?:\.\d+)?|\d+(?:\.\d+)?%|\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(!=|<=|>=|[=<>+\-*/(),]))")


class PolicyError(ValueError):
    """A text that is no policy: `code` names the kind of fault."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Node:
    """Part of an expression: kind is number, name, unary, binary or call."""

    kind: str
    value: object
    parts: tuple[Node, ...] = ()
    unit: str = ""


@dataclass
class Rule:
    name: str
    when: Node | None = None
    then: dict[str, Node] = field(default_factory=dict)


@dataclass
class Policy:
    name: str = ""
    inputs: dict[str, str] = field(default_factory=dict)
    constants: dict[str, tuple[str, Node]] = field(default_factory=dict)
    requires: list[Node] = field(default_factory=list)
    derives: list[tuple[str, str, list[Rule]]] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    outputs: dict[str, str] = field(default_factory=dict)
    invariants: list[Node] = field(default_factory=list)
    examples: list[tuple[str, dict[str, Node], dict[str, Node]]] = field(default_factory=list)


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PolicyError("P001", f"unexpected character at {at} in {text!r}")
        kind = "number" if m[1] else "name" if m[2] else "sign"
        out.append((kind, m[1] or m[2] or m[3]))
        at = m.end()
    return out


#: Binding powers; `not` binds as tightly as a minus sign.
_POWERS = {"or": 1, "and": 2, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5}


def parse(text: str) -> Node:
    """An expression by precedence climbing."""
    tokens, at = [*lex(text), ("end", "")], 0

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal at
        token = tokens[at]
        if expected and token[1] != expected:
            raise PolicyError("P002", f"expected {expected!r} in {text!r}")
        at += 1
        return token

    def primary() -> Node:
        kind, word = take()
        if kind == "number":
            if word[0] == "$":
                return Node("number", Decimal(word[1:].replace(",", "")), unit="money")
            if word[-1] == "%":
                return Node("number", Decimal(word[:-1]) / 100, unit="percent")
            return Node("number", Decimal(word), unit="number" if "." in word else "integer")
        if word in ("not", "-"):
            return Node("unary", word, (primary(),))
        if word == "(":
            inner = climb(0)
            take(")")
            return inner
        if word in ("true", "false"):
            return Node("number", word == "true", unit="boolean")
        if kind != "name":
            raise PolicyError("P002", f"unexpected {word!r} in {text!r}")
        if tokens[at][1] != "(":
            return Node("name", word)
        take("(")
        args = [climb(0)]
        while tokens[at][1] == ",":
            take(",")
            args.append(Node("name", take()[1]) if tokens[at][1] in ("half_up", "half_even") else climb(0))
        take(")")
        return Node("call", word, tuple(args))

    def climb(least: int) -> Node:
        left = primary()
        while (power := _POWERS.get(tokens[at][1], 0)) > least:
            sign = take()[1]
            left = Node("binary", sign, (left, climb(power)))
        return left

    out = climb(0)
    if tokens[at][0] != "end":
        raise PolicyError("P002", f"left over: {tokens[at][1]!r} in {text!r}")
    return out


def _declared(line: str) -> tuple[str, str, str]:
    m = re.match(r'(\w+)\s*:\s*(\w+)\s*(?:=\s*(.*?))?\s*("(?:[^"]*)")?$', line)
    if not m or m[2] not in TYPES:
        raise PolicyError("P003", f"not a declaration: {line!r}")
    return m[1], m[2], m[3] or ""


def read(text: str) -> Policy:
    """The structure of a policy text."""
    p, section, rules, example = Policy(), "", None, None
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = re.sub(r'(?:#|//)(?=(?:[^"]*"[^"]*")*[^"]*$).*', "", raw).strip()
        if not line:
            continue
        bare = re.sub(r'\s*"[^"]*"$', "", line)
        if m := re.match(r"policy (\w+)$", line):
            if p.name:
                raise PolicyError("P004", "two policies in a text")
            p.name = m[1]
        elif m := re.match(r"(inputs|constants|requires|rules|outputs?|invariants|examples):$", line):
            section, rules = m[1].rstrip("s") if m[1].startswith("output") else m[1], p.rules
        elif m := re.match(r"derive (.*)$", line):
            name, kind, _ = _declared(m[1])
            rules, section = [], "rules"
            p.derives.append((name, kind, rules))
        elif section == "rules" and (m := re.match(r"rule (\w+):$", line)):
            rules.append(Rule(m[1]))
        elif section == "rules" and rules and line.startswith("when "):
            rules[-1].when = parse(line[5:])
        elif section == "rules" and line in ("otherwise",) or line.startswith("because "):
            continue
        elif section == "rules" and rules and (m := re.match(r"then (\w+)\s*=\s*(.*)$", line)):
            rules[-1].then[m[1]] = parse(m[2])
        elif section == "examples" and (m := re.match(r'example "(.*)":$', line)):
            example = (m[1], {}, {})
            p.examples.append(example)
        elif section == "examples" and (m := re.match(r"(expect )?(\w+)\s*=\s*(.*)$", line)):
            example[2 if m[1] else 1][m[2]] = parse(m[3])
        elif section == "inputs":
            name, kind, _ = _declared(line)
            p.inputs[name] = kind
        elif section == "output":
            name, kind, _ = _declared(line)
            p.outputs[name] = kind
        elif section == "constants":
            name, kind, value = _declared(line)
            p.constants[name] = (kind, parse(value))
        elif section in ("requires", "invariants"):
            getattr(p, section).append(parse(bare))
        elif not (section == "" and line[0] == '"'):
            raise PolicyError("P005", f"unexpected line {line!r}")
    if not p.name or not p.outputs:
        raise PolicyError("P004", "a policy needs a name and an output")
    return p


def _family(kind: str) -> str:
    return "numeric" if kind in ("number", "integer") else kind


def kind_of(node: Node, names: dict[str, str]) -> str:
    """The type of an expression, or an error where units do not go together."""
    if node.kind == "number":
        return node.unit
    if node.kind == "name":
        if node.value not in names:
            raise PolicyError("P006", f"unknown name {node.value!r}")
        return names[node.value]
    if node.kind == "call":
        args = [kind_of(a, names) for a in node.parts if a.value not in ("half_up", "half_even")]
        if node.value in ("min", "max"):
            if len(args) < 2 or len({_family(a) for a in args}) > 1 or "boolean" in args:
                raise PolicyError("P008", f"{node.value} takes two or more amounts of one unit")
            return args[0] if len(set(args)) == 1 else "number"
        if node.value == "round":
            if not 2 <= len(node.parts) <= 3 or node.parts[1].kind != "number" or not 0 <= node.parts[1].value <= 8:
                raise PolicyError("P008", "round takes an amount and a constant of 0 to 8 places")
            return args[0]
        if node.value in ("abs", "floor", "ceil") and len(args) == 1 and args[0] != "boolean":
            return "integer" if node.value != "abs" and _family(args[0]) == "numeric" else args[0]
        raise PolicyError("P008", f"no function {node.value!r} of {len(args)} arguments")
    kinds = [kind_of(a, names) for a in node.parts]
    if node.kind == "unary":
        if (node.value == "not") != (kinds[0] == "boolean"):
            raise PolicyError("P007", f"{node.value!r} does not apply to {kinds[0]}")
        return kinds[0]
    sign, (a, b) = node.value, kinds
    if sign in ("and", "or"):
        if a != "boolean" or b != "boolean":
            raise PolicyError("P007", f"{sign!r} joins booleans")
        return "boolean"
    if _POWERS[sign] == 3:
        if _family(a) != _family(b) or a == "boolean" and sign not in ("=", "!="):
            raise PolicyError("P007", f"cannot compare {a} and {b}")
        return "boolean"
    if "boolean" in (a, b):
        raise PolicyError("P007", f"{sign!r} does not apply to booleans")
    whole = "integer" if a == b == "integer" else "number"
    fa, fb = _family(a), _family(b)
    if sign in "+-" and fa == fb:
        return a if fa != "numeric" else whole
    if sign == "*" and not (fa == fb != "numeric"):
        return "money" if "money" in (a, b) else "percent" if "percent" in (a, b) else whole
    if sign == "/" and fa == fb:
        return "number"
    if sign == "/" and fb == "numeric":
        return a
    raise PolicyError("P007", f"cannot apply {sign!r} to {a} and {b}")


def column(node: Node, names: dict[str, Column]) -> Column:
    """The expression as a column; every amount is cast back to decimal(18,8)."""
    if node.kind == "number":
        return F.lit(node.value) if node.unit == "boolean" else F.lit(str(node.value)).cast(AMOUNT)
    if node.kind == "name":
        return names[node.value]
    if node.kind == "call":
        a = [column(p, names) for p in node.parts if p.value not in ("half_up", "half_even")]
        if node.value == "round":
            places = int(node.parts[1].value)
            half = F.bround if len(node.parts) == 3 and node.parts[2].value == "half_even" else F.round
            return half(a[0], places).cast(AMOUNT)
        return {"min": lambda: F.least(*a), "max": lambda: F.greatest(*a), "abs": lambda: F.abs(a[0]), "floor": lambda: F.floor(a[0]), "ceil": lambda: F.ceil(a[0])}[node.value]().cast(AMOUNT)
    a = [column(p, names) for p in node.parts]
    if node.kind == "unary":
        return ~a[0] if node.value == "not" else -a[0]
    x, y = a
    plain = {"or": lambda: x | y, "and": lambda: x & y, "=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}
    if node.value in plain:
        return plain[node.value]()
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[node.value]().cast(AMOUNT)


class Compiled:
    """A checked policy that applies to DataFrames as nested CASE expressions."""

    def __init__(self, text_or_policy: str | Policy):
        self.policy = p = read(text_or_policy) if isinstance(text_or_policy, str) else text_or_policy
        names = dict(p.inputs)
        for name, (kind, value) in p.constants.items():
            self._fits(kind, kind_of(value, names), name)
            names[name] = kind
        for node in p.requires:
            self._boolean(node, names)
        for name, kind, rules in p.derives:
            self._rules(rules, {name: kind}, names)
            names[name] = kind
        self._rules(p.rules, p.outputs, names)
        for node in p.invariants:
            self._boolean(node, {**names, **p.outputs})

    @staticmethod
    def _fits(target: str, kind: str, name: str) -> None:
        if target != kind and (target, kind) != ("number", "integer"):
            raise PolicyError("P009", f"{name} is {target}, not {kind}")

    @staticmethod
    def _boolean(node: Node, names: dict[str, str]) -> None:
        if kind_of(node, names) != "boolean":
            raise PolicyError("P007", "a condition must be boolean")

    def _rules(self, rules: list[Rule], targets: dict[str, str], names: dict[str, str]) -> None:
        if not rules or rules[-1].when is not None:
            raise PolicyError("P010", f"rules for {', '.join(targets)} leave cases open")
        if any(r.when is None for r in rules[:-1]):
            raise PolicyError("P011", "rules after `otherwise` are never reached")
        for r in rules:
            if r.when is not None:
                self._boolean(r.when, names)
            if set(r.then) != set(targets):
                raise PolicyError("P012", f"rule {r.name} must assign {', '.join(targets)}")
            for name, node in r.then.items():
                self._fits(targets[name], kind_of(node, names), name)

    @staticmethod
    def _first(rules: list[Rule], value, names: dict[str, Column]) -> Column:
        out = None
        for i, r in enumerate(rules):
            if r.when is not None:
                c = column(r.when, names)
                out = F.when(c, value(i, r)) if out is None else out.when(c, value(i, r))
            else:
                return value(i, r) if out is None else out.otherwise(value(i, r))
        return out

    def apply(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """`df` (with the inputs as columns) with the outputs, fired_rule, failed_requirement and failed_invariant (index or -1)."""
        p, keep = self.policy, df.columns
        names = {n: F.col(n) if k == "boolean" else F.col(n).cast(AMOUNT) for n, k in p.inputs.items()}
        names |= {n: column(v, names) for n, (_, v) in p.constants.items()}
        for name, _, rules in p.derives:
            df = df.withColumn(f"{prefix}{name}", self._first(rules, lambda i, r, n=name: column(r.then[n], names), names))
            names[name] = F.col(f"{prefix}{name}")
        fired = self._first(p.rules, lambda i, r: F.lit(i), names)
        df = df.withColumns({f"{prefix}{o}": self._first(p.rules, lambda i, r, o=o: column(r.then[o], names), names) for o in p.outputs} | {f"{prefix}fired_rule": fired})
        after = names | {o: F.col(f"{prefix}{o}") for o in p.outputs}

        def failing(nodes: list[Node], env: dict[str, Column]) -> Column:
            out = F.lit(-1)
            for i, node in reversed(list(enumerate(nodes))):
                out = F.when(~column(node, env), F.lit(i)).otherwise(out)
            return out

        df = df.withColumns({f"{prefix}failed_requirement": failing(p.requires, names), f"{prefix}failed_invariant": failing(p.invariants, after)})
        return df.select(*keep, *(f"{prefix}{o}" for o in p.outputs), f"{prefix}fired_rule", f"{prefix}failed_requirement", f"{prefix}failed_invariant")

    def conditions(self) -> list[tuple[str, Node]]:
        """Every rule's condition with its name."""
        every = [r for _, _, rules in self.policy.derives for r in rules] + self.policy.rules
        return [(r.name, r.when) for r in every if r.when is not None]

    def condition_columns(self, df: DataFrame) -> DataFrame:
        """`df` with a boolean column for each condition."""
        p = self.policy
        names = {n: F.col(n) if k == "boolean" else F.col(n).cast(AMOUNT) for n, k in p.inputs.items()}
        names |= {n: column(v, names) for n, (_, v) in p.constants.items()}
        for name, _, rules in p.derives:
            df = df.withColumn(f"_{name}", self._first(rules, lambda i, r, n=name: column(r.then[n], names), names))
            names[name] = F.col(f"_{name}")
        return df.select(*(column(c, names).alias(n) for n, c in self.conditions()))

    def check_examples(self, examples: DataFrame, expected: dict[str, str]) -> DataFrame:
        """Examples in a table (the inputs as columns, and a column of what is expected of each output of `expected`) with whether all come out: `passed`."""
        hold = [F.col(o).eqNullSafe(F.col(c).cast(AMOUNT)) if self.policy.outputs[o] != "boolean" else F.col(o).eqNullSafe(F.col(c)) for o, c in expected.items()]
        return self.apply(examples).withColumn("passed", reduce(Column.__and__, hold)).select(*examples.columns, "passed")

    def run_examples(self, spark) -> list[tuple[str, bool]]:
        """Each example's description and whether its expected outputs come out."""
        out = []
        for title, given, expected in self.policy.examples:
            row = spark.range(1).select(*(column(given[n], {}).alias(n) for n in self.policy.inputs))
            got = self.apply(row).first()
            out.append((title, all(spark.range(1).select(column(v, {})).first()[0] == got[o] for o, v in expected.items())))
        return out


_BOUNDARY = {"<": "<=", "<=": "<", ">": ">=", ">=": ">", "=": "!=", "!=": "="}
_ARITHMETIC = {"+": "-", "-": "+"}


def mutants(node: Node) -> list[Node]:
    """All expressions that differ in one defect: a comparison's boundary, plus for minus, a literal one more."""
    out = []
    if node.kind == "binary" and node.value in _BOUNDARY | _ARITHMETIC:
        out.append(replace(node, value=(_BOUNDARY | _ARITHMETIC)[node.value]))
    if node.kind == "number" and node.unit != "boolean":
        out.append(replace(node, value=node.value + (1 if node.unit != "percent" else Decimal("0.01"))))
    for i, part in enumerate(node.parts):
        if node.kind == "call" and node.value == "round" and i:
            continue
        out += [replace(node, parts=node.parts[:i] + (m,) + node.parts[i + 1 :]) for m in mutants(part)]
    return out


def policy_mutants(policy: Policy) -> list[tuple[str, Policy]]:
    """Policies that differ from this one by one defect in a rule, with the rule's name."""
    out = []

    def swapped(rules: list[Rule]) -> list[tuple[str, list[Rule]]]:
        found = []
        for i, r in enumerate(rules):
            changed = [replace(r, when=m) for m in (mutants(r.when) if r.when else [])]
            changed += [replace(r, then={**r.then, t: m}) for t, n in r.then.items() for m in mutants(n)]
            found += [(r.name, rules[:i] + [c] + rules[i + 1 :]) for c in changed]
        return found

    for d, (name, kind, rules) in enumerate(policy.derives):
        out += [(n, replace(policy, derives=policy.derives[:d] + [(name, kind, new)] + policy.derives[d + 1 :])) for n, new in swapped(rules)]
    return out + [(n, replace(policy, rules=new)) for n, new in swapped(policy.rules)]

"""Metrics of source code in a language of braces, by tokens: types, methods, branches, nesting, magic numbers, open ends, dependencies.

A source is one row and is read by itself. Types and methods are found by their headers and matching braces, after
strings and comments are set aside; this reads what is laid out as usual, not the whole grammar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPE = re.compile(r"\b(class|struct|interface|record)\s+([A-Za-z_]\w*)")
METHOD = re.compile(r"([A-Za-z_]\w*)\s*(?:<[^<>{}()]*>)?\s*\(([^(){};]*(?:\([^()]*\)[^(){};]*)*)\)\s*(?:where[^{;]*|:\s*(?:base|this)\s*\([^)]*\)\s*)?(\{|=>)")
NOT_METHODS = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new", "when", "fixed", "do", "else", "nameof", "typeof", "sizeof", "default", "checked", "await", "throw"}
DECISIONS = re.compile(r"\b(?:if|for|foreach|while|do|case|catch)\b|&&|\|\||\?\?|\?(?=[^?:.\[]*:)|=>(?=[^{};]*,\s*(?:\n|\}))")
SCOPES = re.compile(r"\b(?:if|for|foreach|while|do|switch|try)\b|[{}]")
LITERAL = re.compile(r"(?<![\w.])\d[\d_]*(?:\.\d+)?[mMdDfFuUlL]*(?![\w.])")
SCHEMA = "name string, types int, methods int, complexity int, nesting int, lines int, parameters int, magic_numbers int, todos int, dependencies array<string>"


def blank(source: str) -> tuple[str, list[str]]:
    """The source with strings and comments blanked, line feeds kept, and its comments."""
    comments: list[str] = []

    def gone(m: re.Match) -> str:
        if m[0].startswith("/"):
            comments.append(m[0])
        return re.sub(r"[^\n]", " ", m[0])

    return re.sub(r"//[^\n]*|/\*.*?\*/|@\"(?:[^\"]|\"\")*\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", gone, source, flags=re.S), comments


def closing(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def nesting(body: str) -> int:
    """The deepest run of scopes: a braced branch or loop counts with its braces."""
    depth = most = 0
    held: list[int] = []
    owed = 0
    for m in SCOPES.finditer(body):
        if m[0] == "{":
            held.append(1 + owed)
            depth += 1 + owed
            owed = 0
        elif m[0] == "}":
            depth -= held.pop() if held else 0
        else:
            owed = 1
        most = max(most, depth + owed)
        if m[0] not in "{}" and re.match(r"[^;{}]*;", body[m.end() : m.end() + 400]):
            owed = 0
    return most


def measure(name: str, source: str | None) -> tuple:
    code, comments = blank(source or "")
    names = [m[2] for m in TYPE.finditer(code)]
    methods = []
    for m in METHOD.finditer(code):
        if m[1] in NOT_METHODS or re.search(r"(?:\bnew|[.=(,&|!?+*/-]|\breturn)\s*$", code[: m.start()][-12:]):
            continue
        end = closing(code, m.end() - 1) if m[3] == "{" else code.find(";", m.end()) + 1 or len(code)
        begin = code.rfind("\n", 0, m.start()) + 1
        body = code[m.end() - (m[3] == "{") : end]
        methods.append((1 + len(DECISIONS.findall(body)), nesting(body), code.count("\n", begin, end) + 1, len([p for p in re.sub(r"<[^<>]*>", "", m[2]).split(",") if p.strip()])))
    plain = re.sub(r"\bconst\b[^;]*;", "", code)
    magic = sum(x.rstrip("mMdDfFuUlL") not in ("0", "1", "2") for x in LITERAL.findall(plain))
    edges = set()
    for m in TYPE.finditer(code):
        opened = code.find("{", m.end())
        body = code[m.end() : closing(code, opened)] if opened >= 0 else ""
        edges |= {f"{m[2]} -> {other}" for other in set(names) - {m[2]} if re.search(rf"\b{other}\b", body)}
    top = lambda k: max((x[k] for x in methods), default=0)
    todos = sum(bool(re.search("todo|hack", c, re.I)) for c in comments)
    return name, len(names), len(methods), top(0), top(1), top(2), top(3), magic, todos, sorted(edges)


def code_metrics(sources: DataFrame) -> DataFrame:
    """One row for each source (name, source): types, methods, the greatest complexity, nesting, lines and parameters of a method, magic numbers, open ends in comments, and which type names which."""

    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(r["name"], r["source"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)

    return sources.select("name", "source").mapInArrow(run, SCHEMA)

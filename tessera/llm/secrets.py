"""Secret scans: three base patterns, and an assignment-aware lexer that adds literals by their names.

The lexer reads source and configuration syntax (`name = "x"`, `name: x`, `name := x`,
`"name": "x"`, `name => x`, `a + b` on the right) into name-literal pairs in order, keeps what each
name holds, and scores every literal that reaches a name by that name and the literal's form. A
literal assigned to a harmless name is found when that name is later assigned to a sensitive one.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, text_bytes

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")

_LITERAL = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[A-Za-z0-9_$][^\s"'`,;(){}\[\]<>|&*]*+'''
# A name is a whole run of name characters from its first letter on, so that no run is read twice.
PAIR = re.compile(rf'''(?<![A-Za-z0-9_.-])[0-9.-]*+([A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*+(?::=|=>|=(?!=)|:(?!:))[\x20\t]*+({_LITERAL})''')
MORE = re.compile(rf"[\x20\t]*+\+[\x20\t]*+({_LITERAL})")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Weights of the pieces of a target's name, and of adjacent pieces joined.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3,
    "privatekey": 3, "accesskey": 3, "secretkey": 3, "signingkey": 3, "encryptionkey": 3, "authkey": 3,
    "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "salt": 1, "key": 1, "cookie": 1, "session": 1,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?i)(?:change_?me|example|placeholder|your[_-].*|x{3,}|\*+|none|null|nil|true|false|undefined|todo|test|dummy|redacted|\$\{.*|<.*|%\(.*)\Z")
FOUND_AT, LEAST_LENGTH = 5.0, 6


def name_score(name: str) -> int:
    pieces = [p.lower() for p in PIECES.findall(name)]
    joined = pieces + [a + b for a, b in zip(pieces, pieces[1:])]
    return max((SENSITIVE.get(p, 0) for p in joined), default=0)


def value_score(value: str) -> float:
    """0 for placeholders and short values; else up to 4 for length, kinds of characters and entropy."""
    if len(value) < LEAST_LENGTH or PLACEHOLDERS.match(value) or "://" in value and "@" not in value:
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    return min(len(value), 20) / 20 + kinds / 4 + min(entropy, 4) / 2


def lex(text: str) -> set[tuple[int, int]]:
    """Bounds of the literals that reach a sensitive name and look like a secret."""
    holds: dict[str, tuple[tuple[int, int], ...]] = {}
    found: set[tuple[int, int]] = set()
    at = 0
    while pair := PAIR.search(text, at):
        name, spans, end = pair[1], [], pair.end()
        terms = [(pair[2], pair.start(2))]
        while more := MORE.match(text, end):
            terms.append((more[1], more.start(1)))
            end = more.end()
        for term, start in terms:
            if term[0] in "\"'`":
                spans.append((start + 1, start + len(term) - 1))
            elif term in holds:
                spans.extend(holds[term])
            elif start == pair.start(2) and not NAME.match(term) or any(c.isdigit() for c in term):
                spans.append((start, start + len(term.rstrip(".:"))))
        spans = tuple(dict.fromkeys(spans))
        holds[name] = spans
        weight = name_score(name)
        if weight >= 2 and spans:
            value = "".join(text[a:b] for a, b in spans)
            score = value_score(value)
            if score and weight + score >= FOUND_AT:
                found.update(s for s in spans if s[1] > s[0])
        # what follows a bare word may itself be the name of the next pair
        at = pair.start(2) if len(terms) == 1 and NAME.match(pair[2]) else end
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base patterns' matches, in order; bounds in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(spans)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the lexer's that no base span holds."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    starts, ends = [s for s, *_ in base], list(accumulate((e for *_, e in base), max))
    held = lambda a, b: (k := bisect.bisect_right(starts, a)) and ends[k - 1] >= b
    return base, sorted(base + [(a, 3, b) for a, b in lex(text) if not held(a, b)])


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_HEX_DIGIT = np.zeros(256, bool)
_HEX_DIGIT[[*range(48, 58), *range(97, 103)]] = True


def suspects(texts: pa.Array) -> list[int]:
    """Which texts can hold a span at all: an assignment sign, AKIA, or 32 hexadecimal digits in a row. Bounded blocks at a time."""
    raw, bounds = text_bytes(texts)
    out = []
    for first, last in blocks(bounds):
        part, own = raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        if not len(part):
            continue
        digits = _HEX_DIGIT[part]
        for step in (1, 2, 4, 8, 16):  # a position stays if `step` further ones, then twice as many, are digits
            digits = digits[:-step] & digits[step:] if len(digits) > step else digits[:0]
        at = np.concatenate([np.flatnonzero((part == 61) | (part == 58)), np.flatnonzero(digits), _positions(part, b"AKIA")])
        # a run may go over several texts: it marks each in which it has 32 digits left, and at most a text too many
        hit = np.zeros(last - first, bool)
        hit[np.searchsorted(own, at, "right") - 1] = True
        out += (first + np.flatnonzero(hit)).tolist()
    return out


def _positions(raw: np.ndarray, needle: bytes) -> np.ndarray:
    data, at, out = raw.tobytes(), -1, []
    while (at := data.find(needle, at + 1)) >= 0:
        out.append(at)
    return np.array(out, np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = batch.column(1)
        counts, digests, spans = np.zeros((3, len(texts)), np.int64), [empty] * len(texts), [""] * len(texts)
        for i in suspects(texts):
            base, every = all_spans(texts[i].as_py() or "")
            for _, kind, _ in base:
                counts[kind][i] += 1
            if base:
                digests[i] = hashlib.sha256(say(base).encode()).hexdigest()
            spans[i] = say(every)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: id, n_assign, n_access, n_hex, base_sha256 and spans.

    A span is `kind:start:end` of the whole match (for the lexer's `literal`, of the literal inside
    its quotes), in code points, end exclusive; spans are in order of start, then of kind. Null and
    empty texts have none. Null ids and repeated rows stay as they are; other columns are ignored.
    """
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scan, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return found.withColumnRenamed("id", id_col)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each stretch of joined spans replaced by the mark."""
    _, spans = all_spans(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with secrets replaced by the mark in the text, and the text's length (if that column exists) made right.

    Null texts stay null, empty ones empty, repeated rows and null ids are rows like others; no rows give no rows.
    """
    at, has_length = docs.columns.index(text_col), length_col in docs.columns
    texts_kind = docs.schema[text_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = {}
            for i in suspects(texts):
                if (text := texts[i].as_py()) and (safe := redact(text, mark)) != text:
                    new[i] = safe
            if new:
                spots = np.zeros(len(texts), bool)
                spots[list(new)] = True
                changed = pa.array([new[i] for i in sorted(new)], texts.type)
                batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, pa.array(spots), changed))
            yield batch

    assert texts_kind.typeName() == "string"
    out = docs.mapInArrow(run, docs.schema)
    if has_length:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out

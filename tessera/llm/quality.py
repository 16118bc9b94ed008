"""Document quality by a linear-chain conditional random field over lines.

Every line gets numeric features of its own text and of the lines before and after it. The field
labels all lines of a document good or bad at once; forward-backward gives each line's probability
of good, and their mean, weighted by the lines' lengths, is the document's evidence, which a logistic
curve fitted on the same training documents turns into its score.

The field is fitted by one task on a bounded sample of labelled documents (`sample`, a parameter,
chosen by a hash of the id), each line taking its document's label; the driver gets the weights
alone. Scoring is one pass over whole texts; nothing but the model is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACES, Words, blocks, text_bytes

#: Labelled documents that the field is fitted on, each with all of its lines.
SAMPLE = 6000
FEATURES = (
    "empty", "length", "words", "upper", "digits", "symbols", "stops", "bars", "exclaims", "wide",
    "word_length", "same_as_previous_word", "repeats_in_document", "pairs_repeat", "line_repeats", "capital", "ends_in_stop",
)

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_CLASS = np.zeros((256, 7), np.float64)
_CLASS[65:91, 0] = 1  # upper case
_CLASS[48:58, 1] = 1  # digits
for _b in b"#$%&*@^~=+<>\\/_{}[]":
    _CLASS[_b, 2] = 1  # symbols
for _b in b".,;:":
    _CLASS[_b, 3] = 1  # stops
_CLASS[ord("|"), 4] = 1
_CLASS[ord("!"), 5] = 1
_CLASS[128:, 6] = 1  # bytes of wide characters
_CODES = np.array([int(np.flatnonzero(r)[0]) + 1 if r.any() else 0 for r in _CLASS], np.uint8)


def line_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a block of texts, each line's weight (its bytes + 1), and each text's bounds among lines. An empty text is one empty line."""
    n_texts = len(bounds) - 1
    feeds = np.flatnonzero(_NEWLINE[raw]) if len(raw) else np.zeros(0, np.int64)
    # lines: from a text's start or after a line feed, to a line feed or the text's end; a text's last line feed opens no line of its own
    inner = feeds[np.searchsorted(bounds, feeds + 1, "right") - np.searchsorted(bounds, feeds, "right") == 0] + 1
    starts = np.sort(np.concatenate([bounds[:-1], inner]), kind="stable")
    texts_at = np.searchsorted(inner, bounds[:-1]) + np.arange(n_texts)
    first = np.append(texts_at, len(starts))
    ends = np.append(starts[1:], len(raw))
    size = (ends - starts).astype(np.float64)
    safe = np.maximum(size, 1)
    counts = np.zeros((len(starts), 8))
    codes = _CODES[raw]
    for code in range(1, 8):
        cum = np.concatenate([[0], np.cumsum(codes == code)])
        counts[:, code] = cum[ends] - cum[starts]
    words = Words(raw, np.append(starts, len(raw)), SPACES, lower=True)
    n_words = words.counts().astype(np.float64)
    some = np.maximum(n_words, 1)
    cum_letters = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    letters = (cum_letters[words.first[1:]] - cum_letters[words.first[:-1]]).astype(np.float64)
    h = words.hashes
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        opens = words.first[:-1]
        same[opens[opens < len(h)]] = False
    document_of_line = np.repeat(np.arange(n_texts), np.diff(first))
    document = np.repeat(document_of_line, words.counts())
    pair = np.zeros(len(h), np.uint64)
    if len(h):
        pair[1:] = h[1:] * np.uint64(0x9FB21C651E98DF25) + h[:-1]
    again, pairs_again = _seen(h, document), _seen(pair, document)
    per_line = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[words.first])
    line_hash = np.zeros(len(starts), np.uint64)
    if len(h):
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts()).astype(np.uint64) + np.uint64(1)))])
        line_hash = cum[words.first[1:]] - cum[words.first[:-1]]
    line_again = _seen(line_hash, document_of_line) & (n_words > 0)
    opening = np.zeros(len(starts))
    closing = np.zeros(len(starts))
    if len(raw):
        full = size > 0
        opening[full] = (raw[starts[full]] >= 65) & (raw[starts[full]] <= 90) | (raw[starts[full]] >= 128)
        last = ends[full] - 1
        last = np.where((raw[last] == 10) & (last > starts[full]), last - 1, last)
        closing[full] = raw[last] == 46
    rate = counts / safe[:, None]
    x = np.column_stack([
        n_words == 0, np.log1p(size) / 5, np.log1p(n_words) / 3, rate[:, 1] * 3, rate[:, 2] * 10, np.sqrt(rate[:, 3]) * 4, np.sqrt(rate[:, 4]) * 4,
        np.sqrt(rate[:, 5]) * 4, np.sqrt(rate[:, 6]) * 4, rate[:, 7] * 5, letters / some / 5, per_line(same) / some * 3,
        per_line(again) / some * 2, per_line(pairs_again) / some * 3, line_again, opening, closing,
    ])
    return np.clip(x, -5, 5), size + 1, first


def _seen(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which values occurred before in their group."""
    if not len(values):
        return np.zeros(0, bool)
    key = values * np.uint64(0xD6E8FEB86659FD93) + groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(values), bool)
    ordered = key[order]
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text (zero at the ends), which of them are missing, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    opens, closes = np.zeros((2, len(x), 1))
    opens[first[:-1]], closes[first[1:] - 1] = 1, 1
    before *= 1 - opens
    after *= 1 - closes
    return np.hstack([x, before, after, opens, closes, np.ones((len(x), 1))])


@dataclass
class Field:
    """Weights of good against bad for each feature, and of each pair of neighbouring labels; the curve from evidence to score."""

    weights: np.ndarray
    steps: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """P(good) of each line, P of each pair of labels summed over neighbours, log of the partition function, and forward-backward's emissions."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = first[:-1][order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        forward, backward = emit.copy(), np.zeros_like(emit)
        for t in range(1, len(active)):
            at = begins[: active[t]] + t
            forward[at] += np.logaddexp(forward[at - 1, :1] + self.steps[0], forward[at - 1, 1:] + self.steps[1])
        for t in range(len(active) - 2, -1, -1):
            at = begins[: active[t + 1]] + t
            ahead = emit[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(ahead[:, :1] + self.steps[:, 0], ahead[:, 1:] + self.steps[:, 1])
        ends = begins + lengths - 1
        z = np.logaddexp(forward[ends, 0], forward[ends, 1])
        z_line = np.empty(len(x))
        z_line[first[:-1][order]] = z
        z_line = z_line[np.repeat(first[:-1], np.diff(first))]
        good = np.exp(forward[:, 1] + backward[:, 1] - z_line)
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] + self.steps[None] + (emit[at] + backward[at])[:, None, :] - z_line[at][:, None, None]
        return good, np.exp(joint).sum(axis=0), float(z.sum()), emit

    def evidence(self, x: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The logit of each text's length-weighted mean of its lines' P(good)."""
        good = self.marginals(x, first)[0]
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, x: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-(slope * self.evidence(x, weight, first) + shift)))


def _climb(gain, theta: np.ndarray, rounds: int, memory: int = 8, least: float = 1e-5) -> np.ndarray:
    """The maximum of a concave function by limited-memory BFGS; `gain` gives value and gradient."""
    value, slope = gain(theta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < least:
            break
        way, shares = slope.copy(), []
        for s, y, rho in reversed(steps):
            shares.append(rho * (s @ way))
            way -= shares[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), share in zip(steps, reversed(shares)):
            way += s * (share - rho * (y @ way))
        rise, far = slope @ way, 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(slope))
        for _ in range(30):
            new_value, new_slope = gain(theta + far * way)
            if new_value >= value + 1e-4 * far * rise:
                break
            far /= 2
        else:
            break
        s, y = far * way, slope - new_slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        theta, value, slope = theta + s, new_value, new_slope
    return theta


def fit(x: np.ndarray, weight: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 100, penalty: float = 1e-3) -> Field:
    """Maximum conditional likelihood (with a small ridge), then the curve by Newton's method."""
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(labels):
        return field
    y = np.repeat(labels, np.diff(first)).astype(np.float64)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    n, own = len(x), x.T @ y

    def gain(theta: np.ndarray) -> tuple[float, np.ndarray]:
        field.weights, field.steps = theta[:-4], theta[-4:].reshape(2, 2)
        good, joint, z, _ = field.marginals(x, first)
        value = (own @ field.weights + (pairs * field.steps).sum() - z) / n - penalty / 2 * theta @ theta
        return value, np.concatenate([own - x.T @ good, (pairs - joint).ravel()]) / n - penalty * theta

    theta = _climb(gain, np.zeros(x.shape[1] + 4), rounds)
    field.weights, field.steps = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    e, target = field.evidence(x, weight, first), labels.astype(np.float64)
    beta = np.array([0.5, 0.0])
    design = np.column_stack([e, np.ones_like(e)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (target - p) - 1e-2 * beta
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(curvature, gradient)
    field.curve = (max(float(beta[0]), 1e-3), float(beta[1]))
    return field


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each training document: label, number of lines, features and weights as bytes."""
    for batch in batches:
        raw, bounds = text_bytes(batch.column(1))
        sizes, blobs, weights = [], [], []
        for i in range(len(batch)):
            x, weight, first = line_features(raw[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
            sizes.append(len(x))
            blobs.append(x.astype("<f4").tobytes())
            weights.append(weight.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary()), pa.array(weights, pa.binary())], names=["id", "label", "n", "x", "weight"])


def _fitted(table: pa.Table) -> pa.Table:
    """The field fitted on the rows of _lines, as one row."""
    table = table.sort_by([("id", "ascending"), ("n", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
    weight = np.frombuffer(b"".join(table["weight"].to_pylist()), "<f4").astype(np.float64)
    first = np.concatenate([[0], np.cumsum(table["n"].to_numpy())]).astype(np.int64)
    field = fit(with_neighbours(x, first), weight, first, table["label"].to_numpy())
    return pa.table({k: pa.array([np.ravel(v).tolist()], pa.list_(pa.float64())) for k, v in vars(field).items()})


def training_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, label, n, x, weight) of each row of `docs` that is trained on: its number of lines, their features and weights as bytes."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` pairs
    return rows.select("id", "text", "label").mapInArrow(_lines, "id long, label int, n int, x binary, weight binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """The field fitted on at most `sample` labelled documents, whole ones: one task holds 17 numbers of each of their lines, and 54 while it fits. Labels of ids with crc32 modulo 5 = 0 (held out) are not read.

    Rows without an id or label are ignored; an id with several labels takes the smallest; of rows
    that share an id, all are used. Without labelled documents every score is 0.5.
    """
    lines = training_lines(docs, labels, sample, id_col, text_col, label_col)
    found = lines.groupBy(F.lit(0).alias("all")).applyInArrow(_fitted, "weights array<double>, steps array<double>, curve array<double>").collect()  # one row
    if not found:
        return Field(np.zeros(3 * len(FEATURES) + 3), np.zeros((2, 2)))
    return Field(np.array(found[0].weights), np.array(found[0].steps).reshape(2, 2), tuple(found[0].curve))


def _scores(field: Field, texts: pa.Array) -> np.ndarray:
    raw, bounds = text_bytes(texts)
    out = [np.zeros(0)]
    for a, b in blocks(bounds):
        x, weight, first = line_features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        out.append(field.score(with_neighbours(x, first), weight, first))
    return np.concatenate(out)


def score_quality(docs: DataFrame, field: Field, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: id, held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts are one empty line; a very long text is scored whole, in a block of its own. held_out is whether crc32 of the id as text is 0 modulo
    5 (null for a null id). Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(field, batch.column(1)))], names=["id", "score"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return found.select(F.col("id").alias(id_col), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score at least the threshold, unchanged.

    Null and empty texts are one empty line, repeated rows are judged each for itself (and alike), null ids do not matter;
    no rows give no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(field, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

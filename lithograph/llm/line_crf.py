"""Document quality from a linear-chain conditional random field over lines (operator 5).

Every line is good or bad. A line's emission weighs features of the line and of the lines beside it; neighbours are
coupled by a transition matrix. Forward-backward gives each line's probability of good, and the probabilities, weighted
by the lines' lengths, aggregate to the document. The field is fitted by maximum likelihood on a bounded sample of
labelled documents whose lines take the document's label; a logistic curve then maps the aggregate to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_stats import SYMBOL_BYTES, counted

#: At most so many labelled documents fit the model, none of them with more lines than MAX_LINES.
SAMPLE_DOCS, MAX_LINES = 4000, 300
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
OWN = 16
FEATURES = 3 * OWN + 3
#: Aggregates that the logistic curve sees.
AGGREGATES = 5


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines with words of a text: own features, then those of the line before and after."""
    lines = [words for line in data.split(b"\n") if (words := line.split())]
    if not lines:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0)
    own, seen, before = np.zeros((len(lines), OWN), np.float32), set(), set()
    for i, words in enumerate(lines):
        line = b" ".join(words)
        n, size = len(words), len(line)
        upper, lower = counted(line, UPPER), counted(line, LOWER)
        distinct = set(words)
        own[i] = (
            min(counted(line, SYMBOL_BYTES) / size * 10, 2), upper / max(upper + lower, 1), min(counted(line, b"!") / n, 2), min(counted(line, b"|") / n, 2),
            1 - len(distinct) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, line in seen, len(distinct & before) / len(distinct),
            min(abs(size / n - 6.2) / 4, 2), n < 4, n < 10, np.log1p(n) / 5, line[-1:] in b".!?", counted(line, b".,;:?") / n,
            min(counted(line, DIGITS) / size * 5, 2), sum(len(w) <= 3 for w in words) / n,
        )
        seen.add(line)
        before |= distinct
    return beside(own), np.array([sum(map(len, words)) for words in lines], float)


def beside(own: np.ndarray) -> np.ndarray:
    """Add the features of the line before and after, a bias, and marks of the first and the last line."""
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN], out[1:, OWN : 2 * OWN], out[:-1, 2 * OWN : 3 * OWN], out[:, -3] = own, own[:-1], own[1:], 1
    out[:1, -2], out[-1:, -1] = 1, 1
    return out


def marginals(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of one chain with two states: (log partition, P(state) per line, summed P(state, next state))."""
    n = len(emission)
    if n == 1:
        z = np.logaddexp(emission[0, 0], emission[0, 1])
        return z, np.exp(emission - z), np.zeros((2, 2))
    potential = np.exp(emission - emission.max(1, keepdims=True)).tolist()
    step = np.exp(transition).tolist()
    forward = [(0.0, 0.0)] * n
    x, y = potential[0]
    forward[0] = (x / (x + y), y / (x + y))
    logs = np.log(x + y)
    for i in range(1, n):
        p, q = forward[i - 1]
        x, y = (p * step[0][0] + q * step[1][0]) * potential[i][0], (p * step[0][1] + q * step[1][1]) * potential[i][1]
        scale = x + y
        logs += np.log(scale)
        forward[i] = (x / scale, y / scale)
    backward = [(1.0, 1.0)] * n
    for i in range(n - 2, -1, -1):
        x, y = backward[i + 1][0] * potential[i + 1][0], backward[i + 1][1] * potential[i + 1][1]
        p, q = step[0][0] * x + step[0][1] * y, step[1][0] * x + step[1][1] * y
        backward[i] = (p / (p + q), q / (p + q))
    f, r = np.array(forward), np.array(backward)
    state = f * r
    state /= state.sum(1, keepdims=True)
    pair = f[:-1, :, None] * np.array(step)[None] * (np.array(potential)[1:] * r[1:])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return logs + emission.max(1).sum(), state, pair.sum(0)


def aggregate(good: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the curve sees of a document: bias, length-weighted good, its logit, the length, no text at all."""
    if not len(good):
        return np.array([1, 0, 0, 0, 1.0])
    mean = float(np.clip(good @ lengths / lengths.sum(), 1e-4, 1 - 1e-4))
    return np.array([1, mean, np.log(mean / (1 - mean)), np.log1p(lengths.sum()) / 5, 0])


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - labels) + ridge * w
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 30, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Fit the field on (features, lengths, label) by Adam on minibatches in a fixed order, then the curve."""
    rng = np.random.default_rng(5)
    chains = [(f, y) for f, _, y in sample if len(f)]
    weight, transition = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if len({y for _, y in chains}) == 2:
        share = {y: 0.5 * len(chains) / sum(z == y for _, z in chains) for y in (0, 1)}  # labels are uneven
        moments = [np.zeros_like(weight), np.zeros_like(transition), np.zeros_like(weight), np.zeros_like(transition)]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(chains))
            for at in range(0, len(order), 64):
                gw, gt, total = ridge * weight, ridge * transition, 0.0
                for i in order[at : at + 64]:
                    f, y = chains[i]
                    _, state, pair = marginals(f @ weight, transition)
                    target = np.zeros_like(state)
                    target[:, y] = 1
                    c = share[y] / len(f) ** 0.5
                    gw = gw + c * (f.T @ (state - target))
                    gold = np.zeros((2, 2))
                    gold[y, y] = len(f) - 1
                    gt = gt + c * (pair - gold)
                    total += c
                t += 1
                for k, (p, g) in enumerate(((weight, gw / total), (transition, gt / total))):
                    moments[k] = 0.9 * moments[k] + 0.1 * g
                    moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
                    p -= 0.08 * 0.93**epoch * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 2] / (1 - 0.99**t)) + 1e-8)
    transition = np.clip(transition, -3, 3)
    model = {"weight": weight, "transition": transition}
    rows = np.array([aggregate(marginals(f @ weight, transition)[1][:, 1] if len(f) else np.zeros(0), n) for f, n, _ in sample]).reshape(-1, AGGREGATES)
    labels = np.array([y for *_, y in sample], float)
    return model | {"curve": logistic(rows, labels) if len(rows) else np.zeros(AGGREGATES)}


def score(model: dict[str, np.ndarray], features: np.ndarray, lengths: np.ndarray) -> float:
    good = marginals(features @ model["weight"], model["transition"])[1][:, 1] if len(features) else np.zeros(0)
    return float(1 / (1 + np.exp(-np.clip(aggregate(good, lengths) @ model["curve"], -30, 30))))


def sampled(docs: DataFrame, known: DataFrame, sample_docs: int) -> DataFrame:
    """text and label of the sample_docs rows of ``known`` (doc_id, label 0 or 1) whose doc_ids hash lowest.

    The sample is taken from the labels, so what is broadcast to the documents is bounded by sample_docs ids.
    """
    chosen = known.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, known: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Fit on a sample of ``known`` (doc_id, label 0 or 1) joined to ``docs`` (doc_id, text).

    Only features of the sample reach the driver: at most sample_docs x MAX_LINES lines. Longer documents aren't
    sampled; they are scored whole like all others. Rows without a label aren't used.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, n = line_features((text or "").encode())
                rows.append({"features": f[:, :OWN].astype("<f4").tobytes(), "lengths": n.astype("<f8").tobytes(), "label": label})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("features", pa.binary()), ("lengths", pa.binary()), ("label", pa.int32())]))

    short = F.coalesce(F.length(F.regexp_replace("text", "[^\n]+", "")), F.lit(0)) < MAX_LINES
    rows = sampled(docs, known, sample_docs).where(short).mapInArrow(featured, "features binary, lengths binary, label int").collect()
    rows.sort(key=lambda r: (r["features"], r["lengths"], r["label"]))  # in an order that tasks don't decide
    sample = []
    for r in rows:
        own, lengths = np.frombuffer(r["features"], "<f4").reshape(-1, OWN), np.frombuffer(r["lengths"], "<f8")
        sample.append((beside(own), lengths, r["label"]))
    return fit(sample)


def score_documents(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score (0 to 1, high: good) of every whole text; null and blank texts get the curve's value for no lines."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(model, *line_features((text or "").encode())) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Labels are learnt only from rows where crc32 of the doc_id's text isn't 2 modulo 4; those are held_out. Null
    doc_ids have held_out false and are scored; rows that repeat are scored each; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.select(F.col("doc_id"), F.col("quality").alias("label")).where(~held & F.col("label").isNotNull())
    model = train(docs, known)
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

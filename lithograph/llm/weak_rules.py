"""Quality rules as weak supervision (operator 9).

Rules vote good, bad or abstain on counts over the whole text. How often each rule is right isn't set by hand: over all
documents the votes are counted by pattern, and expectation-maximisation on these counts estimates, for good and bad
documents, the rate of every rule's votes, and the share of good documents. A document's verdict is the posterior
probability that it is good. R rules have at most 3^R patterns, which bounds what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text_stats import SPACE_BYTES, SYMBOL_BYTES, WordHashes, counted, repeated_words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_stops", "n_bangs")
BAD, ABSTAIN, GOOD = 0, 1, 2
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Each rule: name, SQL of its value, bad if at or above, good if at or below (a bad bound below the good one: the other way round).
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", 0.02, 0.002),
    ("upper_case", "n_upper / greatest(n_letters, 1)", 0.3, 0.12),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.15, 0.02),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.2, 0.0),
    ("bangs", "n_bangs / greatest(n_words, 1)", 0.2, 0.02),
    ("word_variety", "n_distinct / greatest(pow(n_words, 0.8), 1)", 0.5, 0.9),
    ("short_words", "n_stops / greatest(n_words, 1)", 0.08, 0.15),
    ("word_length", "abs(word_chars / greatest(n_words, 1) - 5.5)", 3.0, 1.5),
)
ROUNDS = 200


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; null texts have zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(COUNTS)), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                words = data.split()  # bytes split at ASCII white space only
                if not words:
                    continue
                distinct = set(words)
                lines = [line for line in data.split(b"\n") if line.strip(SPACE_BYTES)]
                upper = counted(data, UPPER)
                rows[i] = (
                    len(words), len(text) - counted(data, SPACE_BYTES), counted(data, SYMBOL_BYTES), len(lines) - len(set(lines)),
                    repeated_words(hashes.of(words)), len(lines), upper, upper + counted(data, LOWER), len(distinct),
                    sum(len(word) <= 3 and word.isalpha() for word in words), counted(data, b"!"),
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def votes(counts: DataFrame) -> DataFrame:
    """Add ``pattern``: one digit per rule, 0 bad, 1 abstain, 2 good."""

    def digit(value: str, bad: float, good: float) -> str:
        below = bad < good
        return f"case when {value} {'<=' if below else '>='} {bad} then '0' when {value} {'>=' if below else '<='} {good} then '2' else '1' end"

    return counts.withColumn("pattern", F.concat(*[F.expr(digit(*rule[1:])) for rule in RULES]))


def estimate(patterns: list[str], n: list[int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray]:
    """EM over pattern counts: the posterior of good per pattern, and rates[class, rule, vote] (class 1 good).

    Starts from the share of good votes among votes cast, so class 1 is the one that the rules call good; a vote's rate
    counts a small prior, so that none is zero.
    """
    if not patterns:
        return {}, np.zeros((2, len(RULES), 3))
    cast = np.array([[int(x) for x in p] for p in patterns])
    weight = np.array(n, float)
    one_hot = np.eye(3)[cast]  # pattern, rule, vote
    good, bad = (cast == GOOD).sum(1), (cast == BAD).sum(1)
    posterior = (good + 1.0) / (good + 3.0 * bad + 2.0)
    for _ in range(rounds):
        by_class = np.stack([1 - posterior, posterior]) * weight
        share = (by_class.sum(1) + 1) / (by_class.sum() + 2)
        rates = np.einsum("cp,prv->crv", by_class, one_hot) + 0.01 * weight.sum() ** 0.5
        rates /= rates.sum(2, keepdims=True)
        joint = np.log(share)[:, None] + np.einsum("prv,crv->cp", one_hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -700, 700)))
        done, posterior = np.abs(new - posterior).max() < 1e-9, new
        if done:
            break
    return dict(zip(patterns, posterior.tolist(), strict=True)), rates


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, posterior, pattern.

    base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed and the
    posterior reaches ``threshold``. Null and blank texts have zero counts and fail; repeated rows are judged each;
    an empty table gives no rows; other columns are ignored.
    """
    voted = written(votes(text_counts(docs)), "votes")
    seen = voted.groupBy("pattern").count().collect()  # at most 3^len(RULES) rows
    seen.sort(key=lambda r: r["pattern"])
    posterior, _ = estimate([r["pattern"] for r in seen], [r["count"] for r in seen])
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "pattern string, posterior double")
    out = voted.join(F.broadcast(table), "pattern")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "pattern")

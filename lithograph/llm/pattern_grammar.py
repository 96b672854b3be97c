"""Toxicity by a weighted finite-state pattern grammar (operator 8).

A clause is read as a string of symbols: insult, threat, target, negation, report, quote, other. Three transducers are
composed, each reading what the one before writes: reported speech marks the symbols that are quoted or told, negation
marks those that follow it closely, and the matcher pairs marked insults and threats with targets and writes into which of
three sums a match counts. The composition is one table of the states that can be reached. Only what the matcher accepts
counts: an insult by itself weakly, an insult or threat with a target in the same clause more; negated and reported matches
are summed apart. Which words are insults and how much they weigh is learnt from labelled documents (words and word
beginnings whose share among toxic documents is significantly higher), besides short fixed lists; a logistic curve over the
sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_crf import logistic, sampled
from .shared import written

#: At most so many labelled documents teach the lexicon and the curve; the lexicon has at most LEXICON entries.
SAMPLE_DOCS, LEXICON = 20_000, 4_000
#: A lexicon entry occurs in so many toxic documents at least and is so much more frequent there (log ratio).
LEAST_DOCS, LEAST_WEIGHT = 4, 2.5
BEGINNINGS = (4, 5, 6)

#: Fixed word lists of the grammar (English, French, German, Spanish).
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile crétin dummkopf estúpido"
THREATS = "kill hurt destroy beat burn shoot stab tuer frapper töten schlagen matar golpear"
TARGETS = "you your you're u he she they them him her his their these those people tu vous toi du dich ihr sie tú usted ustedes"
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't won't kein keine nicht nie jamais aucun nunca ningún"
REPORTS = "said says say told wrote claimed reported quoted sagte schrieb berichtete dit écrit dijo escribió"
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, CLAUSE_END = range(8)
NEGATION_REACH = 3
#: Least weight of the words of the fixed lists.
LISTED_WEIGHT = 3.0
FEATURES = 7

#: What a transducer reads and writes: a symbol with its marks.
PLAIN, TOLD, NEGATED = 0, 1, 2
#: The sums that matches count in: plain, negated (also if told), told.
COLUMNS = {PLAIN: 0, NEGATED: 1, TOLD | NEGATED: 1, TOLD: 2}


def reporting(state: int, read: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    """Marks what is told. States: 0 plain, 1 after a reporting verb (to the clause's end), 2 inside quotation marks."""
    symbol, marks = read
    if symbol == QUOTE:
        return (0 if state == 2 else 2), read
    if symbol == CLAUSE_END:
        return (2 if state == 2 else 0), read
    return (1 if symbol == REPORT and state == 0 else state), (symbol, marks | TOLD if state else marks)


def negation(state: int, read: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    """Marks the NEGATION_REACH symbols behind a negation, up to the clause's end. States: how many are left."""
    symbol, marks = read
    if symbol == NEGATION:
        return NEGATION_REACH, read
    if symbol == CLAUSE_END:
        return 0, read
    return max(0, state - 1), (symbol, marks | NEGATED if state else marks)


def matching(state: int, read: tuple[int, int]) -> tuple[int, tuple[int, str]]:
    """Writes the sum and the kind of each match, '' for none. States: bit 0 a target was read, bit 1 an insult or threat
    waits for one."""
    symbol, marks = read
    column = COLUMNS[marks]
    if symbol == CLAUSE_END:
        return 0, (column, "")
    if symbol == TARGET:
        return 1, (column, "aim" if state & 2 else "")
    if symbol in (INSULT, THREAT):
        return (state, (column, "aimed")) if state & 1 else (2, (column, "alone" if symbol == INSULT else ""))
    return state, (column, "")


def composed(*machines: Callable) -> dict[tuple, tuple[tuple[int, ...], tuple[int, str]]]:
    """The composition of transducers that each read what the one before writes: (states, symbol) -> (states, what the
    last one writes), for all states that can be reached from the start."""
    table, start = {}, (0,) * len(machines)
    found = [start]
    for states in found:
        for symbol in range(CLAUSE_END + 1):
            passed, after = (symbol, PLAIN), []
            for machine, state in zip(machines, states, strict=True):
                state, passed = machine(state, passed)
                after.append(state)
            table[(*states, symbol)] = tuple(after), passed
            if tuple(after) not in found:
                found.append(tuple(after))
    return table


class Reader(dict):
    """Symbol and weight of each word form; forms are looked up in the lists and the lexicon once."""

    LIMIT = 500_000
    CORE = re.compile(r"^\W+|\W+$")

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.table = lexicon, composed(reporting, negation, matching)
        self.lists = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words.split()}

    def __missing__(self, form: str) -> tuple[int, float]:
        core = self.CORE.sub("", form)
        weight = max([self.lexicon.get(e, 0.0) for e in entries(core)], default=0.0)
        symbol = self.lists.get(core, OTHER)
        if symbol in (INSULT, THREAT):
            weight = max(weight, LISTED_WEIGHT)
        elif symbol == OTHER and weight:  # what is learnt keeps its own weight
            symbol = INSULT
        self[form] = found = (symbol, weight)
        return found

    def features(self, text: str) -> np.ndarray:
        """Bias, then of matched weights: sums plain, negated, reported (log), largest clause, per word, number (log)."""
        if len(self) > self.LIMIT:
            self.clear()
        out = np.zeros(FEATURES)
        out[0] = 1
        lowered = text.lower()
        forms = lowered.split()
        symbols = list(map(self.__getitem__, forms))
        if not any(w for _, w in symbols):
            return out
        sums, clause, largest, n = [0.0, 0.0, 0.0], 0.0, 0.0, 0
        for line in lowered.split("\n"):
            states, waiting = (0, 0, 0), 0.0
            for form in line.split():
                symbol, weight = self[form]
                ends = form[-1] in ".!?;:" or form[-2:-1] in (".", "!", "?")
                read = ([QUOTE] if form[0] in "\"“«„" else []) + [symbol] + ([QUOTE] if form.rstrip(".,!?;:")[-1:] in ("\"", "”", "»") else []) + ([CLAUSE_END] if ends else [])
                for s in read:
                    states, (column, match) = self.table[(*states, s)]
                    if match:
                        n += match != "aim"
                        gain = weight * (1.5 if match == "aimed" else 1.0) if match != "aim" else 0.5 * waiting
                        sums[column] += gain
                        clause += gain if column == 0 else 0
                        waiting = 0.0
                    if s in (INSULT, THREAT):
                        waiting = weight
                    if s == CLAUSE_END:
                        largest, clause, waiting = max(largest, clause), 0.0, 0.0
            largest, clause = max(largest, clause), 0.0
        out[1:4] = np.log1p(sums)
        out[4], out[5], out[6] = min(largest, 20) / 10, min(sum(sums) / len(forms), 1), math.log1p(n)
        return out


def entries(core: str) -> list[str]:
    """What the lexicon may know a word by: the word itself (marked) and its beginnings."""
    return ["=" + core, *(core[:k] for k in BEGINNINGS if len(core) > k)] if len(core) > 1 else []


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries with their weight (log ratio of document shares) from ``sample`` (text, label)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cores = {Reader.CORE.sub("", form) for form in set((text or "").lower().split())}
                seen[label].update({e for core in cores for e in entries(core)})
                seen[label][""] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([seen[1][k] for k in some]), pa.array([seen[0][k] for k in some])], ["entry", "toxic", "clean"])

    found = sample.select("text", "label").mapInArrow(counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    found = written(found, "entries")
    totals = found.where("entry = ''").first()
    if not totals or not totals["a"] or not totals["b"]:
        return {}
    A, B = totals["a"], totals["b"]
    share = A / (A + B)
    n = F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0))
    weight = F.log((F.col("a") + 0.5) / (A + 1)) - F.log((F.col("b") + 0.5) / (B + 1))
    rows = found.where((F.col("entry") != "") & (F.col("a") >= LEAST_DOCS)).select("entry", ratio.alias("ratio"), weight.alias("weight"))
    least = 2 * math.log(max(1, rows.count())) + 2  # of so many entries, fewer than one reaches this by chance
    best = rows.where((F.col("ratio") >= least) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("ratio"), "entry").limit(LEXICON).collect()
    return {r["entry"]: r["weight"] for r in best}


def train(docs: DataFrame, known: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Lexicon and curve from a sample of ``known`` (doc_id, label 0 or 1) joined to ``docs`` (doc_id, text)."""
    sample = written(sampled(docs, known, sample_docs), "labelled")
    lexicon = learn_lexicon(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            rows = [reader.features(t or "").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["features", "label"])

    rows = sample.mapInArrow(featured, "features binary, label int").collect()  # sample_docs rows at most
    features = np.array([np.frombuffer(r["features"]) for r in rows]).reshape(-1, FEATURES)
    labels = np.array([r["label"] for r in rows], float)
    # before any label is seen, a document with plain insults counts as toxic
    prior = np.concatenate([np.zeros((2, FEATURES)), np.ones((2, FEATURES))])
    prior[:, 0] = 1
    return {"lexicon": lexicon, "curve": logistic(np.concatenate([features, prior]), np.concatenate([labels, [0, 0, 1, 1]]), ridge=0.01)}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1, high: toxic) of every whole text; null and blank texts match nothing."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model["lexicon"])
        for batch in batches:
            rows = np.array([reader.features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(rows @ model["curve"], -30, 30))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all their columns, by ``classify``'s model."""
    model, at = train(docs, known_labels(labels)), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model["lexicon"])
        for batch in batches:
            rows = np.array([reader.features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(rows @ model["curve"], -30, 30))) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out() & F.col("label").isNotNull())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Labels are learnt only from rows where crc32 of the doc_id's text isn't 1 modulo 3; those are held_out. Null
    doc_ids have held_out false and are scored; rows that repeat are scored each; an empty table gives no rows.
    """
    model = train(docs, known_labels(labels))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

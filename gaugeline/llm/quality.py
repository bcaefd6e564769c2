"""Ordinal quality: a cumulative-link model over hashed words.

Grades 0 .. K-1 share one weight vector over hashed text and K-1 ordered
thresholds: P(grade > j) = 1 / (1 + exp(t_j - w.x)), t_1 < t_2 < ...  The text
counts for each word the word, its shape (letters and digits collapsed, signs
kept) and whether it repeats the word before, scaled by the square root of its
length.  From the tails come the
expected grade and the probability of at least a wanted grade.

How it runs: the labelled sample is read into hashed places and dealt to a few
shards.  In each round every shard runs stochastic gradient steps from the
common weights, and the driver averages the results: SHARDS vectors of fixed
length a round, whatever the corpus.  Scoring runs where texts lie, without a
shuffle.

Defined results: null and empty texts score as the bias alone; repeated rows
score alike; grades that the sample lacks leave their thresholds apart by a
fixed step; without labels every document has the same scores and stays; an
empty table gives no rows; other columns are not used and, in ``kept``, stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import settle
from gaugeline.llm.labelled import labelled_sample
from gaugeline.llm.tokens import batches, strings

PLACES = 1 << 17
SHARDS = 6
ROUNDS, EPOCHS, BATCH = 3, 2, 64
#: Rows a shard goes through in a round, counting repeats.
LEAST_ROWS = 4000
#: Places that a shard learns from at a time: it goes through its rows part by part, each of about so many.
HELD_PLACES = 20_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def _shape(word: str) -> str:
    def letters(m):
        w = m.group()
        return "A" if w.isupper() and len(w) > 1 else "a"

    return _DIGITS.sub("9", _LETTERS.sub(letters, word))


def _place(part: str) -> int:
    return xxhash.xxh32_intdigest(part) & (PLACES - 1)


#: Whether a word is the one before it.
_AGAIN, _NEW = _place("\x01again"), _place("\x01new")


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and shapes of texts on end, and the count of places of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = strings(coded.dictionary)
    word = np.fromiter((_place(w.lower()) for w in words), dtype=np.int32, count=len(words))
    shape = np.fromiter((_place("\x00" + _shape(w)) for w in words), dtype=np.int32, count=len(words))
    index, counts = coded.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
    again = np.concatenate([[False], index[1:] == index[:-1]]) if len(index) else np.empty(0, bool)
    again[(np.cumsum(counts) - counts)[counts > 0]] = False
    return np.stack([word[index], shape[index], np.where(again, _AGAIN, _NEW)], axis=1).astype(np.int32).ravel(), 3 * counts


def linear(places: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """w.x of each text."""
    sums = np.concatenate([[0.0], np.cumsum(weights[places])])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.sqrt(np.maximum(counts, 1))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > j) for each text and j."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30)))


def descend(places: np.ndarray, counts: np.ndarray, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the negative log-likelihood, in a fixed random order.

    The likelihood of grade g is the difference of two neighbouring tails; the
    thresholds are kept in order by taking gaps of at least a hundredth.
    """
    w, t = weights.astype(np.float64).copy(), thresholds.copy()
    past_w, past_t = np.full(len(w), 1e-3), np.full(len(t), 1e-3)
    ends = np.cumsum(counts)
    rng = np.random.default_rng(seed)
    # small shards take more turns, so that a fit has enough steps
    for _ in range(max(epochs, -(-LEAST_ROWS // max(1, len(counts))))):
        for chunk in np.array_split(rng.permutation(len(counts)), max(1, len(counts) // BATCH)):
            n = counts[chunk]
            at = np.repeat(ends[chunk] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            some = places[at]
            s = linear(some, n, w)
            p = np.concatenate([np.ones((len(chunk), 1)), tails(s, t), np.zeros((len(chunk), 1))], axis=1)
            g = grades[chunk]
            low, high = p[np.arange(len(g)), g], p[np.arange(len(g)), g + 1]
            like = np.maximum(low - high, 1e-6)
            d_low, d_high = low * (1 - low), high * (1 - high)
            ds = -(d_low - d_high) / like
            owner = np.repeat(ds / np.sqrt(np.maximum(n, 1)), n)
            grad = np.bincount(some, owner, len(w)) / len(chunk)
            past_w += grad**2
            w -= rate * grad / np.sqrt(past_w)
            dt = np.zeros(len(t) + 2)
            np.add.at(dt, g, d_low / like)
            np.add.at(dt, g + 1, -d_high / like)
            dt = dt[1:-1] / len(chunk)
            past_t += dt**2
            t -= 0.5 * rate * dt / np.sqrt(past_t)
            t = np.maximum.accumulate(t + np.arange(len(t)) * 1e-2) - np.arange(len(t)) * 1e-2
            t[1:] = np.maximum(t[1:], t[:-1] + 1e-2)
    return w, t


def fit(sample: DataFrame, grades: int, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from rows (text, grade)."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(0)):
                places, counts = hashed(part.column(0).slice(a, b - a))
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(places)), part.column(1).slice(a, b - a)], ["places", "grade"])

    def shards() -> DataFrame:
        return rows.repartition(SHARDS, F.pmod(F.xxhash64("places"), F.lit(SHARDS))).sortWithinPartitions(F.xxhash64("places", "grade"))

    def part_of(held: list[pa.RecordBatch], w: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["places"].chunk(0)
        return descend(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), table["grade"].to_numpy().astype(np.int64), w, t, EPOCHS, rate / (1 + k), k)

    rows = settle(sample.select("text", "grade").mapInArrow(read, "places array<int>, grade int"), "graded")
    weights, thresholds = np.zeros(PLACES), np.arange(grades - 1) - (grades - 2) / 2.0
    for k in range(ROUNDS):

        def learn(parts: Iterator[pa.RecordBatch], w=weights, t=thresholds, k=k) -> Iterator[pa.RecordBatch]:
            held, size, n = [], 0, 0
            for p in parts:
                held.append(p)
                size += len(p.column(0).flatten())
                n += len(p)
                if size >= HELD_PLACES:
                    w, t = part_of(held, w, t, k)
                    held, size = [], 0
            if any(map(len, held)):
                w, t = part_of(held, w, t, k)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([w, t]).astype(np.float32).tobytes()], pa.binary())], ["n", "model"])

        found = shards().mapInArrow(learn, "n long, model binary").collect()  # SHARDS rows of fixed length
        if not found:
            break
        found.sort(key=lambda r: r["model"])
        total = sum(r["n"] for r in found)
        mean = sum(np.frombuffer(r["model"], dtype=np.float32).astype(np.float64) * (r["n"] / total) for r in found)
        weights, thresholds = mean[:PLACES], mean[PLACES:]
    return weights, thresholds


def grade(df: DataFrame, weights: np.ndarray, thresholds: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade and tail (array: P(grade > j)) of every row."""
    light = weights.astype(np.float32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(1)):
                score = linear(*hashed(part.column(1).slice(a, b - a)), light)
                tail = tails(score, thresholds)
                cuts = pa.array(np.arange(len(tail) + 1, dtype=np.int32) * tail.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(score), pa.array(tail.sum(axis=1)), pa.ListArray.from_arrays(cuts, pa.array(tail.ravel()))], ["doc_id", "score", "expected_grade", "tail"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, expected_grade double, tail array<double>")


def table_grade() -> Column:
    """Grades of the labels table: 0 poor, 1 sound but toxic, 2 sound."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def graded(docs: DataFrame, labels: DataFrame, grades: int = 3, grade_column: Column | None = None, wanted: int = 1, least: float = 0.5, **options) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (of at least ``wanted``) and kept of every row."""
    model = fit(labelled_sample(docs, labels, table_grade() if grade_column is None else grade_column, **options), grades)
    found = grade(docs, *model).withColumn("tail_probability", F.get("tail", F.lit(wanted - 1)))
    return found.select("doc_id", "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, grades: int = 3, grade_column: Column | None = None, wanted: int = 1, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that are likely to have the wanted grade; no join, no shuffle."""
    weights, thresholds = fit(labelled_sample(docs, labels, table_grade() if grade_column is None else grade_column, **options), grades)
    light, columns = weights.astype(np.float32), docs.columns
    text = columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(text)):
                some = part.slice(a, b - a)
                likely = tails(linear(*hashed(some.column(text)), light), thresholds)[:, wanted - 1] >= least
                yield some.filter(pa.array(likely))

    return docs.mapInArrow(run, docs.schema)

"""Document quality by ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features with one shared weight vector w; ordered thresholds t_1 < ... < t_K cut the latent score:
P(grade >= j) = 1 / (1 + exp(t_j - w.x)). Their sum over j is the expected grade, the last one the tail probability that
selection goes by. Weights are sparse (an L1 term), so words that tell nothing add nothing, even to a very long text.

The fit takes at most ``MAX_ROWS`` rated rows, those with the smallest hashes of their ids; features of these rows go to the
driver. The weights are one array of ``2**DIM_BITS`` numbers, which is all that is broadcast. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000
DIM_BITS = 18
CACHE_WORDS = 500_000


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << DIM_BITS) - 1)


def share(name: str, part: int, whole: int) -> int:
    """A share as a feature: its power of two, as far as 1/64."""
    return place(f"{name}:{min(6, int(-math.log2(part / whole))) if part else 'none'}")


class Features:
    """Hashed features of texts: which words occur, how words end, and how large the shares of capitals, of words that
    repeat the one before, and of distinct words are."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, str, bool]] = {}

    def word(self, w: str) -> tuple[int, str, bool]:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        core = w.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        value = self.known[w] = (place("w=" + core.lower()) if core else -1, w[len(core):][:3], len(core) > 1 and core.isupper())
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.array([place("empty")], np.int64)
        found: list[int] = []
        ends: Counter[str] = Counter()
        capitals = 0
        counts = Counter(words)
        known = self.known
        for w, c in counts.items():
            at, end, upper = known.get(w) or self.word(w)
            if at >= 0:
                found.append(at)
            if end:
                ends[end] += c
            if upper:
                capitals += c
        again = sum(map(str.__eq__, words, words[1:]))
        found += [share("end=" + e, c, n) for e, c in ends.items()]
        found += [share("capitals", capitals, n), share("again", again, n), share("distinct", len(counts), n), place(f"size:{n.bit_length()}")]
        return np.unique(np.array(found, np.int64))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 1e-3, least: int = 3, steps: int = 300, rate: float = 0.3) -> Model:
    """Cumulative-link fit by proximal steps with per-weight rates. Features in fewer than ``least`` rows get no weight.
    Without rows, or with one grade only, all weights are 0 and the thresholds follow from the counts."""
    dim = 1 << DIM_BITS
    count = np.array([np.sum(grades >= j) for j in range(1, n_grades)], float)
    prior = (count + 0.5) / (len(grades) + 1.0)
    t = np.maximum.accumulate(-np.log(prior / (1 - prior)) + 1e-3 * np.arange(n_grades - 1))
    w = np.zeros(dim)
    if not len(rows):
        return Model(w, t)
    flat, of_row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    often = np.bincount(flat, minlength=dim) >= least
    used, flat = np.unique(flat[often[flat]], return_inverse=True)
    of_row = of_row[often[np.concatenate(rows)]]
    v, speed, n = np.zeros(len(used)), np.full(len(used), 1e-8), len(rows)
    t_speed = np.full(len(t), 1e-8)
    for _ in range(steps):
        z = np.bincount(of_row, weights=v[flat], minlength=n)
        up = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -30, 30)))  # P(grade >= j), j = 1..
        full = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
        i = np.arange(n)
        high, low = full[i, grades], full[i, grades + 1]
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        g = np.bincount(flat, weights=(-(slope_high - slope_low) / p / n)[of_row], minlength=len(used))
        g_t = np.array([np.sum((slope_high / p)[grades == j]) - np.sum((slope_low / p)[grades == j - 1]) for j in range(1, n_grades)]) / n
        speed += g * g
        t_speed += g_t * g_t
        step = rate / np.sqrt(speed)
        v = v - step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        t = np.maximum.accumulate(t - rate / np.sqrt(t_speed) * g_t)
    w[used] = v
    return Model(w, t)


def train(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS) -> Model:
    """Fits on documents with a rating: ``grade`` (0 to n_grades - 1) is computed from the columns of ``ratings``.

    Ratings with a null id or grade, or one outside the range, are left out; an id rated twice gets the smaller grade. At
    most ``max_rows`` ratings are taken, by the hash of the id. Documents that share an id are each a row.
    """
    rated = ratings.select(F.col(f"`{id_col}`").alias("r_id"), grade.cast("int").alias("grade")).where(F.col("r_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    rated = rated.groupBy("r_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("r_id"), "r_id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(x.as_py()).astype(np.int32) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "grade", "f"])

    # The ratings are at most max_rows pairs of numbers.
    sample = texts.join(F.broadcast(rated), F.col("id") == F.col("r_id")).select("id", "grade", "text").mapInArrow(run, "id long, grade int, f array<int>").toArrow()
    order = np.argsort(sample["id"].to_numpy(), kind="stable")
    rows = sample["f"].combine_chunks() if sample.num_rows else []
    return fit_ordinal([rows[int(i)].values.to_numpy().astype(np.int64) for i in order], sample["grade"].to_numpy()[order].astype(np.int64), n_grades)


def rate_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail (the probability of the highest grade). Null and blank texts have one feature
    of their own. Columns of these names are replaced; all others pass."""
    new = ("expected_grade", "tail")
    fields = [f for f in docs.schema.fields if f.name not in new or f.name == text_col]
    kept = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    schema = kept.select("*", F.lit(0.0).alias(new[0]), F.lit(0.0).alias(new[1])).schema
    names = [*kept.columns, *new]
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float64), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        features = Features()
        for batch in batches:
            z = np.array([weights[features.of(x.as_py())].sum() for x in batch.column(at)])
            up = 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up.sum(axis=1)), pa.array(up[:, -1])], names=names)

    return kept.mapInArrow(run, schema)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor and toxic, 1: one of the two, 2: neither."""
    return F.col(quality) - F.col(toxic) + 1

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: single words, neighbours (i, i + 1), skip-grams
(i, i + 2) and stems (the first STEMS letters of longer words), hashed to 2 ** BITS.
Words are lower-cased and stripped of punctuation at both ends.
Training keeps z and n per coordinate, so each has a rate of its own, and the L1
term leaves few weights other than 0: only those are broadcast, a table that is
bounded by the sample (SAMPLE labelled rows, a parameter) and not by the corpus.
Scoring is one pass over whole texts without a shuffle.

Features in fewer than LEAST sampled texts are not trained. Stems are an addition to the
n-grams and skip-grams: they catch words of a family that training hasn't seen.

Null and empty texts get the score of the intercept alone. Without any labelled
row nothing is known to be toxic: every score is 0. Repeated rows stay and score
alike; a very long text is scored whole, its features are a set. Where hashes of the
sample's doc_ids tie, the lesser doc_id comes first. Other columns than doc_id and text
are not read by `score`; `keep_clean` returns all columns, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, HashTable, fold, id_and_text, labelled_sample, map_arrow, map_batches

BITS, STEMS = 20, (4, 6)
SAMPLE = 10000
MODULUS, HELD = 4, 2
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 10.0, 0.5, 8
#: Features in fewer sampled texts than this are not trained.
LEAST = 3
SLICE = 512  # rows whose texts are Python strings at once

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¿¡–—"
_MASK = np.uint64((1 << BITS) - 1)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _hashes(word: str) -> tuple[int, ...]:
    """Of the bare word and of its stems; 0 where it is no longer than a stem."""
    bare = word.strip(_EDGE).lower()
    h = xxhash.xxh3_64_intdigest
    return h(bare), *(h(bare[:k], k) if len(bare) > k else 0 for k in STEMS)


def _folded(h: np.ndarray) -> np.ndarray:
    h = h * _MIX[3]
    return (h ^ (h >> np.uint64(29))) & _MASK


class Features:
    def __init__(self):
        self.table = HashTable(_hashes, 1 + len(STEMS))

    def all(self, text: str) -> np.ndarray:
        """Hashed features with repetitions; 0 is kept for the intercept."""
        found = WORD.findall(text)
        if not found:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            one, *stems = self.table.hashes(found)
            two = one[:-1] * _MIX[0] + one[1:] * _MIX[1]
            skip = one[:-2] * _MIX[2] + one[2:] * _MIX[0] + np.uint64(1)
            out = _folded(np.concatenate([one, *(s[s > 0] for s in stems), two, skip]))
        return np.maximum(out, np.uint64(1)).astype(np.int64)

    def set(self, text: str) -> np.ndarray:
        return np.unique(self.all(text))


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that aren't 0, and the intercept, by FTRL-proximal."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -math.inf
    df = np.zeros(1 << BITS, np.int32)
    for x, _ in rows:
        df[x] += 1
    rows = [(x[df[x] >= LEAST], y) for x, y in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0

    def weights(zx, nx):
        return np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(nx)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            w0 = -z0 / ((BETA + math.sqrt(n0)) / ALPHA + L2)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w0 + w.sum())))) - y
            g2 = g * g
            z[x] = zx + g - (np.sqrt(nx + g2) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g2
            z0 += g - (math.sqrt(n0 + g2) - math.sqrt(n0)) / ALPHA * w0
            n0 += g2
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(z[at], n[at]).astype(np.float32), -z0 / ((BETA + math.sqrt(n0)) / ALPHA + L2)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """Weights trained in one task from at most `most` labelled rows' feature sets; only they come to the driver."""
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD, most)

    def make():
        features = Features()
        return lambda rows: {"x": [features.set(t).astype("<i4").tobytes() for t in rows.column("text").to_pylist()], "y": rows.column("y")}

    def trained(batches):
        rows = [r for b in batches for r in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        at, values, intercept = train([(np.frombuffer(x, "<i4"), y) for x, y in sorted(rows)])
        yield pa.RecordBatch.from_pydict({"at": [at.astype("<i8").tobytes()], "values": [values.tobytes()], "intercept": [intercept]})

    sets = map_batches(sample, make, "x binary, y int").repartition(1)  # at most `most` rows
    row = map_arrow(sets, trained, "at binary, values binary, intercept double").first()
    return train([]) if row is None else (np.frombuffer(row["at"], "<i8"), np.frombuffer(row["values"], np.float32), row["intercept"])


def _scorer(model):
    """Returns make(): texts -> scores, over a broadcast of the weights."""

    def make():
        at, values, intercept = model.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = values
        features = Features()

        def score(text: str) -> float:
            x = features.all(text)
            x = np.unique(x[dense[x] != 0])
            total = intercept + float(dense[x].sum(dtype=np.float64))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, total)))) if intercept != -math.inf else 0.0

        return score

    return make


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row; model from fit()."""
    make_score = _scorer(docs.sparkSession.sparkContext.broadcast(model))

    def make():
        one = make_score()
        return lambda rows: {"doc_id": rows.column("doc_id"), "score": [one(t) for t in rows.column("text").to_pylist()]}

    return map_batches(id_and_text(docs), make, "doc_id long, score double")


def keep_clean(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    make_score = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    place = docs.columns.index("text")

    def run(batches):
        one = make_score()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                keep = [one(t or "") < threshold for t in rows.column(place).to_pylist()]
                yield rows.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes no names with dots
    return map_arrow(plain, run, plain.schema).toDF(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    held = fold(MODULUS) == HELD
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

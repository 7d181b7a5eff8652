"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so a text costs its distinct features times RANK, not their pairs.

Features: words hashed to 2 ** BITS with weights count / sqrt(sum of counts squared);
structure statistics of the whole text (shares of symbols, capitals, digits, echoed and
distinct words, repeated lines, ...) and metadata (the lengths), each in BINS one-hot bins.
Labels, lang, source and doc_id are no inputs. Trained in one task by AdaGrad on at most
SAMPLE labelled documents (a parameter); the broadcast model has a fixed size (2 ** BITS rows).

Null and empty texts have only bins and score like any other. Very long texts are read whole,
their words counted by slot. Without labelled rows every score is 0.5. Repeated rows stay and
score alike, so ties do too; of rows with one doc_id one text trains. Further columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, fold, id_and_text, labelled_sample, map_batches

BITS, RANK, BINS = 16, 8, 12
SAMPLE = 6000
MODULUS, HELD = 3, 1
EPOCHS, RATE, DECAY = 6, 0.05, 1e-5
STATS = ("symbols", "capitals", "digits", "marks", "echo", "distinct", "top", "mean_length", "dup_lines", "line_words", "words", "chars", "exclaim", "pipes")
SLOTS = (1 << BITS) + len(STATS) * BINS


def statistics(text: str, words: list[str], counts: np.ndarray) -> tuple[float, ...]:
    """STATS, each scaled to about 0..1; all 0 for a text without words, but the lengths."""
    n = len(words)
    if not n:
        return (0.0,) * 11 + (min(1.0, math.log2(1 + len(text)) / 20), 0.0, 0.0)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_ = np.bincount(codes[codes < 128], minlength=128)
    letters = max(1, int(ascii_[65:91].sum() + ascii_[97:123].sum()))
    symbols = int(ascii_[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        symbols / n,
        int(ascii_[65:91].sum()) / letters,
        int(ascii_[48:58].sum()) / len(codes),
        int(ascii_[[44, 46, 58, 59, 63]].sum()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(counts) / n,
        int(counts.max()) / n,
        len(codes) / n / 20,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log2(n / max(1, len(lines))) / 10,
        min(1.0, math.log2(n) / 16),
        min(1.0, math.log2(1 + len(codes)) / 20),
        int(ascii_[33]) / n,
        int(ascii_[124]) / n,
    )


class Features:
    def __init__(self):
        self.hash = Memo(lambda w: xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots, ascending, and their values."""
        words = WORD.findall(text)
        at, counts = np.unique(np.fromiter(map(self.hash.__getitem__, words), np.int64, len(words)), return_counts=True)
        stats = statistics(text, words, counts)
        bins = (1 << BITS) + np.arange(len(STATS)) * BINS + [min(BINS - 1, int(BINS * math.sqrt(max(0.0, s)))) for s in stats]
        values = counts / math.sqrt(float((counts * counts).sum())) if len(words) else counts.astype(float)
        return np.concatenate([at, bins]), np.concatenate([values, np.full(len(STATS), 1.0)])


class Machine:
    def __init__(self, seed: int = 11):
        self.w0 = 0.0
        self.w = np.zeros(SLOTS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SLOTS, RANK)).astype(np.float32)

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.margin(at, x)))))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Machine:
        """AdaGrad over the log loss; both classes weigh the same in all."""
        ones = sum(y for *_, y in rows)
        if not 0 < ones < len(rows):
            self.w0 = 0.0 if not rows else math.copysign(3.0, ones - 0.5)
            self.v[:] = 0
            return self
        weight = (0.5 * len(rows) / (len(rows) - ones), 0.5 * len(rows) / ones)
        gw, gv, g0 = np.full(SLOTS, 1e-2, np.float32), np.full((SLOTS, RANK), 1e-2, np.float32), 1e-2
        order = np.random.default_rng(3)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, x, y = rows[i]
                v = self.v[at]
                total = (v * x[:, None]).sum(0)
                g = (self.score(at, x) - y) * weight[y]
                dw = (g * x).astype(np.float32) + DECAY * self.w[at]
                dv = (g * (x[:, None] * total - v * (x * x)[:, None])).astype(np.float32) + DECAY * v
                gw[at] += dw * dw
                gv[at] += dv * dv
                g0 += g * g
                self.w[at] -= RATE * dw / np.sqrt(gw[at])
                self.v[at] -= RATE * dv / np.sqrt(gv[at])
                self.w0 -= RATE * g / math.sqrt(g0)
        return self


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, most)

    def make():
        features = Features()

        def batch(rows):
            found = [features(t) for t in rows.column("text").to_pylist()]
            return {"at": [a.astype("<i4").tobytes() for a, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found], "y": rows.column("y")}

        return batch

    def trained(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("at", "x", "y")))))
        own = Machine().train([(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y) for a, x, y in rows])
        yield pa.RecordBatch.from_pydict({"w0": [own.w0], "w": [own.w.tobytes()], "v": [own.v.tobytes()]})

    # at most `most` rows meet in one task; only the model, of a fixed size, comes to the driver
    row = map_batches(sample, make, "at binary, x binary, y int").repartition(1).mapInArrow(trained, "w0 double, w binary, v binary").first()
    own = Machine()
    if row is None:
        return own.train([])
    own.w0, own.w, own.v = row["w0"], np.frombuffer(row["w"], np.float32), np.frombuffer(row["v"], np.float32).reshape(SLOTS, RANK)
    return own


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def make():
        own, features = Machine(), Features()
        own.w0, own.w, own.v = model.value
        return lambda rows: {"doc_id": rows.column("doc_id"), "score": [own.score(*features(t)) for t in rows.column("text").to_pylist()]}

    return map_batches(id_and_text(docs), make, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    held = fold(MODULUS) == HELD
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

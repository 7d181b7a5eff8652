"""Document fingerprints from prefix polynomial hashes.

`Prefixes` holds, for two bases modulo 2 ** 31 - 1, the hashes of all prefixes of a
text's code points. A span's hash is a difference times an inverse power, so any two
spans compare in constant time, and the longest common extension of two places is
found by binary search.

A fingerprint is a string of four parts: the length and the hash of the whole text;
the hashes of prefixes, and of suffixes, at lengths 1, 2, 4, 5, 8, 11, 16, ... that fit; and
the SKETCH least hashes of the text's five-word spans. Two fingerprints' likeness is 1
for equal texts; else it is the larger of the share that common ends cover, found by
binary search in the prefix and the suffix hashes, and of the spans' estimated overlap,
2 * common / (spans of both).

`query` compares each text with its edited form and with the next document. Ranges of
doc_id of about equal counts go to a task each; the first row of a range is also sent
to the range before it, so one shuffle serves and no range sees a neighbour's rest.

Null texts are empty; empty texts have no hashes and are like each other only. Null ids
come last; rows of one doc_id follow each other by text. Repeated rows stay, each the
other's next. Other columns than doc_id and text are not read; an empty table gives an
empty result. The next of the last row is the first; that of a single row is itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 747_796_405)
SPAN, SKETCH = 5, 48
GRID = sorted({int(2 ** (k / 2)) for k in range(68)})
RANGES = 4  # for each shuffle partition
_31, _32 = np.uint64(31), np.uint64(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x below 2 ** 62."""
    x = (x & P) + (x >> _31)
    x = (x & P) + (x >> _31)
    return np.where(x == P, np.uint64(0), x)


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def grow(self, n: int) -> None:
        if n < len(self.up[0]):
            return
        for k, base in enumerate(BASES):
            for table, b in ((self.up, base % int(P)), (self.down, pow(base, -1, int(P)))):
                own = table[k]
                while len(own) <= n:
                    own = np.concatenate([own, _fold(own * np.uint64(pow(b, len(own), int(P))))])
                table[k] = own


class Prefixes:
    """Hashes of every prefix of a text; sums of code[i] * base ** i."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        self.n, self.powers = len(codes), powers
        powers.grow(self.n + 1)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up in powers.up:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(values * up[: self.n]), out=sums[1:])
            self.sums.append(_fold(sums))

    def spans(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Hashes of the spans [start, end), alike wherever they stand; one array a base."""
        return [_fold(_fold(s[end] + P - s[start]) * down[start]) for s, down in zip(self.sums, self.powers.down)]

    def same(self, i: int, other: Prefixes, k: int, length: int) -> bool:
        a, b = (x.spans(np.array([at]), np.array([at + length])) for x, at in ((self, i), (other, k)))
        return all(x[0] == y[0] for x, y in zip(a, b))

    def common(self, i: int, other: Prefixes, k: int) -> int:
        """The longest common extension of place i here and place k there."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, k, middle) else (low, middle - 1)
        return low


def _short(pair: list[np.ndarray]) -> np.ndarray:
    """32 bits of both hashes."""
    with np.errstate(over="ignore"):
        return (((pair[0] << _31) ^ pair[1]) * _MIX) >> _32


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Fingerprint:
    __slots__ = ("n", "whole", "heads", "tails", "sketch")

    def __init__(self, text: str, powers: Powers):
        codes = codes_of(text)
        own = Prefixes(codes, powers)
        self.n = own.n
        lengths = np.array([g for g in GRID if g <= self.n], np.int64)
        zero = np.zeros(len(lengths), np.int64)
        self.whole = tuple(int(s[-1]) for s in own.sums)
        self.heads = _short(own.spans(zero, lengths))
        self.tails = _short(own.spans(self.n - lengths, zero + self.n))
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        if len(start) >= SPAN:
            start, end = start[: len(start) - SPAN + 1], end[SPAN - 1 :]
        elif len(start):
            start, end = start[:1], end[-1:]
        self.sketch = np.unique(_short(own.spans(start, end)))[:SKETCH]

    def __str__(self) -> str:
        write = lambda x: x.astype(">u4").tobytes().hex()
        return f"{self.n:x}.{self.whole[0]:08x}{self.whole[1]:08x}.{write(self.heads)}.{write(self.tails)}.{write(self.sketch)}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, *rest = text.split(".")
        out = cls.__new__(cls)
        out.n, out.whole = int(n, 16), (int(whole[:8], 16), int(whole[8:], 16))
        out.heads, out.tails, out.sketch = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint64) for x in rest)
        return out


def _agreed(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest grid span that agrees: agreement never returns after it ended."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return GRID[low - 1] if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    ends = min(min(a.n, b.n), _agreed(a.heads, b.heads) + _agreed(a.tails, b.tails)) / max(a.n, b.n)
    both = np.union1d(a.sketch, b.sketch)[:SKETCH]
    common = np.intersect1d(a.sketch, b.sketch, assume_unique=True)
    jaccard = float(np.isin(both, common, assume_unique=True).mean()) if len(both) else 0.0
    return min(max(ends, 2 * jaccard / (1 + jaccard)), 1 - 1 / (1 + max(a.n, b.n)))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranged(docs: DataFrame, ranges: int) -> DataFrame | None:
    """doc_id, place (orders rows), text, range, halo: rows of a range, and as halo the first row of the next one."""
    last = (1 << 63) - 1
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("place")
    ids = docs.select(place)
    cuts = ids.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"]
    if cuts is None:
        return None
    cuts = sorted({float(c) for c in cuts})
    splits = [-float("inf"), *cuts, float("inf")]
    # Bucketizer finds a range by binary search; one range needs no search
    bucketizer = Bucketizer(splits=splits, inputCol="__place", outputCol="__range") if len(splits) > 2 else None

    def ranged(df):
        df = df.withColumn("__place", F.col("place").cast("double"))
        df = bucketizer.transform(df) if bucketizer else df.withColumn("__range", F.lit(0.0))
        return df.withColumn("range", F.col("__range").cast("int")).drop("__place", "__range")

    heads = sorted(tuple(r) for r in ranged(ids).groupBy("range").agg(F.min("place")).collect())  # a row for each range
    head, before = [None] * (len(splits) - 1), [None] * (len(splits) - 1)
    for k, (r, first) in enumerate(heads):
        head[r], before[r] = first, heads[k - 1][0]
    at = F.col("range") + 1
    column = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))
    is_head = F.col("place") == F.element_at(column(head, "long"), at)
    own = F.struct(F.col("range"), F.lit(0).alias("halo"))
    halo = F.struct(F.element_at(column(before, "int"), at).alias("range"), F.lit(1).alias("halo"))
    rows = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), place, F.coalesce(F.col("text"), F.lit("")).alias("text")))
    goes = F.explode(F.when(is_head, F.array(own, halo)).otherwise(F.array(own))).alias("g")
    return rows.select("doc_id", "place", "text", goes).select("doc_id", "place", "text", "g.range", "g.halo")


def query(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """SCHEMA for every row of docs."""
    spark = docs.sparkSession
    rows = _ranged(docs, ranges or max(2, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if rows is None:
        return spark.createDataFrame([], SCHEMA)

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))))

    def run(batches):
        powers, out, held = Powers(), [], None

        def settle(row, following):
            doc_id, text, own, _ = row
            other = edited(text, following[1])
            changed = own if other == text else Fingerprint(other, powers)
            sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, own.n, sha, str(own), str(changed), likeness(own, changed), likeness(own, following[2])))

        for batch in batches:
            for doc_id, text, range_, halo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "halo"))):
                if held and held[3] != range_:
                    held = None
                if halo and not held:
                    continue  # the range has had its halo row; equal ids bring more
                row = (doc_id, text, Fingerprint(text, powers), range_)
                if held:
                    settle(held, row)
                held = None if halo else row
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return rows.repartition("range").sortWithinPartitions("range", "halo", "place", F.col("doc_id").isNull(), "text").mapInArrow(run, SCHEMA)

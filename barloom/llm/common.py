"""What several corpus operators share: words, Arrow mapping and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, a null text as the empty one; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: What a Python worker holds between the calls of one task.
held: dict = {}


def give_back() -> None:
    """Return the memory that this process has freed, of Arrow's pool and of malloc, to the system."""
    held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a generator; its worker gives memory back after each task.

    Workers outlive their tasks, and idle ones count in the executor's memory while other
    stages run in the JVM.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, barrier_rows: int = 512) -> DataFrame:
    """Apply make()'s function to slices of Arrow batches.

    make() runs once a task, so that memos live as long as the task; slices of
    `barrier_rows` rows bound the Python strings alive at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, barrier_rows):
                columns = function(batch.slice(at, barrier_rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return map_arrow(df, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that is unset and all runs in one process, a folder below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_barloom_cuts"


class Cuts:
    """Writes tables to the shared folder and reads them back, to end a lineage.

    Results may read them for as long as the driver runs; its end removes what is left.
    A caller that has written an operator's result can remove its tables with `end`.
    """

    open: list[Cuts] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}", []
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        Cuts.open.append(self)
        atexit.register(self._remove, self.root)

    def cut(self, df: DataFrame, thin: bool = False) -> DataFrame:
        """thin: rows of ids only, written by two tasks a core at most, whatever the shuffle's partitions."""
        path = f"{self.root}/{len(self.made)}"
        (df.coalesce(2 * self.spark.sparkContext.defaultParallelism) if thin else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for table in tables:
            self._remove(next(p for t, p in self.made if t is table))

    @classmethod
    def end(cls, since: int) -> None:
        """Remove the tables of all Cuts made after the first `since`."""
        while len(cls.open) > since:
            one = cls.open.pop()
            one._remove(one.root)
            atexit.unregister(one._remove)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Py4JError, OSError):  # at the end the JVM may be gone
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.conf).delete(path, True)


def whole_rows(docs: DataFrame) -> DataFrame:
    """`row`, a struct of all columns of docs, and h1 and h2, 128 bits of the whole row.

    The struct keeps docs' names away from those that operators use. Rows with equal h1 and h2
    are equal in every column, so it doesn't matter which one of them stays or is repeated,
    nor how files are split or in which order they are read.
    """
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    # hashes pass nulls over and know no maps
    parts = [x for c, kind in zip(own, kinds) for x in (c.isNull(), F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c)]
    return docs.select(F.struct(*own).alias("row"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


class Memo(dict):
    """Values of a function by word, at most `most` at a time."""

    def __init__(self, function: Callable, most: int = 150_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


class HashTable(dict):
    """Hashes (unsigned 64 bits, so many) of words, computed once while a word is held; about `most` words at a time."""

    def __init__(self, function: Callable[[str], tuple[int, ...]], width: int, most: int = 200_000):
        super().__init__()
        self.function, self.most, self.new = function, most, []
        self.columns = np.zeros((width, most), np.uint64)

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(self.function(word))
        return place

    def hashes(self, words: list[str]) -> np.ndarray:
        """One row for each hash, one column for each word."""
        if len(self) + len(words) > self.columns.shape[1]:
            self.clear()
            if len(words) > self.columns.shape[1]:
                self.columns = np.zeros((len(self.columns), len(words)), np.uint64)
        held = len(self)
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.columns[:, held : len(self)] = np.array(self.new, np.uint64).T
            self.new = []
        return self.columns[:, places]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """text and y of at most `most` labelled documents outside the held-out fold.

    Labels are chosen before any text is read, in the order of a hash of doc_id (of doc_id
    itself where hashes tie), so reruns agree; `most` bounds what is broadcast here. Of rows
    with one doc_id the text with the least hash counts, so `most` bounds what training gets.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    found = id_and_text(docs).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("text", "y")


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus

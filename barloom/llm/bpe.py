"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

Texts of more than LEAF characters are cut into leaves of LEAF characters, which are
encoded and then joined pairwise, as a tree. The leaves of a text of more than LONG
characters are rows of their own, so that many tasks encode them in parallel; those of
a shorter one are encoded in the task that has read it.
Round a join the text is encoded again in a window that grows until it agrees with what
both sides have. A blank or line break after a visible character always begins a
pre-token, whatever stands on either side: both sides agree there, so most windows reach
from the last such place on the left to the first one on the right, a word or two. Where
there is none, as in long unsplit text, all of that side is the window's limit, and in it

* between pre-tokens: the pattern looks at most one character past a match, so
  every split of a left side is final but the one that touches its end, and a
  right side's splits hold from the first one that the window shares;
* inside one unsplit pre-token that both sides share, on its pieces: a sequence
  of pieces is the encoding exactly if each adjacent pair is, so a window that
  returns at least the outermost piece of both sides can be put in between.

Strings of added tokens are cut out first, as the library does. Null texts count
as empty: no ids, an empty decoded text. Repeated rows stay. Columns other than
doc_id and text are not read, so none can clash. An empty table gives an empty result.
A vocabulary file with another way of splitting or a normalizer is used on whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import held, id_and_text, map_arrow, map_batches

LEAF, LONG = 1 << 12, 1 << 16
FIRST_WINDOW = 64
#: Where a pre-token begins in any surroundings.
_BEGINS = re.compile(r"(?<=[!-~\w])[ \n]")
#: Below this code point no library's Unicode tables differ in letters, numbers or white space.
SURE = 0x530
#: The split pattern of byte-level BPE, and the letters it writes for bytes (fixed values).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's tokenizer, and encodings that can be joined."""

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        file = json.loads(source)
        split = file["pre_tokenizer"] or {}
        flags = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"])
        #: Whether leaves can be joined: byte-level splits, nothing rewritten.
        self.joins = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and bool(split.get("use_regex")) and file["normalizer"] is None and not flags and file["model"]["type"] == "BPE"
        self.ranked, self.sizes = None, None
        if self.joins:
            vocab = file["model"]["vocab"]
            self.sizes = np.zeros(1 + max(vocab.values()), np.int64)  # bytes of each piece
            self.sizes[list(vocab.values())] = list(map(len, vocab))
            self.ranked = self._ranked(file["model"])

    def _ranked(self, model: dict):
        """The same vocabulary as ranks for the faster library; None if merges aren't in the order of ids."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [model["vocab"].get(a + b) for a, b in merges]
        if None in ids or ids != sorted(ids) or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {bytes(map(BYTE_OF.__getitem__, piece)): i for piece, i in model["vocab"].items() if piece not in self.added}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.added)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each at once: by ranks where both libraries' character classes are sure to agree."""
        out: list = [None] * len(texts)
        for i, text in enumerate(texts):
            if self.ranked and (text.isascii() or np.frombuffer(text.encode("utf-32-le"), "<u4").max() < SURE):
                out[i] = self.ranked.encode_to_numpy(text, allowed_special="all")
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4")
        return out

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        """Ids of whole texts; long ones as trees of leaves."""
        plans, flat = [], []
        for text in texts:
            plan = list(_leaves(text, self, leaf)) if self.joins and len(text) > leaf else [(0, 0, text)]
            plans.append([(part, len(flat) + i) for i, (part, *_) in enumerate(plan)])
            flat += [own for *_, own in plan]
        ids = self.batch(flat)
        return [ids[plan[0][1]] if len(plan) == 1 else self.whole([(part, flat[i], ids[i]) for part, i in plan]) for plan in plans]

    def whole(self, leaves: list[tuple[int, str, np.ndarray]]) -> np.ndarray:
        """Ids of a text from (part, text, ids) of its leaves, in order."""
        parts: dict[int, list[Node]] = {}
        for part, text, ids in leaves:
            parts.setdefault(part, []).append(Node(self, text, ids))
        return np.concatenate([self.tree(nodes).ids for nodes in parts.values()])

    def parts(self, text: str) -> list[str]:
        """Text between added tokens at even places, added tokens at odd ones."""
        return self.cut.split(text) if self.cut else [text]

    def splits(self, text: str) -> list[int]:
        """The ends of the pre-tokens."""
        return [end for _, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def leaf(self, text: str) -> Node:
        return Node(self, text, self.batch([text])[0])

    def pieces(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one pre-token, from those of its two halves."""
        size = 4
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            inside = left[len(left) - a :] + right[:b]
            window = [t.id for t in self.tokenizer.model.tokenize("".join(map(self.tokenizer.id_to_token, inside)))]
            left_agrees = a == len(left) or window[0] == left[-a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            if left_agrees and right_agrees and len(window) > 1 or a == len(left) and b == len(right):
                return left[: len(left) - a] + window + right[b:]
            size *= 2

    def join(self, a: Node, b: Node) -> Node:
        if not a.text or not b.text:
            return a if a.text else b
        start, stop = self._last(a.text), self._first(b.text)
        before = len(a.ids) - self._pieces_of(a.ids[::-1], a.text[start:])
        after = self._pieces_of(b.ids, b.text[:stop])
        if len(a.text) - start + stop <= 4 * FIRST_WINDOW:
            middle = self.batch([a.text[start:] + b.text[:stop]])[0]
        else:
            middle = self.merge(Node(self, a.text[start:], a.ids[before:]), Node(self, b.text[:stop], b.ids[:after]))
        return Node(self, a.text + b.text, np.concatenate([a.ids[:before], middle, b.ids[after:]]))

    def _last(self, text: str) -> int:
        """The last place in text where a pre-token begins for sure; 0 if there is none."""
        size = FIRST_WINDOW
        while True:
            low = max(0, len(text) - size)
            found = [m.start() for m in _BEGINS.finditer(text, low)]
            if found or not low:
                return found[-1] if found else 0
            size *= 4

    def _first(self, text: str) -> int:
        """The first such place; the end if there is none."""
        found = _BEGINS.search(text)
        return found.start() if found else len(text)

    def _pieces_of(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids make up text."""
        size = len(text.encode("utf-8", "surrogatepass"))
        return int(np.searchsorted(np.cumsum(self.sizes[ids[:size]]), size)) + 1 if size else 0

    def merge(self, a: Node, b: Node) -> np.ndarray:
        """Ids of both texts as one."""
        text, seam = a.text + b.text, len(a.text)
        kept = len(a.ends) - 1  # pre-tokens of a that are final
        start = a.ends[kept - 1] if kept else 0
        grown = FIRST_WINDOW
        while True:
            stop = min(len(text), seam + grown)
            window = self.tokenizer.pre_tokenizer.pre_tokenize_str(text[start:stop])
            ends = [start + e for _, (_, e) in window]
            final = ends if stop == len(text) else ends[:-1]
            shared = next((e for e in final if e >= seam and (e == seam or b.at(e - seam) is not None)), None)
            if shared is not None:
                break
            grown *= 4
        inside = [e for e in ends if e <= shared]
        skip = b.at(shared - seam) if shared > seam else 0
        first = a.id_ends[kept - 1] if kept else 0
        if len(inside) == 1 and shared > seam and skip == 1:  # one pre-token over the seam: a's last and b's first
            ids = self.pieces(a.ids[first:].tolist(), b.ids[: b.id_ends[0]].tolist())
        else:  # the window's own splits: alone, the last could come out otherwise
            ids = [t.id for piece, _ in window[: len(inside)] for t in self.tokenizer.model.tokenize(piece)]
        dropped = b.id_ends[skip - 1] if skip else 0
        return np.concatenate([a.ids[:first], np.array(ids, "<u4"), b.ids[dropped:]])

    def tree(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


class Node:
    """A text with its ids; `ends` and `id_ends` are the places in both where its pre-tokens end."""

    def __init__(self, encoder: Encoder, text: str, ids: np.ndarray):
        self.encoder, self.text, self.ids = encoder, text, np.asarray(ids, "<u4")

    @cached_property
    def ends(self) -> list[int]:
        return self.encoder.splits(self.text)

    @cached_property
    def id_ends(self) -> list[int]:
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        bytes_ = np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
        return (np.searchsorted(np.cumsum(self.encoder.sizes[self.ids]), bytes_[np.array(self.ends, np.int64) - 1]) + 1).tolist()

    def at(self, place: int) -> int | None:
        """How many pre-tokens end up to `place`, if one ends there."""
        i = bisect_left(self.ends, place)
        return i + 1 if i < len(self.ends) and self.ends[i] == place else None


def _loaded(source) -> Encoder:
    """The encoder of a broadcast vocabulary, made once in a Python worker until it gives memory back."""
    if id(source) not in held:
        held.clear()
        held[id(source)] = source, Encoder(source.value)
    return held[id(source)][1]


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _digests(ids: list[int], text: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _leaves(text: str, encoder: Encoder, leaf: int) -> Iterator[tuple[int, int, str]]:
    """(part, leaf number, text); added tokens and empty parts too."""
    for part, own in enumerate(encoder.parts(text)):
        for k in range(max(1, -(-len(own) // leaf))):
            yield part, k, own[k * leaf : (k + 1) * leaf]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False, leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """RESULT for every row of docs; with_ids adds `ids`, little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    with open(path or default_path(), "rb") as f:
        source = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus
    texts = id_and_text(docs)
    schema = RESULT + ", ids binary" * with_ids

    def rows_of(doc_ids, encoded, decoded):
        n, sha, text_sha = zip(*map(_digests, encoded, decoded)) if encoded else ((), (), ())
        return {"doc_id": doc_ids, "n_tokens": n, "ids_sha256": sha, "decoded_sha256": text_sha, "ids": [packed(x) for x in encoded] if with_ids else None}

    def whole():
        encoder = Encoder(source.value)

        def batch(rows):
            found = encoder.encode(rows.column("text").to_pylist(), leaf)
            return rows_of(rows.column("doc_id"), found, encoder.tokenizer.decode_batch([x.tolist() for x in found], skip_special_tokens=False))

        return batch

    def cut(batches):
        encoder = Encoder(source.value)
        for rows in batches:
            for row, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for part, k, own in _leaves(text, encoder, leaf):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "part": part, "leaf": k, "text": own}], schema=leaf_schema)

    result_schema = to_arrow_schema(_parse_datatype_string(schema))
    leaf_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("leaf", pa.int32()), ("text", pa.string())])

    def leaves():
        encoder = Encoder(source.value)
        return lambda rows: {c: rows.column(c) for c in ("row", "doc_id", "part", "leaf", "text")} | {"ids": [packed(x) for x in encoder.batch(rows.column("text").to_pylist())]}

    def joined(key, table):
        encoder = _loaded(source)
        table = table.sort_by([("part", "ascending"), ("leaf", "ascending")])
        ids = encoder.whole([(r["part"], r["text"], np.frombuffer(r["ids"], "<u4")) for r in table.select(["part", "text", "ids"]).to_pylist()])
        columns = rows_of([table.column("doc_id")[0].as_py()], [ids], [encoder.decode(ids.tolist())])
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in result_schema})

    size = F.length("text")
    if not Encoder(source.value).joins:
        return map_batches(texts, whole, schema)
    short = map_batches(texts.filter(size <= long), whole, schema)
    rows = texts.filter(size > long).withColumn("row", F.monotonically_increasing_id())
    # a stated number of partitions: leaves are few bytes and much work, which adaptive execution would put in one task
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = map_arrow(rows, cut, "row long, doc_id long, part int, leaf int, text string").repartition(spread, "row", "part", "leaf")
    encoded = map_batches(cuts, leaves, "row long, doc_id long, part int, leaf int, text string, ids binary", barrier_rows=16)
    return short.unionByName(encoded.groupBy("row").applyInArrow(joined, schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (binary, as encode() gives them; null: empty)."""
    with open(path or default_path(), "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encoder = Encoder(source.value)

        def batch(rows):
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in rows.column("ids").to_pylist()]
            return {"doc_id": rows.column("doc_id"), "text": encoder.tokenizer.decode_batch(ids, skip_special_tokens=False)}

        return batch

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")

"""N-gram Jaccard join by chosen paths: all pairs of texts whose shingle sets have a Jaccard of 0.8 or more.

A text's set holds its runs of five words, hashed to 32 bits; a text of one to four
words has one element, all its words. Equal sets are one class from the start, so
that copies never meet pairwise.

1. Each set gets SKETCH min-hashes. In every run a set walks down from the root: at
   a node one or two of the hash functions are chosen, the same for all sets there,
   and the set goes on to the child named by the shared token that its function
   finds. More similar pairs share more nodes.
2. Nodes with one set end. Nodes of at most SMALL sets are compared all against all
   on sketches, inside a task. In a larger node each set is compared with the node's
   least member, and linked to it if their sketches agree; if all do, the node ends,
   since all its sets are then compared exactly in step 3. If at most SMALL do not, these
   are compared with all of the node, in blocks. Else all its sets walk on, LEVELS
   further tokens at a time, until nodes are small, or at DEEPEST tokens; what
   is still large and mixed there is compared all against all in blocks of SMALL sets,
   a task for each pair of blocks. So no set is dropped and nothing is linked unseen.
   Runs are repeated until the recall of pairs at the threshold is RECALL: `runs_for`
   finds their number from simulated pairs, counting as lost those that share no node
   at DEEPEST tokens (as if all others were large) and those whose sketches agree in
   less than AGREE, which loses 1.3e-4 at the threshold.
3. Candidates' components are gathered with their sets, once a set, and every pair
   inside is decided exactly: 9 * common >= 4 * (sizes' sum). A component beyond BLOCK
   sets or TOKENS elements is cut into blocks, and each pair of blocks is a task of its
   own. Pairs are counted and merged there and never leave the task as rows.

Results: one row per document with class_id, the least doc_id of its connected
component, and n_links, the number of other documents that it is similar to.
Null texts and texts without words have no set: they are alone. Repeated rows are
copies of each other. A very long text is one set, compared COLUMNS tokens at a time. Of
equal least doc_ids it doesn't matter which names the class. Other columns than doc_id
and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Cuts, Memo, map_arrow, map_batches, whole_rows
from .components import Forest, components

N = 5
SKETCH = 64
THRESHOLD, RECALL, TRIALS = 0.8, 0.999, 2000
#: Tokens of the first nodes, and of a further walk; chances, in 15ths, that a node there has two functions.
FIRST, LEVELS, DEEPEST = 2, 2, 8
FORKS, LATER_FORKS = 10, 6
SMALL, BLOCK, TOKENS = 512, 256, 2_000_000
#: Candidates agree in this share of their sketches; four deviations below the threshold.
AGREE = 0.6
COLUMNS = 2048  # tokens of the exact comparison at once

_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (2, SKETCH), dtype=_U) | _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _MIX[4]
    return h ^ (h >> _U(33))


class Shingler:
    def __init__(self, n: int = N):
        self.n, self.hash = n, Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str) -> np.ndarray:
        """The text's set: distinct 32-bit hashes, ascending."""
        words = WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint32)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest("\n".join(words), seed=len(words)) & 0xFFFFFFFF], np.uint32)
        h = np.fromiter(map(self.hash.__getitem__, words), _U, len(words))
        m = len(h) - self.n + 1
        with np.errstate(over="ignore"):
            total = h[:m] * _MIX[0]
            for k in range(1, self.n):
                total = _mix(total + h[k : k + m] * _MIX[k % 4]) + _U(k)
            return np.unique((_mix(total) >> _U(32)).astype(np.uint32))


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH min-hashes (uint32) of a set that isn't empty."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 4096):
            x = own[at : at + 4096].astype(_U)[:, None]
            h = ((x + _SEEDS[1]) * _SEEDS[0]) >> _U(32)
            out = np.minimum(out, h.min(axis=0).astype(np.uint32))
    return out


def walk(sketches: np.ndarray, member: np.ndarray, path: np.ndarray, levels: int, forks: int = FORKS) -> tuple[np.ndarray, np.ndarray]:
    """Members (rows of sketches) and paths, so many levels down."""
    with np.errstate(over="ignore"):
        for _ in range(levels):
            a, b = _mix(path + _MIX[0]), _mix(path + _MIX[1])
            first, second = (a % _U(SKETCH)).astype(np.int64), (b % _U(SKETCH)).astype(np.int64)
            both = (_mix(path + _MIX[2]) % _U(15) < _U(forks)) & (first != second)
            member, path, at = np.concatenate([member, member[both]]), np.concatenate([path, path[both]]), np.concatenate([first, second[both]])
            path = _mix(path * _MIX[3] + (at.astype(_U) << _U(32)) + sketches[member, at])
    return member, path


def roots(run: int, n: int) -> np.ndarray:
    """The paths of n sets at the root of a run."""
    with np.errstate(over="ignore"):
        return np.repeat(_mix(np.array([run + 1], _U) * _MIX[0]), n)


@lru_cache
def runs_for(recall: float = RECALL, jaccard: float = THRESHOLD, trials: int = TRIALS) -> int:
    """The least number of runs by which simulated pairs of that similarity are candidates in this share at least."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 32, (trials, SKETCH), dtype=np.uint32)
    b = np.where(rng.random((trials, SKETCH)) < jaccard, a, a ^ np.uint32(1))
    agree = (a == b).mean(axis=1) >= AGREE
    found, sketches = np.zeros(trials, bool), np.concatenate([a, b])
    for run in range(64):
        member, path = walk(sketches, np.arange(2 * trials), roots(run, 2 * trials), FIRST)
        member, path = walk(sketches, member, path, DEEPEST - FIRST, LATER_FORKS)
        node = path ^ ((member % trials).astype(_U) * _MIX[1])  # a node of one pair
        found[member[np.isin(node, node[member < trials]) & (member >= trials)] - trials] = True
        if (found & agree).mean() >= recall:
            return run + 1
    raise ValueError(f"No number of runs finds {recall} of the pairs")


def _sets(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """doc_id, `keys`, key (128 bits of the set; null if empty), n, sketch, tokens."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def make():
        shingles = Shingler()

        def batch(rows):
            sets = [shingles(t) for t in rows.column("text").to_pylist()]
            tokens = [s.astype("<u4").tobytes() for s in sets]
            return {c: rows.column(c) for c in ("doc_id", *keys)} | {
                "key": [xxhash.xxh3_128_digest(t) if t else None for t in tokens],
                "n": list(map(len, sets)),
                "sketch": [sketch(s).astype("<u4").tobytes() if len(s) else None for s in sets],
                "tokens": tokens,
            }

        return batch

    return map_batches(own, make, "doc_id long, " + "".join(f"{k} long, " for k in keys) + "key binary, n int, sketch binary, tokens binary", barrier_rows=256)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _walked(rows: DataFrame) -> DataFrame:
    """(path, key) of the walk from the root, or LEVELS on from `path`; rows: key, sketch."""
    rooted, runs = "path" not in rows.columns, runs_for()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sketches, n = _matrix(b.column("sketch")), b.num_rows
            if rooted:
                member, path = walk(sketches, np.tile(np.arange(n), runs), np.concatenate([roots(r, n) for r in range(runs)]), FIRST)
            else:
                member, path = walk(sketches, np.arange(n), b.column("path").to_numpy().view(_U), LEVELS, LATER_FORKS)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column("key").take(pa.array(member))], names=["path", "key"])

    return map_arrow(rows, run, "path long, key binary")


def _compared(rows: DataFrame) -> DataFrame:
    """(path, key, v, agrees): whether the sketch agrees with that of the node's least member v; rows: path, key, sketch, v, least."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                agrees = (_matrix(b.column("sketch")) == _matrix(b.column("least"))).mean(axis=1) >= AGREE
                yield pa.RecordBatch.from_arrays([b.column("path"), b.column("key"), b.column("v"), pa.array(agrees)], names=["path", "key", "v", "agrees"])

    return map_arrow(rows, run, "path long, key binary, v binary, agrees boolean")


def _groups(batches, column: str):
    """Runs of equal values of a sorted column, as tables; they may span batches."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        values = b.column(column).to_pylist()
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and values[end] == values[at]:
                end += 1
            if held and held[0].column(column)[0].as_py() != values[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """Edges to the least member of what agrees, inside each small node; rows: path, key, sketch."""

    def run(batches):
        edge = pa.schema([("u", pa.binary()), ("v", pa.binary())])
        us, vs = [], []
        for group in _groups(batches, "path"):
            keys = group.column("key").to_pylist()
            low = _matrix(group.column("sketch")).astype(np.uint8)  # 8 bits a place: as few as 1 in 256 agree by chance
            forest = Forest()
            for i in range(len(keys) - 1):
                for j in np.flatnonzero((low[i + 1 :] == low[i]).sum(axis=1) >= AGREE * SKETCH):
                    forest.union(keys[i], keys[i + 1 + j])
            for k in forest:
                if (root := forest.find(k)) != k:
                    us.append(k)
                    vs.append(root)
            if len(us) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=edge)
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=edge)

    return map_arrow(rows.repartition("path").sortWithinPartitions("path"), run, "u binary, v binary")


def candidates(cuts: Cuts, reps: DataFrame) -> DataFrame:
    """Edges (u, v) between keys whose components hold every similar pair; reps: key, sketch."""
    sketches = reps.select("key", "sketch")
    paths, deep, small, edges = _walked(sketches), FIRST, [], []
    while True:
        counted = paths.groupBy("path").agg(F.count("*").alias("c"), F.min("key").alias("v")).filter("c > 1")
        nodes = cuts.cut(paths.join(counted, "path"), thin=deep > FIRST)
        small.append(nodes.filter(F.col("c") <= SMALL).select("path", "key"))
        large = nodes.filter(F.col("c") > SMALL)
        if large.isEmpty():
            break
        if deep >= DEEPEST:
            small.append(_tiles(large))
            break
        least = large.filter("key = v").join(sketches, "key").select("path", "v", F.col("sketch").alias("least"))
        compared = cuts.cut(_compared(large.select("path", "key").join(sketches, "key").join(least, "path")), thin=True)
        edges.append(compared.filter("agrees and key != v").select(F.col("key").alias("u"), "v"))
        others = compared.groupBy("path").agg(F.count("*").alias("c"), F.count_if(~F.col("agrees")).alias("others")).filter("others > 0")
        small.append(_few_others(compared.join(others.filter(F.col("others") <= SMALL), "path")))
        mixed = others.filter(F.col("others") > SMALL).select("path")
        paths = cuts.cut(_walked(compared.select("path", "key").join(mixed, "path").join(sketches, "key")), thin=True)  # read twice
        deep += LEVELS
    return reduce(DataFrame.unionByName, [*edges, _bucket_edges(reduce(DataFrame.unionByName, small).join(sketches, "key"))])


def _few_others(rows: DataFrame) -> DataFrame:
    """(path, key) of large nodes of which few sets don't agree with the least member: those meet all of the node, in blocks."""
    blocks = F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("others")) / SMALL)).cast("int")
    goes = F.when(F.col("agrees"), F.array(F.pmod(F.xxhash64("key"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    return rows.select("path", "key", F.explode(goes).alias("block")).select(F.xxhash64("path", "block").alias("path"), "key")


def _tiles(large: DataFrame) -> DataFrame:
    """(path, key) of nodes too large for one task: each pair of blocks of about SMALL sets under a path of its own."""
    blocks = F.ceil(F.col("c") / SMALL).cast("int")
    own = large.select("path", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = own.select("path", "key", "own", others).filter("own != other")
    return pairs.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "key")


def similar(own: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Boolean matrix: whether the Jaccard of own[i] and others[j] (or own[j]) is 0.8 or more."""
    both = own if others is None else own + others
    sizes = np.fromiter(map(len, both), np.int64, len(both))
    owner = np.repeat(np.arange(len(both)), sizes)
    _, token, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count > 1  # tokens of one set alone are in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[token]
    owner, column = owner[keep], column[token[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    m, n = len(own), 0 if others is None else len(own)
    common = np.zeros((m, len(both) - n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(both), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part[:m] @ part[n:].T
    return 9 * common >= 4 * (sizes[:m, None] + sizes[n:][None, :])


def _roots(linked: np.ndarray, square: bool) -> np.ndarray:
    """For rows (and then columns, if not square) the first member of their component."""
    m, n = linked.shape
    root = np.full(m if square else m + n, -1)
    for i in range(len(root)):
        if root[i] >= 0:
            continue
        root[i] = i
        rows, columns = (np.array([i]), np.array([], int)) if square or i < m else (np.array([], int), np.array([i - m]))
        while len(rows) or len(columns):
            if square:
                rows = np.flatnonzero(linked[rows].any(axis=0) & (root < 0))
                root[rows] = i
            else:
                to_columns = np.flatnonzero(linked[rows].any(axis=0) & (root[m:] < 0)) if len(rows) else np.array([], int)
                to_rows = np.flatnonzero(linked[:, columns].any(axis=1) & (root[:m] < 0)) if len(columns) else np.array([], int)
                root[m + to_columns] = i
                root[to_rows] = i
                rows, columns = to_rows, to_columns
    return root


_VERIFIED = "comp binary, key binary, root binary, links long, blocks int"


def _verified(units: DataFrame) -> DataFrame:
    """Exact links of each unit's pairs; units: unit, square, side, comp, key, copies, tokens, blocks."""

    def run(batches):
        for group in _groups(batches, "unit"):
            sides, all_keys, seen = group.column("side").to_numpy(), group.column("key").to_pylist(), set()
            order = np.array([i for i in np.argsort(sides, kind="stable") if not (all_keys[i] in seen or seen.add(all_keys[i]))])  # a repeated row comes twice
            sides = sides[order]
            keys = group.column("key").take(pa.array(order)).to_pylist()
            tokens = [np.frombuffer(t, "<u4") for t in group.column("tokens").take(pa.array(order)).to_pylist()]
            copies = group.column("copies").to_numpy()[order]
            cut = int(np.searchsorted(sides, 1))
            square = group.column("square")[0].as_py()
            if not square and cut in (0, len(keys)):
                continue  # no set fell in one of the two blocks
            linked = similar(tokens[:cut], None if square else tokens[cut:])
            if square:
                np.fill_diagonal(linked, False)
                links = linked @ copies
            else:
                links = np.concatenate([linked @ copies[cut:], copies[:cut] @ linked])
            root = _roots(linked, square)
            yield pa.RecordBatch.from_arrays(
                [group.column("comp").take(pa.array(order)).combine_chunks(), pa.array(keys, pa.binary()), pa.array([keys[r] for r in root], pa.binary()), pa.array(links.astype(np.int64)), group.column("blocks").take(pa.array(order)).combine_chunks()],
                names=["comp", "key", "root", "links", "blocks"],
            )

    return map_arrow(units.repartition("unit").sortWithinPartitions("unit"), run, _VERIFIED)


def classes(docs: DataFrame, *keys: str, cuts: Cuts | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, `keys`, key, n) of every row, and per key: root (the class), class_id, n_links, copies."""
    cuts = cuts or Cuts(docs.sparkSession)
    sets = cuts.cut(_sets(docs, keys))
    rows = cuts.cut(sets.select("doc_id", *keys, "key", "n"))
    reps = sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = cuts.cut(reps)
    names = cuts.cut(reps.select("key", "rep", "copies", "n"), thin=True)

    comps = components(cuts, candidates(cuts, reps))
    comps = comps.unionByName(comps.select("root", "root").distinct().toDF("node", "root"))
    comps = cuts.cut(comps.join(names.withColumnRenamed("key", "node"), "node"), thin=True)
    sizes = cuts.cut(comps.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")), thin=True)
    members = comps.join(sizes, "root")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("tokens") / TOKENS))).cast("int")
    members = members.select(F.col("root").alias("comp"), F.col("node").alias("member"), "rep", "copies", blocks.alias("blocks"))
    one = sets.select("key", "doc_id", "tokens")
    found = members.join(one, (members["member"] == one["key"]) & members["rep"].eqNullSafe(one["doc_id"]))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j")))
    units = found.select("comp", F.col("member").alias("key"), "copies", "tokens", "blocks", block.alias("own"), F.explode(pairs).alias("p"))
    units = units.select(F.sha2(F.concat("comp", F.encode(F.concat_ws("/", "p.i", "p.j"), "utf-8")), 256).alias("unit"), (F.col("p.i") == F.col("p.j")).alias("square"), (F.col("own") != F.col("p.i")).cast("int").alias("side"), "comp", "key", "copies", "tokens", "blocks")
    checked = cuts.cut(_verified(units))
    cuts.drop(sets, reps, comps, sizes)

    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    direct = checked.filter("blocks = 1").select(F.col("key").alias("node"), "root")
    merged = components(cuts, checked.filter("blocks > 1").select(F.col("key").alias("u"), F.col("root").alias("v")))
    roots = direct.unionByName(merged)
    known = names.drop("n").join(roots.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    known = cuts.cut(known.select("key", "rep", "copies", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), thin=True)
    least = cuts.cut(known.groupBy("root").agg(F.min("rep").alias("class_id")), thin=True)
    return rows, known.join(least, "root").select("key", "root", "class_id", "n_links", "copies")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_shingles of every row of docs."""
    rows, known = classes(docs)
    out = rows.join(known, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, less all but one of each class.

    The least doc_id stays (null last), then the least hash of the whole row: what stays depends
    on the rows alone, not on how many cores read them. Texts without words stay, all of them.
    """
    cuts, placed = Cuts(docs.sparkSession), whole_rows(docs)
    rows, known = classes(placed.select("row.doc_id", "row.text", "h1", "h2"), "h1", "h2", cuts=cuts)
    members = cuts.cut(rows.join(known, "key").groupBy("root", "doc_id", "h1", "h2").agg(F.count("*").alias("times")))
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("f")).select("root", F.col("f.h1").alias("first1"), F.col("f.h2").alias("first2"))
    stays = (F.col("h1") == F.col("first1")) & (F.col("h2") == F.col("first2"))
    fate = cuts.cut(members.join(cuts.cut(first), "root").select("h1", "h2", stays.alias("stays"), "times"))
    once = fate.filter("stays and times > 1").select("h1", "h2")  # equal rows, of which one stays
    kept = placed.join(fate.filter("not stays or times > 1").select("h1", "h2"), ["h1", "h2"], "left_anti")
    kept = kept.unionByName(placed.join(once, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    return kept.select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 4), ' ') AS k
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (
  SELECT c.x, c.y FROM (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b USING (k) WHERE a.r <> b.r GROUP BY ALL) c
  JOIN n nx ON nx.r = c.x JOIN n ny ON ny.r = c.y WHERE 9 * common >= 4 * (nx.n + ny.n)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
class AS (SELECT reach.x AS r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.y GROUP BY reach.x),
links AS (SELECT x AS r, count(*) AS n_links FROM p GROUP BY x)
SELECT w.doc_id, class.class_id, coalesce(links.n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM w JOIN class USING (r) LEFT JOIN links USING (r) LEFT JOIN n USING (r)
"""

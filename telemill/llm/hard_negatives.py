"""Hard negatives by best-first search in R-trees that sort-tile-recursive packing builds.

Equal vectors of one label are one entry that carries its smallest identifiers. Entries are dealt to tiles by recursive
cuts, one coordinate after another in descending variance; the cuts come from a bounded sample, every entry is indexed.
Each tile is packed the same way into leaves and boxes. The minimum bounding box of a node gives an interval for its
inner product with a query, coordinate by coordinate. A queue ordered by the upper ends opens nodes and leaves out those
outside all score windows or strictly below the worst result so far. A query first visits its most promising tile and
then only those tiles whose interval can still improve on what it has.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import staging

LEAF, FAN = 64, 16
#: Entries of a tile (a tile is one task's tree), and the most tiles; beyond, tiles consist of several trees.
TILE_ROWS, MOST_TILES = 65_536, 8192
#: Entries from which the cuts between tiles are taken.
SAMPLE = 10_000
#: Queries that visit a tile in one task.
BLOCK = 4096
#: Squared norms up to which products are exact in double precision, box corners included, and in 64-bit integers.
_EXACT, _LARGEST = 2.0 ** 46, 2.0 ** 62
_FAR = np.iinfo(np.int64).max


def quantised(vector: F.Column) -> F.Column:
    """``floor(256 * x)`` of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, q``: rows that take part, each once."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & ~bad)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), quantised(v).alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(norm <= _LARGEST).distinct()


def tiling(x: np.ndarray, order: np.ndarray, parts: int) -> list:
    """Nested cuts ``[coordinate, cuts, children]`` that deal rows like those of ``x`` to about ``parts`` tiles."""
    if parts <= 1 or not len(order) or len(x) < 2:
        return []
    slabs = min(parts, max(2, int(np.ceil(parts ** (1 / len(order)) - 1e-9))))
    k = int(order[0])
    values = np.sort(x[:, k])
    at = values[[len(values) * s // slabs for s in range(1, slabs)]]
    side = np.searchsorted(at, x[:, k], "right")
    return [k, at.tolist(), [tiling(x[side == s], order[1:], -(-parts // slabs)) for s in range(slabs)]]


def deal(x: np.ndarray, tree: list) -> np.ndarray:
    """Tile numbers of the rows of ``x``, in the order of the leaves of ``tree``."""
    tile, number = np.zeros(len(x), np.int64), 0

    def walk(node: list, rows: np.ndarray) -> None:
        nonlocal number
        if not node:
            tile[rows] = number
            number += 1
            return
        side = np.searchsorted(node[1], x[rows, node[0]], "right")
        for s, child in enumerate(node[2]):
            walk(child, rows[side == s])

    walk(tree, np.arange(len(x)))
    return tile


def leaves_of(tree: list) -> int:
    return sum(map(leaves_of, tree[2])) if tree else 1


def matrix(column, dims: int) -> np.ndarray:
    """Rows of integers, shorter ones padded by zeros."""
    out = np.zeros((len(column), dims), np.int64)
    if not len(column):
        return out
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(values.flatten()), np.concatenate(([0], np.cumsum(np.asarray(values.value_lengths().fill_null(0)))))
    row = np.repeat(np.arange(len(out)), np.diff(ends))
    out[row, np.arange(len(flat)) - ends[:-1][row]] = flat
    return out


def jittered(x: np.ndarray) -> np.ndarray:
    """Coordinates plus a fraction that depends on the whole vector, so that cuts also part equal coordinates."""
    h = (x * np.random.default_rng(9).integers(1, 1 << 30, x.shape[1])).sum(1) % 1009
    return x + (h / 1009.0)[:, None]


def packed(x: np.ndarray, first_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which entries are packed, and where leaves begin in it."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    spread = jittered(x)
    place = deal(spread, tiling(spread, np.argsort(-x.var(0), kind="stable"), -(-len(x) // LEAF)))
    order = np.lexsort((first_id, place))
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    # leaves that ties have made too large are cut again
    begin = [np.arange(a, b, LEAF) for a, b in zip(first, np.append(first[1:], len(x)))]
    return order, np.append(np.concatenate(begin), len(x))


class Tree:
    """A packed tree: entries in leaf order and the boxes of all levels, leaves first."""

    def __init__(self, x: np.ndarray, label: list[str], ids: np.ndarray, counts: np.ndarray, begin: np.ndarray):
        self.begin, self.leaves = begin, len(begin) - 1
        ends = np.cumsum(counts)
        self.ids = np.split(ids, ends[:-1])
        exact = (not len(x)) or float((x.astype(np.float64) ** 2).sum(1).max()) <= _EXACT
        self.values = x.astype(np.float64) if exact else x
        names, self.code = np.unique(np.array(label, object), return_inverse=True)
        self.codes = {n: k for k, n in enumerate(names.tolist())}
        level = (x, x, ids[ends - counts] if len(x) else ids)
        start, levels, self.child = begin[:-1], [], []
        while len(start):
            level = tuple(f.reduceat(v, start, axis=0) for f, v in zip((np.minimum, np.maximum, np.minimum), level))
            levels.append(level)
            if len(level[0]) == 1:
                break
            below = sum(len(v[0]) for v in levels[:-1])
            start = np.arange(0, len(level[0]), FAN)
            self.child += [(below + a, below + b) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(level[0])])]
        self.low, self.high = (np.concatenate([v[k] for v in levels]).astype(np.float64) for k in (0, 1))
        self.least = np.concatenate([v[2] for v in levels])


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of every query (row) with every box (column)."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    # beyond 2**53 sums are rounded; the margin keeps the interval an outer one
    slack = np.where(np.maximum(np.abs(most), np.abs(least)) < 2.0 ** 52, 0.0, 1e-9 * (np.abs(up) @ np.maximum(np.abs(low), np.abs(high)).T - down @ np.maximum(np.abs(low), np.abs(high)).T))
    return least - slack, most + slack


def search(tree: Tree, values: np.ndarray, q: np.ndarray, label: str, same: bool, windows: list[tuple[int, int]], k: int,
           worst: list[tuple[int, int]], own: int | None, least: np.ndarray, most: np.ndarray) -> list[list[tuple[int, int]]]:
    """For every window the first ``k`` pairs ``(-score, id)`` of the tree that come before ``worst``.

    ``least`` and ``most`` are the query's intervals with the nodes; ``own`` is the query's own identifier, left out.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    bound = list(worst)
    code = tree.codes.get(label, -1)
    if not tree.leaves or (same and code < 0):
        return found

    def key(node: int) -> float | None:
        """The best score that the node may add to a window; none where it adds to none."""
        best = None
        for j, (lo, hi) in enumerate(windows):
            if lo > hi or most[node] < lo or least[node] > hi:
                continue
            top = min(most[node], hi)
            if top < -bound[j][0] or (top == -bound[j][0] and tree.least[node] > bound[j][1]):
                continue
            best = top if best is None or top > best else best
        return best

    root = len(tree.least) - 1
    first = key(root)
    queue = [] if first is None else [(-first, root)]
    while queue:
        _, node = heapq.heappop(queue)
        if key(node) is None:
            continue
        if node >= tree.leaves:
            for child in range(*tree.child[node - tree.leaves]):
                now = key(child)
                if now is not None:
                    heapq.heappush(queue, (-now, child))
            continue
        a, b = tree.begin[node], tree.begin[node + 1]
        score = values[a:b] @ q
        fits = (tree.code[a:b] == code) == same
        for j, (lo, hi) in enumerate(windows):
            cut = -bound[j][0]
            for i in np.flatnonzero(fits & (score >= max(lo, cut)) & (score <= hi)).tolist():
                s = int(score[i])
                new = [(-s, n) for n in tree.ids[a + i].tolist() if n != own and (-s, n) < bound[j]]
                if new:
                    found[j] = heapq.nsmallest(k, found[j] + new)
                    if len(found[j]) == k:
                        bound[j] = min(bound[j], found[j][-1])
    return found


INDEX = "tile long, part long, low array<bigint>, high array<bigint>, x binary, label array<string>, ids binary, counts binary, begin binary"
_INDEX = pa.schema([("tile", pa.int64()), ("part", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("x", pa.binary()),
                    ("label", pa.list_(pa.string())), ("ids", pa.binary()), ("counts", pa.binary()), ("begin", pa.binary())])
FOUND = "query long, slot int, scores array<bigint>, ids array<bigint>"
_FOUND = pa.schema([("query", pa.int64()), ("slot", pa.int32()), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


class Index:
    """Every entry, packed: a table with a row per tree, the boxes of the tiles, trees per tile, and coordinates."""

    def __init__(self, trees: DataFrame, tiles: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int, dims: int):
        self.trees, self.tiles, self.low, self.high, self.parts, self.dims = trees, tiles, low, high, parts, dims


def build(spark: SparkSession, rows: DataFrame, keep: int, tile_rows: int = TILE_ROWS, sample: int = SAMPLE) -> Index:
    """Pack all ``id, label, q`` rows; an entry carries its ``keep`` smallest identifiers, which lists of that length need."""
    # the rank limit also runs before the shuffle, so a vector that a third of the rows share brings few rows
    rank = F.row_number().over(Window.partitionBy("q", "label").orderBy("id"))
    entries = rows.withColumn("_r", rank).where(F.col("_r") <= keep)
    entries = staging.stage(spark, entries.groupBy("q", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n, dims = entries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    dims = max(1, dims or 0)
    # two tasks a core at least; past MOST_TILES a tile consists of more trees instead
    tiles = max(1, min(MOST_TILES, max(2 * spark.sparkContext.defaultParallelism, -(-n // tile_rows)), -(-n // LEAF)))
    parts = max(1, -(-n // (tiles * tile_rows)))
    x = matrix(entries.select("q").orderBy(F.xxhash64("q"), "q").limit(sample).toArrow().column("q"), dims)
    cuts = json.dumps(tiling(jittered(x), np.argsort(-x.var(0), kind="stable") if len(x) else np.zeros(0, int), tiles))

    def place(batches):
        tree = json.loads(cuts)
        for batch in batches:
            own = matrix(batch.column("q"), dims)
            part = (own @ np.arange(1, dims + 1) + batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)) % parts
            yield pa.RecordBatch.from_arrays([pa.array(deal(jittered(own), tree)), pa.array(part), *[batch.column(c) for c in ("q", "label", "ids")]],
                                             names=["tile", "part", "q", "label", "ids"])

    def pack(table):
        x, lists = matrix(table.column("q"), dims), table.column("ids").to_pylist()
        order, begin = packed(x, np.array([i[0] for i in lists], np.int64))
        labels = table.column("label").to_pylist()
        counts = np.array([len(lists[i]) for i in order], np.int64)
        row = {"tile": table.column("tile")[0].as_py(), "part": table.column("part")[0].as_py(), "low": x.min(0), "high": x.max(0),
               "x": x[order].tobytes(), "label": [labels[i] for i in order], "ids": np.array([v for i in order for v in lists[i]], np.int64).tobytes(),
               "counts": counts.tobytes(), "begin": begin.astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], _INDEX)

    staging.batches(spark)
    placed = entries.mapInArrow(place, "tile long, part long, q array<bigint>, label string, ids array<bigint>")
    trees = staging.stage(spark, placed.groupBy("tile", "part").applyInArrow(pack, INDEX))
    ends = [F.max(F.col("high")[k]).alias(f"h{k}") for k in range(dims)] + [F.min(F.col("low")[k]).alias(f"l{k}") for k in range(dims)]
    boxes = trees.groupBy("tile").agg(*ends).orderBy("tile").collect()  # at most MOST_TILES rows
    corner = {c: np.array([[r[f"{c}{k}"] for k in range(dims)] for r in boxes], np.float64).reshape(-1, dims) for c in "lh"}
    return Index(trees, np.array([r["tile"] for r in boxes], np.int64), corner["l"], corner["h"], parts, dims)


def _visits(spark: SparkSession, index: Index, queries: DataFrame, k: int, same: bool, blocks: int, home: bool) -> DataFrame:
    """What queries find in their most promising tile (``home``), or in the others that may improve on ``worst``."""
    tiles, low, high, dims = index.tiles, index.low, index.high, index.dims
    shared = spark.sparkContext.broadcast((tiles, low, high))  # at most MOST_TILES boxes

    def route(batches):
        tiles, low, high = shared.value
        for batch in batches:
            if not batch.num_rows or not len(tiles):
                continue
            least, most = intervals(matrix(batch.column("q"), dims), low, high)
            windows = [batch.column(c).to_pylist() for c in ("lo", "hi", "worst")]
            at, to = [], []
            for r, (lows, highs, worst) in enumerate(zip(*windows)):
                top, better = np.full(len(tiles), -np.inf), np.zeros(len(tiles), bool)
                for j, (lo, hi) in enumerate(zip(lows, highs)):
                    meets = (lo <= hi) & (most[r] >= lo) & (least[r] <= hi)
                    now = np.where(meets, np.minimum(most[r], hi), -np.inf)
                    better |= meets & (now >= (worst[j] if worst and worst[j] is not None else -_FAR))
                    top = np.maximum(top, now)
                # of equal tiles the one whose interval begins highest
                best = int(np.lexsort((-least[r], -top))[0])
                mine = [best] if better[best] else []
                chosen = mine if home else [t for t in np.flatnonzero(better).tolist() if t != best]
                at += [r] * len(chosen)
                to += chosen
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tiles[to], pa.int64()), *[rows.column(c) for c in names]], names=["tile", *names])

    def visit(left, right):
        out = {"query": [], "slot": [], "scores": [], "ids": []}
        if left.num_rows and right.num_rows:
            row = right.slice(0, 1).to_pylist()[0]
            begin, counts, ids = (np.frombuffer(row[c], np.int64) for c in ("begin", "counts", "ids"))
            tree = Tree(np.frombuffer(row["x"], np.int64).reshape(-1, dims), row["label"], ids, counts, begin)
            for i in range(0, left.num_rows, 128):
                part = left.slice(i, 128)
                q = matrix(part.column("q"), dims)
                least, most = intervals(q, tree.low, tree.high)
                large = float((q.astype(np.float64) ** 2).sum(1).max()) > _EXACT
                values = tree.values.astype(np.int64) if large else tree.values
                for r, row in enumerate(part.select(["query", "label", "own", "lo", "hi", "worst"]).to_pylist()):
                    worst = [(-w, _FAR) if w is not None else (_FAR, _FAR) for w in row["worst"] or [None] * len(row["lo"])]
                    got = search(tree, values, q[r], row["label"], same, list(zip(row["lo"], row["hi"])), k, worst, row["own"], least[r], most[r])
                    for j, pairs in enumerate(got):
                        if pairs:
                            out["query"].append(row["query"])
                            out["slot"].append(j)
                            out["scores"].append([-s for s, _ in pairs])
                            out["ids"].append([n for _, n in pairs])
        return pa.table(out, schema=_FOUND)

    names = ["query", "label", "own", "q", "lo", "hi", "worst"]
    kinds = "query long, label string, own long, q array<bigint>, lo array<bigint>, hi array<bigint>, worst array<bigint>"
    staging.batches(spark)
    routed = queries.select(*names).mapInArrow(route, "tile long, " + kinds)
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.parts - 1).cast("long"))))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    trees = index.trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    on = ("tile", "part", "block")
    return routed.groupBy(*on).cogroup(trees.groupBy(*on)).applyInArrow(visit, FOUND)


def nearest(spark: SparkSession, index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``query, slot, found``: for each window of a query the first ``k`` rows inside it as ``(score, id)``, best first.

    ``queries`` has ``query`` (distinct), ``label``, ``q``, ``own`` and the arrays ``lo`` and ``hi`` of window ends; rows must
    have the query's label (``same``) or another one.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    none = queries.withColumn("worst", F.lit(None).cast("array<bigint>"))
    first = staging.stage(spark, _visits(spark, index, none, k, same, blocks, True))
    kth = first.where(F.size("scores") >= k).groupBy("query", "slot").agg(F.max(F.col("scores")[k - 1]).alias("kth"))
    kth = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
    slots = F.sequence(F.lit(0), F.size("lo") - 1)
    worst = F.when(F.size("lo") > 0, F.transform(slots, lambda j: F.try_element_at("kth", j)))
    again = queries.join(kth, "query", "left").withColumn("worst", worst)
    both = first.unionByName(_visits(spark, index, again, k, same, blocks, False))
    pairs = F.flatten(F.collect_list(F.arrays_zip((F.transform("scores", lambda s: -s)).alias("s"), F.col("ids").alias("n"))))
    best = F.slice(F.sort_array(pairs), 1, k)
    best = both.groupBy("query", "slot").agg(best.alias("b"))
    return best.select("query", "slot", F.transform("b", lambda p: F.struct((-p["s"]).alias("score"), p["n"].alias("id"))).alias("found"))


def mine(spark: SparkSession, rows: DataFrame, anchors: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **options) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` selects.

    ``anchors`` is a condition on the column ``id``. An anchor's positives are its best rows of the same label; a negative
    of a pair is a row of another label whose score lies between ``low`` and ``high`` per cent of the positive's. Scores are
    inner products of components ``floor(256 * x)``; ties go to the smaller identifier.

    Rows with a null identifier, label or vector, or any null or non-finite component, take no part, nor do vectors whose
    squared norm passes 2**62, as scores would be no 64-bit integers. Rows equal in identifier, label and vector count
    once; rows that share only the identifier count each and are never each other's positive. Shorter vectors are padded
    by zeros. An anchor without positives, or a pair without negatives, gives no row. Other columns are not read.
    """
    rows = staging.stage(spark, usable(rows, id_col, vector_col, label_col))
    index = build(spark, rows, max(positives + 1, negatives), **options)
    far = F.array(F.lit(int(_LARGEST)))
    asked = rows.where(anchors).select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("own"), "label", "q")
    asked = staging.stage(spark, asked.withColumn("lo", F.transform(far, lambda v: -v)).withColumn("hi", far))
    near = nearest(spark, index, asked, positives, True).select("query", F.col("found").alias("p"))
    # 100 n >= low p and 100 n <= high p, in whole numbers
    lo = F.transform("p", lambda v: F.ceil(v["score"].cast("decimal(38,0)") * low / 100).cast("long"))
    hi = F.transform("p", lambda v: F.floor(v["score"].cast("decimal(38,0)") * high / 100).cast("long"))
    pairs = staging.stage(spark, asked.drop("lo", "hi").join(near, "query").withColumn("lo", lo).withColumn("hi", hi))
    far_rows = nearest(spark, index, pairs.withColumn("own", F.lit(None).cast("long")), negatives, False)
    out = pairs.select("query", F.col("own").alias("anchor_id"), F.posexplode("p").alias("slot", "p")).join(far_rows, ["query", "slot"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.posexplode("found").alias("rank", "f"), F.col("p.score").alias("positive_score")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"))

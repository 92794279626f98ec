"""MinHash near-duplicates: universal hash minima, banding, signature checks, exact confirmation, star components.

Documents with the same shingle set are one class and are compared once. A class whose band key occurs again is compared
with the leader of that bucket, the member that shares most buckets with others, so a bucket of any size gives one pair
per member. Pairs whose signatures agree too little are dropped (the bound lies 5.5 standard deviations under the
threshold), the others are confirmed on whole shingle sets. Where the members of a leader still lie in several
components, all but the largest component are compared with every other member, in blocks: signatures first, then whole
sets, and a block reports only links that join components. With 36 bands of 7 minima a pair at a similarity of 0.85
shares no band in one of a million cases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, staging, text

SHINGLE = 5
BANDS, ROWS = 36, 7
SIMILARITY = (85, 100)
#: Members outside the largest component in a block of the complete search, and other members they meet in one task.
BLOCK, OTHERS = 128, 1024
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, seed: int, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document; fewer words than ``size`` are one shingle, none gives none."""
    b = text.LOWER[buf]
    s, e, w = text.spans(b, offsets, text.NOT_SPACE)
    h = text.SpanHash(b, seed)(s, e)
    n = max(0, len(h) - size + 1)
    wide = np.full(n, size, np.uint64)
    for k in range(size):
        wide = text.mix(wide * _STEP + h[k:k + n])
    out = []
    for a, z in zip(w[:-1].tolist(), w[1:].tolist()):
        if z - a >= size:
            out.append(np.unique(wide[a:z - size + 1]))
        else:
            x = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                x = text.mix(x * _STEP + h[k:k + 1])
            out.append(x if z > a else np.zeros(0, np.uint64))
    return out


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of ``n`` multiply-shift universal hashes."""
    r = np.random.default_rng(97)
    return (r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64))


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` universal hash minima (upper 32 bits) of every non-empty set."""
    x = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    a, b = coefficients(n)
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], at) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, bands: int, rows: int, size: int, seed: int) -> DataFrame:
    """Per document: set size, two set digests, band keys and a signature of 16 bits per minimum (null without words)."""
    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                sets = shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], seed, size)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                d1, d2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                keys: list = [None] * (j - i)
                signs: list = [None] * (j - i)
                if len(full):
                    own = [sets[k] for k in full.tolist()]
                    x, at = np.concatenate(own), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    d1[full] = np.add.reduceat(text.mix(x * _STEP), at).view(np.int64)
                    d2[full] = np.add.reduceat(text.mix(x + _STEP), at).view(np.int64)
                    m = minima(own, bands * rows)
                    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(own), 0)
                    for r in range(rows):
                        key = text.mix(key * _STEP + m[:, r::rows])
                    short = (m & np.uint32(0xFFFF)).astype(np.uint16)
                    for row, k in enumerate(full.tolist()):
                        keys[k], signs[k] = key[row].view(np.int64), short[row].tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column("_doc").slice(i, j - i), pa.array(sizes), pa.array(d1), pa.array(d2),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc", "n", "d1", "d2", "bands", "sign"])

    return docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, bands array<bigint>, sign binary")


def sets_of(docs: DataFrame, size: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                sets = shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], seed, size)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("_doc").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                                 names=["doc", "items"])

    return docs.mapInArrow(run, "doc long, items array<bigint>")


def promising(pairs: DataFrame, signs: DataFrame, least: float, share: float) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow the similarity asked for."""
    left = signs.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    right = signs.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    rows = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") >= F.lit(share) * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(text.flat(batch.column(c))[0].tobytes(), np.uint16).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return rows.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def staged_sets(spark: SparkSession, wanted: DataFrame, docs: DataFrame, size: int, seed: int) -> DataFrame:
    """Shingle sets (``doc, items``) of the documents in ``wanted`` (one column of identifiers)."""
    wanted = wanted.toDF("_w").distinct()
    return staging.stage(spark, sets_of(docs.join(wanted, docs["_doc"] == wanted["_w"], "left_semi"), size, seed).dropDuplicates(["doc"]))


def confirmed(spark: SparkSession, pairs: DataFrame, docs: DataFrame, size: int, seed: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (u, v) among ``pairs`` whose whole shingle sets are similar enough."""
    sets = staged_sets(spark, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), docs, size, seed)
    left, right = (sets.select(F.col("doc").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    rows = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    least, of = similarity
    union = F.size("items_a") + F.size("items_b") - both
    return rows.where(of * both >= least * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def divided(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Members (``leader, doc, component``) that have to be compared, dealt out to blocks.

    Of each leader with several components, the members outside the largest one are the small side, split in blocks.
    They meet each other in the block of the earlier one, and all members of the largest component in every block.
    """
    by = members.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("c"))
    tops = by.groupBy("leader").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k"))
    tops = tops.where("k > 1").select("leader", F.col("top.component").alias("big"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("blocks"),
                                      F.ceil(F.col("all") / OTHERS).cast("int").alias("shares"))
    rows = members.where("doc <> leader").join(staging.stage(spark, tops), "leader")
    small = F.col("component") != F.col("big")
    own = F.when(small, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(F.col("blocks") - 1).cast("int")
    rows = rows.withColumn("own", own).withColumn("small", small).withColumn("block", F.explode(F.sequence(F.lit(0), "own")))
    rows = rows.withColumn("small", F.col("small") & (F.col("block") == F.col("own")))
    share = F.pmod(F.xxhash64("component", "doc"), F.col("shares")).cast("int")
    rows = rows.withColumn("share", F.explode(F.when(F.col("small"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(share))))
    return rows.select("leader", "block", "share", "small", "doc", "component")


def block_links(rows: DataFrame, least: float, similarity: tuple[int, int]) -> DataFrame:
    """Links (u, v) between components found inside the blocks of ``divided`` rows (with ``sign`` and ``items``)."""
    num, of = similarity

    def run(table: pa.Table) -> pa.Table:
        doc, part, small = (table.column(c).to_numpy() for c in ("doc", "component", "small"))
        sign = np.frombuffer(text.flat(table.column("sign"))[0].tobytes(), np.uint16).reshape(len(doc), -1)
        items = table.column("items").combine_chunks()
        flat, ends = items.flatten().to_numpy(), np.concatenate(([0], np.cumsum(items.value_lengths().to_numpy())))
        size = np.diff(ends)
        inner = table.column("share")[0].as_py() == 0
        parent = {c: c for c in part.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for i in np.flatnonzero(small).tolist():
            meet = ~small
            if inner:
                meet = meet | (small & (np.arange(len(doc)) > i))
            meet = np.flatnonzero(meet & (part != part[i]) & (of * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])))
            meet = meet[(sign[meet] == sign[i]).mean(axis=1) >= least]
            if not len(meet):
                continue
            own = flat[ends[i]:ends[i + 1]]
            theirs = flat[text.ragged(ends[meet], size[meet])]
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[at] == theirs).astype(np.int64), np.cumsum(size[meet]) - size[meet])
            for j in meet[of * both >= num * (size[i] + size[meet] - both)].tolist():
                p, q = root(int(part[i])), root(int(part[j]))
                if p != q:
                    parent[p] = q
                    links.append((int(doc[i]), int(doc[j])))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("leader", "block", "share").applyInArrow(run, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``; ``similarity`` is a fraction of whole numbers.

    Words are runs of non-blank characters with A-Z lower-cased, shingles are ``size`` of them (fewer: all of them).
    Documents without words, null texts included, are linked with nothing. ``component_id`` is the smallest identifier
    that a document reaches over links, and that document is kept. Rows that share an identifier count as one document.
    Rows without an identifier are not linked: their component is null and they are kept. An empty table gives an empty
    result, and other columns are not read.
    """
    staging.batches(spark)
    seed = text.fresh_seed()  # words and shingles are told apart by hashes that no text can be written against
    share = similarity[0] / similarity[1]
    least = share - 5.5 * (share * (1 - share) / (bands * rows)) ** 0.5
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    sketches = staging.stage(spark, sketch(source, bands, rows, size, seed))
    known = sketches.where("doc IS NOT NULL AND n > 0")
    classes = staging.stage(spark, known.groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep")))
    heads = known.join(classes.withColumnRenamed("rep", "doc"), ["doc", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc", "n", "d1", "d2"])
    heads = staging.stage(spark, heads.select("doc", "n", "sign", "bands"))
    members = heads.select("doc", F.explode("bands").alias("bucket"))
    # sizes, leaders and the like are written out: joins with them read plain exchanges, whose large partitions can be split
    sizes = staging.stage(spark, members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    crowded = staging.stage(spark, members.join(sizes, "bucket"))
    fame = staging.stage(spark, crowded.groupBy("doc").agg(F.sum("size").alias("fame")))
    leaders = crowded.join(fame, "doc").groupBy("bucket").agg(F.max(F.struct("fame", "doc")).alias("top"))
    leaders = staging.stage(spark, leaders.select("bucket", F.col("top.doc").alias("leader")))
    members = staging.stage(spark, crowded.join(leaders, "bucket").select("leader", "doc").distinct())
    pairs = members.where("doc <> leader").select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
    signs = heads.select("doc", "n", "sign")
    pairs = staging.stage(spark, promising(pairs, signs, least, share))
    links = staging.stage(spark, confirmed(spark, pairs, source, size, seed, similarity))
    found = staging.stage(spark, components.components(spark, links))
    placed = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    blocks = staging.stage(spark, divided(spark, placed))
    if not blocks.isEmpty():
        sets = staged_sets(spark, blocks.select("doc"), source, size, seed)
        more = block_links(blocks.join(signs.select("doc", "sign"), "doc").join(sets, "doc"), least, similarity)
        found = components.components(spark, links.unionByName(staging.stage(spark, more)))
    out = sketches.join(classes, ["n", "d1", "d2"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    found = near_duplicates(spark, docs, id_col, text_col, **options)
    gone = found.where("NOT kept").select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")

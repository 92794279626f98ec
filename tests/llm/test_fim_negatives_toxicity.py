"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import fill_in_middle, hard_negatives, toxicity

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASH = {"_id": 1, "_text": "x", "_form": 2, "n": 4, "output": "y", "score": 0.5, "q": 3, "id": 8, "tile": 9, "restored": "z"}
SCHEMA = "doc_id long, text string"


def rewritten(doc_id, text):
    text = text or ""
    u = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    parts = ["a", "étage", " ", "  ", "\n", "\t", "日本", "<", ">", "<P", "S>", "x<S", ".", "\x0b", " ", "word"]
    rows = [(k, "".join(rng.choice(parts, rng.integers(0, 60)))) for k in range(400)]
    rows += [(500 + k, t) for k, t in enumerate(["", None, " ", "<P>", "a<S>b", "<M> <M>", "end<", "P>start", "one", "long text " * 30000, "\n\n x", "x \n"] * 4)]
    rows += [(None, "no name"), (None, "no name"), (None, None), (700, "twice"), (700, "twice"), (700, "other")]
    return spark.createDataFrame(rows, SCHEMA)


def test_fill_in_middle_is_the_brute_force(spark, texts):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for docs in (texts, texts.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])):
        out = fill_in_middle.transform(docs)
        assert out.columns == names
        got = sorted(map(tuple, out.collect()), key=str)
        assert got == sorted((rewritten(*r) for r in texts.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fill_in_middle.restore(out)
    assert sorted(r["restored"] for r in back.collect()) == sorted(r["text"] or "" for r in texts.collect())


def test_fill_in_middle_without_rows_and_at_other_rates(spark, texts):
    assert fill_in_middle.restore(fill_in_middle.transform(texts.where("false"))).collect() == []
    forms = {r["form"] for r in fill_in_middle.transform(texts.where("text rlike '^[a-z. ]+$'"), rate=100, spm=0).collect()}
    assert forms == {"psm"}
    kept = fill_in_middle.restore(spark.createDataFrame([(None, None), ("a<P>", "plain")], "output string, form string"))
    assert [r["restored"] for r in kept.collect()] == ["", "a<P>"]


def test_fill_in_middle_refuses_a_broken_output():
    with pytest.raises(ValueError):
        fill_in_middle.gather(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([fill_in_middle.PSM]))


def brute_negatives(rows, every=10, positives=5, negatives=10, low=30, high=90):
    seen = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in q) <= 2 ** 62:
            seen.add((i, str(label), q))
    width = max((len(q) for _, _, q in seen), default=0)
    pad = [(i, label, q + (0,) * (width - len(q))) for i, label, q in seen]
    out = []
    for i, label, q in pad:
        if i % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, r)), j, other) for j, other, r in pad]
        best = sorted((s, j) for s, j, other in score if other == label and j != i)[:positives]
        for s, j in best:
            fits = sorted((t, k) for t, k, other in score if other != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, d, labels, scale=0.2, whole=False):
    r = np.random.default_rng(seed)
    x = r.integers(-2, 3, (n, d)) / 8 if whole else r.normal(0, scale, (n, d))
    return [(i, [float(np.float32(v)) for v in row], int(r.integers(labels))) for i, row in enumerate(x)]


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])
    out = hard_negatives.mine(spark, df, F.col("id") % every == 0, **options)
    assert out.columns == NAMES
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("rows", [
    vectors(1, 500, 6, 3), vectors(2, 400, 2, 2, whole=True),  # many ties and equal vectors
    vectors(3, 90, 12, 4, scale=1e4),  # products beyond 2**53
], ids=["random", "ties", "large"])
def test_negatives_are_the_brute_force(spark, rows):
    got = mined(spark, rows, tile_rows=64)
    assert got == brute_negatives(rows)
    assert len(got) > 20


def test_negatives_with_a_common_vector_nulls_repeats_and_uneven_lengths(spark):
    rows = vectors(5, 150, 4, 3) + [(200 + k, [0.25, 0.5, -0.25, 0.125], k % 2) for k in range(120)]
    rows += [(400, None, 1), (410, [0.1, None], 1), (420, [float("nan")], 0), (430, [float("inf")], 0), (None, [0.1], 0), (440, [0.1, 0.2], None),
             (450, [1e30] * 4, 0), (460, [0.5], 1), (470, [], 1), (480, [0.2] * 6, 2), (490, [0.2] * 6, 2), (490, [0.2] * 6, 2), (490, [0.3] * 6, 2), (490, [0.2] * 6, 1)]
    got = mined(spark, rows, every=5, tile_rows=64)
    assert got == brute_negatives(rows, every=5)
    assert {r[0] for r in got} >= {480, 490}


def test_several_trees_of_a_tile_and_no_rows(spark, monkeypatch):
    rows = vectors(7, 300, 5, 2)
    monkeypatch.setattr(hard_negatives, "MOST_TILES", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    assert mined(spark, rows, tile_rows=50) == brute_negatives(rows)
    assert mined(spark, rows[1:2], every=7) == [] and mined(spark, []) == []


def test_search_opens_few_nodes_where_boxes_part_the_rows():
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(-20, 20, (640, 3)) + np.array(c) for c in ([900, 0, 0], [0, 900, 0], [0, 0, 900], [-900, 0, 0])])
    order, begin = hard_negatives.packed(x, np.arange(len(x)))
    tree = hard_negatives.Tree(x[order], ["a"] * len(x), order, np.ones(len(x), np.int64), begin)
    least, most = hard_negatives.intervals(np.array([[1, 0, 0]]), tree.low, tree.high)
    opened = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            opened.append(at)
            return np.asarray(self)[at]

    got = hard_negatives.search(tree, tree.values.view(Seen), np.array([1, 0, 0]), "a", True, [(-10 ** 9, 10 ** 9)], 3,
                                [(hard_negatives._FAR, hard_negatives._FAR)], None, least[0], most[0])
    assert got[0] == sorted((-int(v), int(i)) for i, v in enumerate(x[:, 0]))[:3]
    assert len(opened) < tree.leaves / 2


def docs_with_insults(spark, n=600):
    r = np.random.default_rng(8)
    words = ["w%d" % k for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        w = list(r.choice(words, r.integers(0, 200)))
        toxic = k % 4 == 0
        if toxic:
            w.insert(int(r.integers(len(w) + 1)), "Blockhead,")
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x " * 50000 + "blockhead"), (None, "blockhead"), (3, "again"), (3, "again")]
    labels += [(0, None), (None, 1), (4, 0), (9999, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_keeps_the_fold_out(spark):
    docs, labels = docs_with_insults(spark)
    model = toxicity.train(spark, docs, labels)
    assert len(model[0]) < 400
    clash = docs.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])
    got = toxicity.score(clash, model).collect()
    assert len(got) == docs.count()
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    fold = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in fold) and len(fold) > 80
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[602] > 0.5 and by[None] > 0.5 and by[600] == by[601] < 0.5
    # labels of the held-out fold change nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(spark, docs, turned)
    assert all(np.array_equal(a, b) for a, b in zip(model, again))


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = docs_with_insults(spark, 8)
    assert toxicity.train(spark, docs, labels.where("false")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), None).collect() == []


def test_ftrl_is_the_published_update():
    """One coordinate at a time in plain Python gives the same weights."""
    r = np.random.default_rng(2)
    found = [np.unique(r.integers(0, 30, 6)) for _ in range(200)]
    label = [float(5 in f) for f in found]
    at, weights, bias, _ = toxicity.fit(found, label, bits=5, epochs=1, l1=0.5)
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0
    w = lambda k: 0.0 if abs(z[k]) <= 0.5 else (math.copysign(0.5, z[k]) - z[k]) / (1.0 + math.sqrt(n[k]) + 0.1)
    for k in np.random.default_rng(3).permutation(200):
        now = {int(i): w(i) for i in found[k]}
        b = -zb / (1.0 + math.sqrt(nb))
        g = 1 / (1 + math.exp(-(sum(now.values()) + b))) - label[k]
        for i, v in now.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * v
            n[i] += g * g
        zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) * b, nb + g * g
    want = {i: w(i) for i in range(32) if w(i)}
    assert dict(zip(at.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-5)
    assert bias == pytest.approx(-zb / (1.0 + math.sqrt(nb)))
    assert max(want, key=want.get) == 5

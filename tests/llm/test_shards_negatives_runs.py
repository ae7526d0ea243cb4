"""External shuffle, hard negatives and periodic runs against their laws and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import negatives, periodic, sharding

DOCS = "doc_id long, text string, bucket string, shard string, tags map<string,int>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} " * (i % 13), "b", None, {"k": i}) for i in range(900)]
    rows += [(5, "same", "b", "s", None)] * 400 + [(None, "same", None, None, None)] * 40 + [(None, None, None, None, None), (7, "", None, None, None), (8, "é" * 20_000, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def law(rows, count):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard if hasattr(r, "law") else r.shard_, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(count))


def test_shards_hold_all_rows(docs):
    got = sharding.shards(docs, 8, seed=3, bucket_bytes=2000).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "bucket", "shard", "tags", "shard_", "slot"}
    law(got, 8)
    key = lambda r: (r.doc_id, r.text, r.bucket, r.shard, str(r.tags))
    assert Counter(map(key, got)) == Counter(map(key, docs.collect()))


def test_shards_reproducible_and_spread(spark, docs):
    own = docs.select("doc_id", "text")
    place = lambda df, seed: sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in sharding.shards(df, 8, seed, bucket_bytes=4000).collect())
    a = own.where("doc_id <> 5")
    assert place(a, 1) == place(a.repartition(7).orderBy(F.desc("doc_id")), 1)
    assert place(a, 1) != place(a, 2)
    # every doc_id is as likely in every shard: chi-squared of 8 shards by halves of the ids
    rows = sharding.shards(spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 8, seed=9, bucket_bytes=1000).collect()
    low = Counter(r.shard for r in rows if r.doc_id < 4000)
    assert sum((low[s] - 500) ** 2 / 500 for s in range(8)) < 30
    by = {(r.shard, r.slot): r.doc_id for r in rows}
    order = [by[k] for k in sorted(by)]
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.05 and abs(np.corrcoef(order, range(8000))[0, 1]) < 0.05


def test_repeats_are_dealt_over_buckets(docs):
    table, bucket, place = sharding.shuffled(docs.where("doc_id = 5"), seed=1, bucket_bytes=200)
    sizes = [r["count"] for r in table.groupBy(bucket).count().collect()]
    assert sum(sizes) == 401 and len(sizes) > 5 and max(sizes) < 150
    assert all(sorted(r.p) == list(range(len(r.p))) for r in table.groupBy(bucket).agg(F.collect_list(place).alias("p")).collect())


def test_shard_report(docs):
    rows = sharding.report(docs).collect()
    law(rows, 8)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.report(docs.limit(0)).count() == 0
    law(sharding.report(docs.limit(3)).collect(), 8)


def test_saved_shards(docs, tmp_path):
    own = docs.select("doc_id", "text")
    back = sharding.save(own, str(tmp_path / "shards"), 4, seed=5, bucket_bytes=3000)
    assert back.count() == own.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def hard(rows):
    rows = [(i, x, v) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for *_, v in rows), default=0)
    whole = [[int(np.floor(256 * float(c))) for c in v] + [0] * (dim - len(v)) for *_, v in rows]
    label = [(x + 1) % 10 if i % 7 == 0 else x for i, x, _ in rows]
    out = []
    for k in (k for k, r in enumerate(rows) if r[0] % 100 == 0):
        score = [sum(a * b for a, b in zip(whole[k], w, strict=True)) for w in whole]
        order = sorted((m for m in range(len(rows)) if rows[m][0] != rows[k][0]), key=lambda m: (-score[m], rows[m][0]))
        for p in [m for m in order if label[m] == label[k]][:5]:
            fit = [m for m in order if label[m] != label[k] and 30 * score[p] <= 100 * score[m] <= 90 * score[p]][:10]
            out += [(rows[k][0], rows[p][0], r, rows[m][0], score[p], score[m]) for r, m in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_negatives(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), [float(v) for v in scale * (rng.normal(size=6) * 0.1 + i % 4)]) for i in range(900 if scale == 1 else 250)]
    rows += [(2000 + i, 1, [scale] * 6) for i in range(150)]  # ties
    rows += [(3000, None, [1.0] * 6), (3100, 1, None), (3200, 1, [None] * 6), (3300, 1, [float("nan")] * 6), (3400, 1, []), (3500, 2, [1.0, 2.0]), (None, 1, [1.0] * 6), (3600, 1, [1e308] * 6), (-100, 3, [-1.0] * 6)]
    table = spark.createDataFrame([*rows, rows[100], rows[100]], "vec_id long, label int, embedding array<double>").withColumns({"score": F.lit(1), "x": F.lit(2), "block": F.lit(3)})
    got = sorted(tuple(r) for r in negatives.mine(table, segment=256, block=4, pivots=5).collect())
    want = hard([r for r in rows if r[0] != 3600])
    assert got == want and len(want) > 100


def test_negatives_by_pruned_segments(spark):
    """Clusters far apart: a round reads few segments, and the result stays exact."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 4)) * 40
    rows = [(i, i % 3, [float(v) for v in centre[i % 12] + rng.normal(size=4) * 0.05]) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole = negatives.written(negatives.whole_numbers(table), "whole")
    index = negatives.Index(whole, F.col("vec_id") % 1000 == 0, 12, 512, 256, 1)
    spans = len(index.spans.value[0])
    asked = index.blocks.select(F.col("piece").alias("block"), F.lit(0).alias("place"), F.lit(0).alias("number"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"))
    best = negatives.search(index, asked, 5, same=True, first=2, widen=2)
    bars = best.where("rank = 5").select(F.shiftright("anchor", 16).alias("block"), F.lit(0).alias("place"), "number", F.col("score").alias("kth"))
    state = asked.join(bars, ["block", "place", "number"]).groupBy("block").agg(F.collect_list(F.struct("place", "number", "lo", "hi", "kth")).alias("state"))
    blocks = index.blocks.withColumnRenamed("piece", "block").join(state, "block")
    left = negatives.planned(index, blocks, 0, spans).count()
    assert left < 0.5 * blocks.count() * spans
    assert negatives.mine(table.limit(0)).count() == 0


def runs_of(w, copies=4, least=6):
    spans = {}
    for q in range(len(w) // 2, 0, -1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= 2 * q:
                spans[i, j + q - i] = q  # smaller periods last
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in spans.items() if n >= max(least, copies * q))


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]) for _ in range(rng.choice([0, 1, 2, 7, 40, 150]))]
            if w and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 9)
                w = [w[min(a + (i - a) % p, len(w) - 1)] if i >= a else x for i, x in enumerate(w)]
            texts.append(" ".join(w))
        copies, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        words = periodic.Words.of(pa.array(texts, pa.large_string()))
        for most in (3, 1 << 22):
            start, end, period = periodic.runs(words, copies, least, most)
            for k, text in enumerate(texts):
                low, high = words.first[k], words.first[k + 1]
                own = [(int(a - low), int(b - a), int(q)) for a, b, q in zip(start, end, period, strict=True) if low <= a < high]
                assert own == runs_of(text.split(), copies, least)


def test_words_are_cut_at_ascii_blanks():
    texts = ["", "  a\tb\x0bc\x0cd\r\ne  ", "a\xa0b  c", "x\x1cy\x1fz \x00", " "]
    words = periodic.Words.of(pa.array(texts, pa.large_string()))
    assert np.diff(words.first).tolist() == [len(t.encode().split()) for t in texts]
    assert [v.as_py() for v in words.text] == [w.decode() for t in texts for w in t.encode().split()]


def plain_report(doc, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    found = runs_of(w)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc, len(found), top[0], top[1], top[2], found and 1000 * top[1] // top[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_report(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 9000")
    odd = [(9001, None), (9002, ""), (9003, " \n "), (9004, "a b " * 40 + "end"), (9005, "x " * 50_000 + "end"), (None, "la la la la la la"), (9006, "é É é É é É é É"), (4, "one two"), (4, "one two")]
    table = base.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"start": F.lit("s"), "runs": F.lit(1)})
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, periodic.report(table).collect()), key=key)
    long = [r for r in got if r[0] == 9005]
    rest = [r for r in got if r[0] != 9005]
    assert rest == sorted((plain_report(r.doc_id, r.text) for r in table.collect() if r.doc_id != 9005), key=key)
    assert [r[1:6] for r in long] == [(1, 0, 50_000, 1, 50_000_000)] and sum(r[1] > 0 for r in rest) > 10
    assert periodic.report(table.limit(0)).count() == 0
    (row,) = periodic.found_in(table.where("doc_id = 9004")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 80, 2)] and row.collapsed == "a b end"

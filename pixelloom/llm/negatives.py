"""Hard negatives by one-dimensional distance keys: exact search of inner products within bounds.

Vectors become whole numbers, floor(256 x), and get one more component, sqrt(M^2 - |x|^2) with M the largest length, so that a
higher inner product with an anchor is a shorter distance from it. Each vector belongs to its nearest pivot; the
index holds them sorted by (pivot, distance to it), cut into segments, intervals of that key.

By the triangle inequality the segment [near, far] of a pivot at distance D from an anchor holds distances from max(near - D, D - far, 0) to
far + D only, so an anchor's k best scores within [lo, hi], an annulus around it, need those segments alone that can hold one
at least as good as its k-th so far. Rounds scan more and more segments, those of the best bounds first, `first` of
them and then `widen` times as many, until what is left can't change a result. Vectors whose distances tell little apart
are so scanned whole, in blocks of anchors against segments; the work is then the product of both.

First the positives, the best rows of the anchor's label, are searched without bounds; then the negatives of each, rows
of other labels within its score's bounds.

What is broadcast: pivots (at most `pivots`, from `sample` rows; they change plans, not results), bounds of segments (at most
MOST_SEGMENTS), and blocks of anchors while they are small; beyond, those are shuffled.

Defined results: rows with a null vec_id, label or vector, or a component that is null or not finite (256-fold, too), take no part; an empty vector is zero, a
shorter one ends in zeros; rows equal in vec_id, label and vector count once, others of one vec_id are rows of their own, but
an anchor's other rows have another vec_id; ties go to the smaller vec_id; an anchor without positives, or a
positive without negatives, gives no rows; no rows give no rows. Scores beyond 2^53 are reckoned in Python's whole numbers and kept
within a long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import beside, written
from pixelloom.llm.cover_tree import farthest_first

MOST_SEGMENTS = 1 << 20
LONG = (1 << 63) - 1
#: Of what a segment and a block of anchors are made.
ROWS = "vec_id long, label long, x binary, pivot int, d double"
#: A block asks for scores from lo to hi; kth is the last of k found already.
STATE = "array<struct<place:int,number:int,lo:long,hi:long,kth:long>>"


def whole_numbers(vectors: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, x (whole numbers as doubles), dim, norm (squared) and top (largest size) of the rows that take part; where vec_id is divisible by relabel, the label is the next of so many."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (odd[starts[1:]] == odd[starts[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(256 * values) + 0.0
                good &= np.array([np.isfinite(values[a:b]).all() for a, b in zip(starts[:-1], starts[1:], strict=True)], bool)
            parts = [values[a:b] if g else values[:0] for a, b, g in zip(starts[:-1], starts[1:], good, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(sizes), pa.array([float(p @ p) for p in parts], pa.float64()), pa.array([float(np.abs(p).max(initial=0)) for p in parts], pa.float64())]
            yield pa.record_batch(columns, names=["vec_id", "label", "x", "dim", "norm", "top"]).filter(pa.array(good))

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, label long, x binary, dim long, norm double, top double").dropDuplicates(["vec_id", "label", "x"])


def matrix(parts: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(parts), dim))
    for row, part in zip(out, parts, strict=True):
        row[: len(part) // 8] = np.frombuffer(part)
    return out


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def cut(rows: DataFrame, each: int, dim: int) -> DataFrame:
    """Written rows sorted by (pivot, d), at most so many of one pivot a piece: piece, pivot, near, far, n, and ids, labels and x of all as bytes."""

    def run(batches):
        held, number = [], 0

        def piece(parts):
            both = pa.Table.from_batches(parts)
            d, x = both["d"].to_numpy(), b"".join(p.ljust(8 * dim, b"\0") for p in both["x"].to_pylist())
            data = [both["part"][0].as_py() << 24 | number, both["pivot"][0].as_py(), float(d.min()), float(d.max()), len(d), both["vec_id"].to_numpy().tobytes(), both["label"].to_numpy().tobytes(), x]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(data, types, strict=True)], names=["piece", "pivot", "near", "far", "n", "ids", "labels", "x"])

        for batch in batches:
            pivots = batch.column(batch.schema.get_field_index("pivot")).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0]["pivot"][0].as_py() != pivots[a]:
                    yield piece(held)
                    held, number = [], number + 1
                while a < b:
                    take = min(b - a, each - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(h.num_rows for h in held) == each:
                        yield piece(held)
                        held, number = [], number + 1
        if held:
            yield piece(held)

    order = ["pivot", "d", "vec_id", "label", "x"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return written(dealt.mapInArrow(run, "piece long, pivot int, near double, far double, n int, ids binary, labels binary, x binary"), "pieces", compression="zstd")


class Index:
    """Segments of all rows and blocks of the anchors among them."""

    def __init__(self, rows: DataFrame, anchors, pivots: int, sample: int, segment: int, block: int):
        spark = rows.sparkSession
        size = rows.agg(F.count("*"), F.max("dim"), F.max("norm"), F.max("top")).first()
        self.total, self.dim, self.longest = size[0], size[1] or 0, size[2] or 0.0
        self.exact = self.dim * (size[3] or 0.0) ** 2 < 2**53
        drawn = rows.where(F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 20)) < min(1.0, 2 * sample / max(self.total, 1)) * (1 << 20)).limit(sample).union(rows.limit(1))
        centres = augmented(matrix([bytes(r["x"]) for r in drawn.select("x").collect()], self.dim), self.longest)
        centres = farthest_first(centres, max(1, min(pivots, self.total // 256))) if self.total else centres
        self.pivots = spark.sparkContext.broadcast(centres)
        dim, longest, shared = self.dim, self.longest, self.pivots

        def measure(batches):
            for batch in batches:
                for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                    d = between(augmented(matrix(part.column(2).to_pylist(), dim), longest), shared.value)
                    pivot = d.argmin(axis=1)
                    yield pa.record_batch([*part.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], names=[c.split()[0] for c in ROWS.split(", ")])

        keyed = rows.select("vec_id", "label", "x")
        each = max(256, min(segment, (4 << 20) // (8 * max(dim, 1))), self.total // MOST_SEGMENTS)
        self.segments = cut(keyed.mapInArrow(measure, ROWS), each, dim)
        self.blocks = cut(keyed.where(anchors).mapInArrow(measure, ROWS), block, dim)
        spans = self.segments.select("piece", "pivot", "near", "far").orderBy("piece").toPandas()
        self.spans = spark.sparkContext.broadcast([spans[c].to_numpy() for c in spans])


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products: exact as doubles where those can hold them, else whole numbers kept within a long."""
    if exact:
        return a @ b.T
    big = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    return np.array([[max(-LONG, min(LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in big[1]] for p in big[0]], np.int64).reshape(len(a), len(b))


def wanted(state: list[dict], kind) -> tuple[np.ndarray, ...]:
    """place, number, lo, hi and kth (lo where there is none) of what a block asks."""
    place, number = (np.array([s[c] for s in state], np.int64) for c in ("place", "number"))
    lo, hi = (np.array([s[c] for s in state], kind) for c in ("lo", "hi"))
    return place, number, lo, hi, np.array([s["lo"] if s["kth"] is None else max(s["kth"], s["lo"]) for s in state], kind)


def planned(index: Index, asking: DataFrame, begin: int, end: int) -> DataFrame:
    """(block, segment): for each block the segments of rank begin to end by their bounds that can still change a result."""
    dim, longest, pivots, spans = index.dim, index.longest, index.pivots, index.spans

    def run(batches):
        piece, pivot, near, far = spans.value
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"]).reshape(row["n"], -1) if dim else np.zeros((row["n"], 0))
                # an anchor is not augmented: its further component is 0
                away, own = between(np.column_stack([x, np.zeros(len(x))]), pivots.value), (x * x).sum(axis=1)
                place, _, _, hi, least = wanted(row["state"], np.float64)
                rank, open_ = np.zeros(len(piece)), np.zeros(len(piece), bool)
                some = max(1, (1 << 22) // max(len(piece), 1))
                for at in range(0, len(place), some):
                    who = place[at : at + some]
                    d, most = away[who][:, pivot], (longest + own[who])[:, None]
                    slack = 1 + 1e-6 * most
                    best = (most - np.maximum(np.maximum(near - d, d - far), 0) ** 2) / 2 + slack
                    worst = (most - (far + d) ** 2) / 2 - slack
                    open_ |= ((best >= least[at : at + some, None]) & (worst <= hi[at : at + some, None])).any(axis=0)
                    rank += np.minimum(best, hi[at : at + some, None]).sum(axis=0)
                order = np.argsort(-rank, kind="stable")[begin:end]
                chosen = piece[order[open_[order]]]
                yield pa.record_batch([pa.array(np.full(len(chosen), row["block"])), pa.array(chosen)], names=["block", "segment"])

    return asking.select("block", "n", "x", "state").mapInArrow(run, "block long, segment long")


def chosen(scores: np.ndarray, may: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row among those that may, ties by id."""
    many = np.flatnonzero(may.sum(axis=1) > 4 * k)
    if len(many):
        part = np.where(may[many], scores[many], scores.min() - 1)
        may[many] &= part >= np.partition(part, -k, axis=1)[:, -k, None]
    row, column = np.nonzero(may)
    by = np.lexsort([ids[column], -scores[row, column], row])
    row, column = row[by], column[by]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


FOUND = "anchor long, number int, id long, score long"


def scanned(index: Index, asking: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND: of each block and segment in pairs, the k best scores that each of the block's questions allows. same: of the anchor's label, else of others."""
    dim, exact = index.dim, index.exact

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                own, mine = (np.frombuffer(row[c], np.int64) for c in ("own_ids", "own_labels"))
                scores = products(*(np.frombuffer(row[c]).reshape(n, dim) for c, n in (("own_x", len(own)), ("x", len(ids)))), exact)
                place, number, _, hi, least = wanted(row["state"], scores.dtype)
                out = []
                for n in np.unique(number):
                    who = number == n
                    at, s = place[who], scores[place[who]]
                    fits = (labels == mine[at][:, None]) if same else (labels != mine[at][:, None])
                    fits &= (ids != own[at][:, None]) & (s >= least[who][:, None]) & (s <= hi[who][:, None])
                    i, j = chosen(s, fits, ids, k)
                    out.append((row["block"] << 16 | at[i], np.full(len(i), n), ids[j], s[i, j].astype(np.int64)))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    asked = pairs.groupBy("segment").agg(F.collect_list("block").alias("blocks"))
    near = index.segments.select(F.col("piece").alias("segment"), "ids", "labels", "x").join(beside(written(asked, "asked"), weight=F.size("blocks")), "segment")
    met = near.withColumn("block", F.explode("blocks")).drop("blocks").join(beside(asking, most=64 << 20, weight=F.length("own_x")), "block")
    return met.select("block", "ids", "labels", "x", "own_ids", "own_labels", "own_x", "state").mapInArrow(run, FOUND)


def search(index: Index, asked: DataFrame, k: int, same: bool, first: int = 4, widen: int = 8) -> DataFrame:
    """FOUND and rank: the k best for each row of asked (block, place, number, lo, hi)."""
    best, begin, end = None, 0, first
    ranked = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "id")
    blocks = index.blocks.select(F.col("piece").alias("block"), "n", F.col("ids").alias("own_ids"), F.col("labels").alias("own_labels"), F.col("x").alias("own_x"))
    while True:
        known = asked.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:
            full = best.where(F.col("rank") == k).select(F.shiftright("anchor", 16).alias("block"), F.col("anchor").bitwiseAND(0xFFFF).cast("int").alias("place"), "number", F.col("score").alias("kth"))
            known = asked.join(full, ["block", "place", "number"], "left")
        state = known.groupBy("block").agg(F.collect_list(F.struct("place", "number", "lo", "hi", "kth")).alias("state"))
        asking = written(blocks.join(state, "block"), "asking", rows=16)
        pairs = written(planned(index, asking.withColumn("x", F.col("own_x")), begin, end), "asks", rows=16)
        if best is not None and pairs.isEmpty():
            begin, end = end, max(end, len(index.spans.value[0]))
            pairs = written(planned(index, asking.withColumn("x", F.col("own_x")), begin, end), "asks", rows=16)
            if pairs.isEmpty():
                return best
        found = scanned(index, asking, pairs, k, same)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "best", rows=2)
        begin, end = end, end * widen


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = 64, sample: int = 4096, segment: int = 8192, block: int = 512) -> DataFrame:
    """RESULT: the hardest negatives of each anchor (vec_id divisible by every) and each of its positives, with scores from low to high hundredths of the positive's."""
    rows = written(whole_numbers(vectors), "whole", compression="zstd")
    index = Index(rows, F.col("vec_id") % every == 0, pivots, sample, segment, block)
    numbered = index.blocks.select(F.col("piece").alias("block"), F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place", "_")).drop("_")
    asked = numbered.select("block", "place", F.lit(0).alias("number"), F.lit(-LONG - 1).alias("lo"), F.lit(LONG).alias("hi"))
    near = search(index, asked, positives, same=True)
    place = F.col("anchor").bitwiseAND(0xFFFF).cast("int")
    score = F.col("score").cast("decimal(20,0)")
    bounds = near.select(F.shiftright("anchor", 16).alias("block"), place.alias("place"), F.col("rank").alias("number"), F.ceil(score * low / 100).cast("long").alias("lo"), F.floor(score * high / 100).cast("long").alias("hi"))
    found = search(index, written(bounds.where("lo <= hi"), "bounds"), negatives, same=False)
    names = index.blocks.select(F.col("piece").alias("block"), F.col("ids"), "n")

    def name(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array((row["block"] << 16) + np.arange(row["n"])), pa.array(np.frombuffer(row["ids"], np.int64))], names=["anchor", "anchor_id"])

    anchors = written(names.mapInArrow(name, "anchor long, anchor_id long"), "anchors")
    pairs = near.select("anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors, "anchor")
    named = found.select("anchor", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "number"])
    return named.select(*RESULT)

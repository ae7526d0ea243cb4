"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary documents, share their lowest
orders: the backoff distribution of a character pair is made from continuation counts of both
classes, so that expressions too rare for either class weigh the same in both. A word's evidence is the
log-likelihood ratio of its characters, normalised by length; a document's score is a logistic
function of its strongest words' evidence and of its whole length-normalised ratio, fitted on a fold
of labelled rows that the counts have not seen.

Labels are read from at most about `max_train` documents and `max_chars` signs of each class (parameters), chosen by hash of the
id; the model's tables are so bounded and broadcast. Whole texts of all documents are scored.
Defined results: a null or empty text gets the score of a text without evidence; rows that repeat a
document are scored on their own; a document with contradicting labels counts as toxic, and so does a text of documents with contradicting labels;
without labels of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import batches_of, code_points, crc_of, segment_sums, strings, written

TOP, SHARED = 6, 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(points: np.ndarray, starts: np.ndarray, order: int):
    """Lower-cased code points with blanks between words as 32, cut at texts' ends, and the hash of the `order` signs up to each place (0 where they reach over a word's start)."""
    low = points.astype(np.uint64)
    low += np.where(((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222) & (points != 215)), np.uint64(32), np.uint64(0))
    blank = (points <= 32) | (points == 160)
    low[blank] = 32
    fresh = blank.copy()
    fresh[starts[:-1][starts[:-1] < len(points)]] = True
    index = np.arange(len(points))
    since = index - np.maximum.accumulate(np.where(fresh, index, 0))  # signs since the blank or text's start
    keys = []
    key = np.zeros(len(points), np.uint64)
    for n in range(1, order + 1):
        shifted = np.concatenate([np.zeros(n - 1, np.uint64), low[: len(low) - n + 1]]) if n > 1 else low
        key = key + (shifted + np.uint64(1)) * np.uint64(pow(0x100000001B3, n, 1 << 64))
        keys.append(np.where(since >= n - 1, (key ^ (key >> np.uint64(29))) * MIX, np.uint64(0)))
    return since, keys


def counted(docs: DataFrame) -> DataFrame:
    """Order, place at a word's start, gram, context and suffix hashes and numbers of documents by class of all n-grams of docs (text, toxic): repeated lines add nothing."""

    def run(batches):
        for batch in batches_of(batches):
            points, starts = code_points(strings(batch))
            toxic = np.repeat(batch.column(1).to_numpy(), np.diff(starts))
            own = np.repeat(np.arange(len(starts) - 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.diff(starts))
            _, keys = grams(points, starts, TOP)
            for n in range(SHARED, TOP + 1):
                gram = keys[n - 1]
                inside = np.flatnonzero(gram != 0)
                inside = inside[np.unique(gram[inside] + own[inside], return_index=True)[1]]
                found, first, back = np.unique(gram[inside], return_index=True, return_inverse=True)
                first = inside[first]
                head = points[first - n + 1]
                # initial: nothing stands before a blank in its word; the context is the n - 1 signs before the last one; the suffix the last n - 1 signs
                context = keys[n - 2][first - 1]
                total, hot = np.bincount(back, minlength=len(found)), np.bincount(back, toxic[inside], len(found)).astype(np.int64)
                columns = [np.full(len(found), n, np.int32), (head <= 32) | (head == 160), found.view(np.int64), context.view(np.int64), keys[n - 2][first].view(np.int64), hot, total - hot]
                yield pa.record_batch([pa.array(c) for c in columns], names=["n", "initial", "gram", "context", "suffix", "toxic", "plain"])

    found = docs.select("text", "toxic").mapInArrow(run, "n int, initial boolean, gram long, context long, suffix long, toxic long, plain long")
    return found.groupBy("n", "gram").agg(F.first("initial").alias("initial"), F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, from the numbers of n-grams seen once to four times."""
    one, two, three, four = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
    y = one / (one + 2 * two)
    return np.clip([0, 1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three], [0, 0.3, 0.6, 0.9], [0, 0.95, 1.8, 2.7])


class KneserNey:
    """Log-likelihood ratios in backoff form: by order a sorted table of n-grams with their ratio, and one of contexts with the ratio of their backoff weights."""

    def __init__(self, rows: pa.Table):
        order = rows["n"].to_numpy()
        column = {c: rows[c].to_numpy() for c in ("initial", "gram", "context", "suffix", "toxic", "plain")}
        self.grams, self.contexts = [], []
        lower: dict | None = None
        for n in range(SHARED, TOP + 1):
            at = np.flatnonzero(order == n)
            at = at[np.argsort(column["gram"][at])]
            gram, context, suffix = (column[c][at] for c in ("gram", "context", "suffix"))
            counts = np.stack([column["toxic"][at], column["plain"][at]]).astype(float)
            if n < TOP:  # Kneser-Ney: below the top an n-gram counts once for each sign seen before it, but nothing stands before a word
                above = np.flatnonzero(order == n + 1)
                place = np.searchsorted(gram, column["suffix"][above])
                place = np.where(gram[np.minimum(place, len(gram) - 1)] == column["suffix"][above], place, -1) if len(gram) else place
                kinds = np.stack([np.bincount(place[(place >= 0) & (column[c][above] > 0)], minlength=len(gram)) for c in ("toxic", "plain")])
                counts = np.where(column["initial"][at], counts, np.maximum(kinds, counts > 0)).astype(float)
            if n == SHARED:
                counts = counts.sum(axis=0, keepdims=True).repeat(2, axis=0)
            contexts, back = np.unique(context, return_inverse=True)
            off = np.stack([discounts(c)[np.minimum(c, 3).astype(int)] for c in counts])
            total, held = (np.stack([np.bincount(back, x, len(contexts)) for x in y]) for y in (counts, off))
            rest = np.where(total > 0, held / np.maximum(total, 1), 1.0)
            if lower is None:
                below = np.full(counts.shape, 1 / 64)
            else:
                place = np.minimum(np.searchsorted(lower["gram"], suffix), len(lower["gram"]) - 1)
                below = lower["p"][:, place]
            p = (counts - off) / np.maximum(total[:, back], 1) + rest[:, back] * below
            self.grams.append((gram, np.log(p[0] / p[1]).astype(np.float32)))
            self.contexts.append((contexts, np.log(rest[0] / rest[1]).astype(np.float32)))
            lower = {"gram": gram, "p": p}

    def ratios(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio at each sign and the signs since its word's start."""
        since, keys = grams(points, starts, TOP)
        out = np.zeros(len(points), np.float32)
        for n, (gram, contexts) in enumerate(zip(self.grams, self.contexts, strict=True), SHARED):
            inside = np.flatnonzero(keys[n - 1] != 0)
            weight, _ = found_in(contexts, keys[n - 2][inside - 1].view(np.int64))
            value, there = found_in(gram, keys[n - 1][inside].view(np.int64))
            out[inside] = np.where(there, value, out[inside] + weight)
        return out, since


class Slots:
    """A fixed map of 64-bit keys to floats, looked up by arrays: open addressing by the keys' upper bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.float32)
        left, step = np.arange(len(keys)), 0
        home = self.home(keys)
        while len(left):
            slot = (home[left] + step) & ((1 << self.bits) - 1)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, step = left[~won], step + 1
        self.steps = step

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if absent) and whether each key is there."""
        slot = self.home(keys)
        seen = self.keys[slot]
        hit, value = seen == keys, self.values[slot]
        left, step = np.flatnonzero(~hit & (seen != 0)), 1
        value[~hit] = 0
        while len(left) and step < self.steps:
            slot = (self.home(keys[left]) + step) & ((1 << self.bits) - 1)
            seen = self.keys[slot]
            now = seen == keys[left]
            hit[left[now]], value[left[now]] = True, self.values[slot[now]]
            left, step = left[~now & (seen != 0)], step + 1
        return value, hit


def found_in(slots: Slots, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return slots.get(keys)


def features(model: KneserNey, texts: pa.Array) -> np.ndarray:
    """For each text: the strongest word's evidence, the second's, log of the number of strong words, the whole text's ratio by length."""
    points, starts = code_points(texts)
    out = np.zeros((len(texts), 4))
    if not len(points):
        return out
    ratio, since = model.ratios(points, starts)
    words = np.flatnonzero(since == 0)
    of_text = np.searchsorted(starts, words, "right") - 1
    sums = np.add.reduceat(ratio, words, dtype=np.float64)
    evidence = sums / np.sqrt(np.diff(words, append=len(points)) + 4)
    count = np.bincount(of_text, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(count)])
    full = np.flatnonzero(count)
    best = np.zeros(len(texts))
    best[full] = np.maximum.reduceat(evidence, begin[full])
    order = np.where(evidence >= best[of_text], -np.inf, evidence)
    # a strongest word that occurs twice is its own second
    twice = np.bincount(of_text, evidence >= best[of_text], len(texts)) > 1
    second = np.zeros(len(texts))
    second[full] = np.maximum.reduceat(order, begin[full])
    out[:, 0], out[:, 1] = np.maximum(best, 0), np.where(twice, best, np.maximum(second, 0))
    out[:, 2] = np.log1p(np.bincount(of_text, evidence > 2.0, len(texts)))
    out[:, 3] = segment_sums(ratio, starts) / np.maximum(np.diff(starts), 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 6_000, max_chars: int = 32_000_000, threshold: float = 0.3, words: bool = True) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), score and predicted for each row of docs. words: False scores by the whole text's length-normalised ratio alone."""
    spark = docs.sparkSession
    fold = F.pmod(crc_of(), F.lit(4))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 2)
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, max_train / max(1, sizes.get(k, 0)))))])
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < F.try_element_at(share, F.col("toxic")) * (1 << 20))
    # about 2 * max_train ids at most, so that texts need not be shuffled to meet them
    chosen = F.broadcast(written(chosen, "chosen"))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))
    sample = written(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "sample")
    sizes_of = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    parts = {k: min(1.0, max_chars / max(1, sizes_of.get(k) or 1)) for k in (0, 1)}
    part = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(parts[k]))])
    sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("chars")), F.lit(1 << 20)) < F.try_element_at(part, F.col("toxic").cast("int")) * (1 << 20))
    rows = counted(sample.where(fold != 1)).toArrow()
    learned = bool(rows.num_rows) and {0, 1} <= set(sizes)
    model, weights = None, None
    if learned:
        model = KneserNey(rows)
        model.grams = [Slots(*x) for x in model.grams]
        model.contexts = [Slots(*x) for x in model.contexts]
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches_of(batches):
            x = features(shared.value, strings(batch))
            yield pa.record_batch([batch.column(1), *(pa.array(c) for c in x.T)], names=["y", "a", "b", "c", "d"])

    if learned:
        seen = sample.where(fold == 1).select("text", F.col("toxic").cast("double").alias("y")).mapInArrow(measure, "y double, a double, b double, c double, d double").toArrow()
        x = np.column_stack([seen[c].to_numpy() for c in "abcd"])
        x[:, :3] *= words
        weights = logistic(x, seen["y"].to_numpy()) if len(x) else np.array([1.0, 0, 0, 0, -4.0])
        if len(x):  # the sample's classes stand in another proportion than the labels': correct the constant
            drawn = {k: min(1.0, max_train / max(1, sizes[k])) * parts[k] for k in (0, 1)}
            weights[-1] += np.log(drawn[0] / drawn[1])

    def apply(batches):
        for batch in batches_of(batches):
            texts = strings(batch)
            score = np.zeros(len(texts))
            if learned:
                score = 1 / (1 + np.exp(-np.clip(features(shared.value, texts) @ weights[:-1] + weights[-1], -700, 700)))
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""A hashed maximum-entropy language model with n-gram and skip features and a class-factored softmax.

Words are runs without ASCII white space, A-Z made small, and an end sign follows each text. The most frequent words
(and the end sign) fall into classes of about equal mass; all other words, unseen ones too, fall into tail classes by a
hash of their last two bytes. The model is P(class | context) * P(word | class, context), where the context is
three hashed features: the word before, the two words before, and the word before those skipping one. Tail words have
their share of their class by counts, context-free. Weights start at zero over count priors and are trained
by distributed updates: in each round tasks sum, for each feature bucket, how often each outcome came and was
expected on their part of the training texts; Spark adds the sums up; the weights take a damped iterative-scaling step.
Every training text is in just one round. In each tail class one further outcome of count 0 stands for all unseen words of
the class, so that the outcomes sum to 1.

What grows with the corpus is the counts, a row for each distinct word. The contexts' weights are hashed into a table of fixed size, which
is broadcast: weights for each distinct n-gram would have to be joined with the texts' tokens, which moves several times the texts' own
size (README has the figures of that attempt).

Counts cover all training texts: word hashes (60 bits, with the tail class in the last 4) are counted by tasks and
summed by Spark. The `common` most frequent counts are broadcast, at most that many rows; rarer words of a text are
joined with their counts by shuffle. Two words of one hash would count as one; at 10^9 words that is to be expected for less than one pair.

Defined results: a null text is an empty one, with its end sign; rows that repeat a document are scored and counted
each; a null doc_id is in the training part; without training texts every count is 0 and a token has the share of its class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import BASE, batches_of, crc_of, lowered, mixed, ranged_hashes, segment_sums, strings, utf8, word_ranges, written

HEADS, SLOTS, TAILS = 16, 32, 16
CLASSES = HEADS + TAILS
BUCKETS, FEATURES = 4096, 3
END = np.uint64(TAILS)  # a hash no word has: tail class 0 and upper bits 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts and their end signs, and the first of each text, with the total at the end."""
    raw, starts = utf8(texts)
    begin, end, first = word_ranges(raw, starts)
    low = lowered(raw).astype(np.uint64)
    last, second = low[end - 1], low[np.maximum(end - 2, begin)]
    tail = ((last * np.uint64(31) + second) * np.uint64(BASE)) >> np.uint64(60)
    keys = (ranged_hashes(low + np.uint64(1), begin, end) & ~np.uint64(TAILS - 1)) | tail
    return np.insert(keys, first[1:], END), first + np.arange(len(first))


class Lookup:
    """Places of known keys, by the keys' upper bits and open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.keys = keys
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]
            step += 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if unknown."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        for step in range(self.steps):
            at = self.slots[self._slot(keys[left], step)]
            hit = (at >= 0) & (self.keys[np.maximum(at, 0)] == keys[left])
            out[left[hit]] = at[hit]
            left = left[~hit & (at >= 0)]
            if not len(left):
                break
        return out


class Model:
    """What tasks need: common words with counts, classes and slots, priors and weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray):
        order = np.lexsort((keys, -counts))
        self.lookup, self.counts = Lookup(keys[order]), counts[order]
        heads = min(HEADS * SLOTS, len(keys))
        mass = self.counts[:heads] + 0.5
        # classes of about equal mass: each word, by falling count, to the lightest class with a free slot
        self.head_class, self.head_slot = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        weight, used = np.zeros(HEADS), np.zeros(HEADS, np.int64)
        prior = np.full((HEADS, SLOTS), -np.inf, np.float32)
        for i in range(heads):
            c = int(np.where(used < SLOTS, weight, np.inf).argmin())
            self.head_class[i], self.head_slot[i] = c, used[c]
            prior[c, used[c]] = np.log(mass[i])
            weight[c], used[c] = weight[c] + mass[i], used[c] + 1
        with np.errstate(divide="ignore"):
            self.slot_prior = np.where(weight[:, None] > 0, prior - np.log(np.maximum(weight, 1e-9))[:, None], prior).astype(np.float32)
            total = np.concatenate([weight, tail_mass])
            self.class_prior = np.log(total / total.sum()).astype(np.float32)
        self.tail_mass = tail_mass
        self.class_weights = np.zeros((FEATURES, BUCKETS, CLASSES), np.float32)
        self.slot_weights = np.zeros((FEATURES, BUCKETS, SLOTS), np.float32)

    def features(self, keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The bucket of each feature at each token; before a text stand end signs."""
        place = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
        back = [np.where(place >= k, np.roll(keys, k), END) for k in (1, 2)]
        raw = (back[0], back[0] * np.uint64(3) + mixed(back[1]), back[1] + np.uint64(1))
        return [(mixed(x + np.uint64(n)) >> np.uint64(52)).astype(np.int64) for n, x in enumerate(raw)]

    def outcome(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the common words (or -1) and class of each token."""
        known = self.lookup.get(keys)
        head = np.where(known >= 0, self.head_class[np.maximum(known, 0)] if len(self.head_class) else -1, -1)
        return known, np.where(head >= 0, head, HEADS + (keys & np.uint64(TAILS - 1)).astype(np.int64))

    def class_logs(self, buckets: list[np.ndarray]) -> np.ndarray:
        z = self.class_prior + sum(self.class_weights[f][b] for f, b in enumerate(buckets))
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def slot_buckets(self, buckets: list[np.ndarray], of_class: np.ndarray) -> list[np.ndarray]:
        return [(b * 31 + of_class * 127) & (BUCKETS - 1) for b in buckets]

    def slot_logs(self, buckets: list[np.ndarray], of_class: np.ndarray) -> np.ndarray:
        z = self.slot_prior[of_class] + sum(self.slot_weights[f][b] for f, b in enumerate(buckets))
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def pieces(keys: np.ndarray, first: np.ndarray, buckets: list[np.ndarray], size: int = 1 << 15):
    for a in range(0, len(keys), size):
        yield slice(a, a + size), [b[a : a + size] for b in buckets]


def sums_by(buckets: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(buckets, kind="stable")
    found, start = np.unique(buckets[order], return_index=True)
    into[found] += np.add.reduceat(values[order], start, axis=0)


def gradient(model: Model, keys: np.ndarray, first: np.ndarray, seen: list[np.ndarray], expected: list[np.ndarray]) -> None:
    """Adds a batch's outcomes and expectations by feature bucket: for classes, then for slots."""
    buckets = model.features(keys, first)
    known, of_class = model.outcome(keys)
    for part, own in pieces(keys, first, buckets):
        p = np.exp(model.class_logs(own))
        c = of_class[part]
        for f, b in enumerate(own):
            sums_by(b, p, expected[0][f])
            seen[0][f] += np.bincount(b * CLASSES + c, minlength=BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)
        heads = np.flatnonzero(c < HEADS)
        if len(heads):
            within = model.slot_buckets([b[heads] for b in own], c[heads])
            p = np.exp(model.slot_logs(within, c[heads]))
            slot = model.head_slot[known[part][heads]]
            for f, b in enumerate(within):
                sums_by(b, p, expected[1][f])
                seen[1][f] += np.bincount(b * SLOTS + slot, minlength=BUCKETS * SLOTS).reshape(BUCKETS, SLOTS)


def train(texts: DataFrame, model: Model, rounds: int, damping: float = 20.0) -> None:
    """texts: text and round, each text in one round. Sums travel as half floats by blocks of buckets."""
    spark = texts.sparkSession
    blocks = 8

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            seen = [np.zeros((FEATURES, BUCKETS, n), np.float32) for n in (CLASSES, SLOTS)]
            expected = [np.zeros_like(x) for x in seen]
            some = False
            for batch in batches_of(batches):
                gradient(shared.value, *tokens(strings(batch)), seen, expected)
                some = some or batch.num_rows > 0
            if some:
                kinds = [*seen, *expected]
                for k, x in enumerate(kinds):
                    for f in range(FEATURES):
                        for i, part in enumerate(np.split(x[f], blocks)):
                            scale = max(1.0, float(part.max()) / 6e4)
                            yield pa.record_batch([pa.array([(k * FEATURES + f) * blocks + i], pa.int32()), pa.array([scale]), pa.array([(part / scale).astype(np.float16).tobytes()], pa.binary())], names=["block", "scale", "sums"])

        part = texts.where(F.col("round") == turn).select("text").mapInArrow(run, "block int, scale double, sums binary")
        # two steps, so that no task adds up what all tasks of a large job have sent
        salted = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
        half = salted.groupBy("block", "salt").applyInPandas(add16, "block int, sums binary")
        rows = half.groupBy("block").applyInPandas(add32, "block int, sums binary").toPandas()
        if not len(rows):
            continue
        done = {int(b): np.frombuffer(x, np.float32) for b, x in zip(rows.block, rows.sums, strict=True)}
        for k, weights in enumerate((model.class_weights, model.slot_weights)):
            width = weights.shape[2]
            for f in range(FEATURES):
                seen, expected = (np.concatenate([done[((k + 2 * e) * FEATURES + f) * blocks + i] for i in range(blocks)]).reshape(BUCKETS, width) for e in (0, 1))
                share = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-9)
                weights[f] += np.log((seen + damping * share + 1e-3) / (expected + damping * share + 1e-3)) / FEATURES * 1.5
        shared.unpersist()


def add16(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float16).astype(np.float64) * s for x, s in zip(rows.sums, rows.scale, strict=True))
    return pd.DataFrame({"block": rows.block.iloc[:1], "sums": [total.astype(np.float32).tobytes()]})


def add32(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.sums)
    return pd.DataFrame({"block": rows.block.iloc[:1], "sums": [total.astype(np.float32).tobytes()]})


def counted(texts: DataFrame) -> DataFrame:
    """(key, n) of all tokens of texts."""

    def run(batches):
        for batch in batches_of(batches, 8 << 20):
            keys, n = np.unique(np.concatenate([tokens(strings(part))[0] for part in batches_of([batch])]), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, common: int = 1 << 18, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs; scores in log10."""
    spark = docs.sparkSession
    fold = F.pmod(crc_of(), F.lit(5))
    training = docs.where(fold != 1).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("round"))
    counts = written(counted(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # how many words are as frequent as that: by eighths of powers of two, so a few hundred rows
    scale = F.floor(F.log2("n") * 8).cast("int")
    least, so_far = 0, 0
    for r in counts.groupBy(scale.alias("e")).agg(F.count("*").alias("words")).orderBy(F.desc("e")).collect():
        so_far += r["words"]
        if so_far > common:
            least = r["e"] + 1
            break
    top = counts.where(scale >= least).toArrow()
    keys, number = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    tails = {r["c"]: r["m"] for r in counts.groupBy(F.col("key").bitwiseAND(TAILS - 1).alias("c")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect()}
    mass = np.array([tails.get(c, 0.0) for c in range(TAILS)]) + 0.5  # the unseen word of each class
    model = Model(keys, number, np.ones(TAILS))
    heads = model.head_class >= 0
    np.subtract.at(mass, (model.lookup.keys[heads] & np.uint64(TAILS - 1)).astype(np.int64), model.counts[heads] + 0.5)
    mass = np.maximum(mass, 0.5)
    model = Model(keys, number, mass)
    train(training, model, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        to_ten = 1 / np.log(10)
        for batch in batches_of(batches):
            keys, first = tokens(strings(batch))
            buckets = m.features(keys, first)
            known, of_class = m.outcome(keys)
            logs, base = np.zeros(len(keys)), np.zeros(len(keys))
            seen = known >= 0
            count = np.log(m.counts[np.maximum(known, 0)] + 0.5) if len(m.counts) else base
            base[seen] = count[seen]
            for part, own in pieces(keys, first, buckets):
                c, k = of_class[part], known[part]
                logs[part] = np.take_along_axis(m.class_logs(own), c[:, None], 1)[:, 0]
                heads = np.flatnonzero(c < HEADS)
                if len(heads):
                    within = m.slot_logs(m.slot_buckets([b[heads] for b in own], c[heads]), c[heads])
                    logs[part.start + heads] += within[np.arange(len(heads)), m.head_slot[k[heads]]]
            tail = of_class >= HEADS
            logs[tail] -= np.log(m.tail_mass[of_class[tail] - HEADS])
            logs[tail & seen] += count[tail & seen]
            rare = [np.unique(keys[a:b][~seen[a:b]], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(segment_sums(seen.astype(float), first).astype(np.int64)), pa.array(segment_sums(base, first) * to_ten), pa.array(segment_sums(logs, first) * to_ten)]
            columns += [pa.array([x.view(np.int64) for x, _ in rare], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in rare], pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["doc_id", "row", "n_tokens", "known", "base", "logs", "rare", "times"])

    scored = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    scored = written(scored.mapInArrow(run, "doc_id long, row long, n_tokens long, known long, base double, logs double, rare array<long>, times array<int>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest = rare.join(counts.where(scale < least), "key", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("rest"))
    both = scored.drop("rare", "times").join(rest, "row", "left")
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    rest = F.coalesce("rest", F.lit(0.0))
    return both.select(
        "doc_id", (fold == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("logs") + rest).alias("score"),
    )

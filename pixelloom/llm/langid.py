"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams per language are made by tasks and summed by Spark; the log-probability
matrix (languages x buckets) is broadcast, and texts are scored by batches as a
sparse product: each n-gram of a text is one entry of its row.

Training uses about `max_train` documents, spread evenly over the languages by hash of the id, but at least
`least_each` of each language that has them; every label is learned, and the bounds on rows are parameters. Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text when nothing was learned;
ties go to the first language in order of name; rows that repeat a document are scored on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pixelloom.llm.common import KEY, batches_of, code_points, crc_of, joined_by_key, keyed, segment_sums, strings, written

ORDERS = (1, 2, 3)
#: Bytes of text that a task works on at once; its arrays take some 60 times as many.
PIECE = 1 << 18


def hashed_ngrams(points: np.ndarray, starts: np.ndarray, bits: int):
    """For each order: the bucket of the n-gram that starts at each code point, and whether it lies within one text. Capitals of Latin letters count as small ones."""
    low = points.astype(np.uint64)
    low += np.where(((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222) & (points != 215)), np.uint64(32), np.uint64(0))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(points))
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = key * np.uint64(0x100000001B3)
        key[: len(key) - n + 1] += low[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            yield ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32), left >= n


def train(docs: DataFrame, label: str = "lang", fold=None, bits: int = 15, max_train: int = 20_000, least_each: int = 312, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their log-probability matrix (buckets x languages). fold: a condition on the rows to learn from."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.where(fold) if fold is not None else rows
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return [], np.zeros((1 << bits, 0), np.float32)
    names = sorted(r[label] for r in counts)
    each = max(max_train / len(names), least_each)
    share = F.create_map(*[x for r in counts for x in (F.lit(r[label]), F.lit(min(1.0, each / r["count"])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < F.try_element_at(share, F.col(label)) * (1 << 20))

    def count(batches):
        for batch in batches_of(batches, PIECE):
            points, starts = code_points(strings(batch))
            which = pc.index_in(batch.column(1), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            lang = np.repeat(which, np.diff(starts))
            for bucket, inside in hashed_ngrams(points, starts, bits):
                key, n = np.unique((lang << bits | bucket)[inside], return_counts=True)
                yield pa.record_batch([pa.array((key >> bits).astype(np.int32)), pa.array((key & (1 << bits) - 1).astype(np.int32)), pa.array(n.astype(np.int64))], names=["k", "bucket", "n"])

    summed = sample.select("text", label).mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.full((len(names), 1 << bits), smoothing)
    n[summed["k"].to_numpy(), summed["bucket"].to_numpy()] += summed["n"].to_numpy()
    return names, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, keep: list[str], extra: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, with the predicted language and its score, its posterior under equal priors, under the names `extra`."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(matrix)
    bits = matrix.shape[1].bit_length() - 1
    place = (*keep, "text") if "text" not in keep else tuple(keep)

    def score(batches):
        logs = model.value
        for batch in batches_of(batches, PIECE):
            texts = strings(batch)
            points, starts = code_points(texts)
            sums = np.zeros((len(texts), len(names)))
            for bucket, inside in hashed_ngrams(points, starts, bits) if names else ():
                for k in range(len(names)):
                    sums[:, k] += segment_sums(np.where(inside, logs[k][bucket], np.float32(0)), starts)
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            best = sums.argmax(axis=1) if names else np.zeros(len(texts), int)
            odds = np.exp(sums - sums.max(axis=1, keepdims=True)) if names else np.ones((len(texts), 1))
            pred = np.where(lettered, np.array([*names, ""], object)[best], "und")
            yield pa.record_batch([*(batch.column(place.index(c)) for c in keep), pa.array(pred, pa.string()), pa.array(np.where(lettered, 1 / odds.sum(axis=1), 0.0))], names=[*keep, *extra])

    chosen = docs.select(*place)
    fields = [f for f in chosen.schema if f.name in keep]
    return chosen.mapInArrow(score, StructType([*fields, StructField(extra[0], StringType()), StructField(extra[1], DoubleType())]))


def identify(docs: DataFrame, keep: list[str] | None = None, extra: tuple[str, str] = ("lang_pred", "score"), **options) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 3 is not 1 and predicts all rows; held_out marks the rest. extra: names of the new columns, for tables that have such names already."""
    fold = F.pmod(crc_of(), F.lit(3)) != 1
    names, matrix = train(docs, fold=fold & F.col("doc_id").isNotNull(), **options)
    scored = predict(docs, names, matrix, keep or ["doc_id"], extra)
    return scored.withColumn("held_out", ~fold) if "held_out" not in scored.columns else scored


def with_language(docs: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """docs without the rows that have no language (`und`) or whose likeliest one scores below `least`; all columns stay.

    Texts go to Python but don't come back: what returns are the keys of rows to leave out, written and joined with docs. Rows of equal text have equal scores, so a key stands for all of them.
    """
    fold = F.pmod(crc_of(), F.lit(3)) != 1
    names, matrix = train(docs, fold=fold & F.col("doc_id").isNotNull(), **options)
    scored = predict(keyed(docs), names, matrix, KEY)
    gone = written(scored.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(*KEY).distinct(), "no_language")
    return joined_by_key(docs, gone, "left_anti")[0].select(*docs.columns)

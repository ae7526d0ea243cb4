"""Shards by a two-pass external shuffle, with DataFrame functions only.

First pass: a seeded hash of each row scatters rows uniformly into buckets of about `bucket_bytes` of text, a partition
each. Second pass: each bucket is brought into the order of a second hash, so that it doesn't matter how it arrived,
shuffled in memory by Spark's shuffle(), a seeded Fisher-Yates shuffle of an array, and written. Buckets one after
another are the shuffled table; shard s of n holds the rows at floor(s * rows / n) and on, so counts differ by one at
most (law `rows`). A bucket's seed is the seed and its number, so the same rows give the same shards, however they are partitioned.

Texts are shuffled once. Rows with one doc_id and text have one hash; where such repeats alone would fill an eighth of a
bucket, they are dealt by their place in the input too, which a table read from files gives alike at every attempt. There are at most
eight such texts a bucket, so their hashes are few.

Memory: a task holds one bucket. Buckets grow beyond `bucket_bytes` where there would be more than MOST_BUCKETS, up to
LARGEST bytes; a text beyond that needs its own length.

Defined results: a null text counts no bytes and stays null; null doc_ids, repeated rows and equal texts are rows like any other; no
rows give no rows; other columns are kept, and names of ours that a table has already get signs added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import beside, fresh, written

MOST_BUCKETS, LARGEST = 65_536, 1 << 30


def text_bytes():
    """UTF-8 bytes of the text (null: none) and 1."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def buckets_for(total: int, bucket_bytes: int) -> tuple[int, int]:
    """Number of buckets, and the bytes of one."""
    each = max(bucket_bytes, min(LARGEST, -(-total // MOST_BUCKETS)))
    return max(1, -(-total // each)), each


def shuffled(docs: DataFrame, seed: int = 0, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, str, str]:
    """The written table of all rows of docs in shuffled order, and the names of its columns for the bucket and the place within it."""
    bucket, place, mark, size, hot, rows, row = fresh(docs, "bucket", "place", "_mark", "_size", "_hot", "_rows", "_row")
    marked = docs.withColumns({mark: F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.isnull("doc_id"), F.coalesce("text", F.lit("")))})
    copies = written(marked.select(mark, text_bytes().alias(size)).groupBy(mark).agg(F.sum(size).alias(size), F.count("*").alias(rows)), "copies")
    n, each = buckets_for(copies.agg(F.sum(size)).first()[0] or 0, bucket_bytes)
    many = written(copies.where((F.col(rows) > 1) & (F.col(size) > each / 8)).select(F.col(mark).alias(hot)), "repeats")
    salt = F.lit(0).cast("long")
    if not many.isEmpty():
        marked = marked.withColumn(rows, F.monotonically_increasing_id()).join(beside(many), F.col(mark) == F.col(hot), "left")
        salt = F.when(F.col(hot).isNotNull(), F.col(rows)).otherwise(salt)
    dealt = marked.withColumn(bucket, F.pmod(F.xxhash64(mark, salt), F.lit(n)).cast("int"))
    kept = F.struct(*(F.col(c) for c in docs.columns)).alias(row)
    ordered = dealt.select(bucket, mark, kept).repartitionById(n, F.col(bucket)).sortWithinPartitions(bucket, F.xxhash64(mark, F.lit(seed)), mark, f"{row}.doc_id")
    whole = ordered.groupBy(bucket).agg(F.collect_list(row).alias(row)).select(bucket, F.shuffle(F.col(row), seed).alias(row))
    return written(whole.select(bucket, F.posexplode(row).alias(place, row)).select(bucket, place, f"{row}.*"), "shuffled", compression="zstd"), bucket, place


def shards(docs: DataFrame, count: int, seed: int = 0, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows of docs with shard (0 to count - 1) and slot (from 0 without gaps in each shard)."""
    table, bucket, place = shuffled(docs, seed, bucket_bytes)
    sizes = table.groupBy(bucket).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(bucket))  # a row a bucket
    first, of, shard, slot = fresh(table, "_first", "_of", "shard", "slot")
    starts = written(sizes.select(F.col(bucket).alias(of), (upto - F.col("n")).alias(first)), "starts")
    total = table.count()
    at = (F.col(first) + F.col(place)).cast("long")
    number = F.expr(f"((`{first}` + `{place}`) * {count}) div {max(total, 1)}")
    begin = F.expr(f"(`{shard}` * cast({total} as bigint) + {count - 1}) div {count}")
    named = table.join(beside(starts), F.col(bucket) == F.col(of)).withColumn(shard, number.cast("int"))
    return named.withColumn(slot, at - begin).select(*docs.columns, shard, slot)


def save(docs: DataFrame, path: str, count: int, **options) -> DataFrame:
    """Writes the shards as folders shard=0 and on, and reads them back; docs has no columns shard and slot of its own."""
    shards(docs, count, **options).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def report(docs: DataFrame, count: int = 8, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not `key`) of each row."""
    own = docs.select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return shards(own, count, **options).select("doc_id", text_bytes().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

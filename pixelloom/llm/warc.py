"""Merkle fixity audit of WARC replicas, with DataFrame functions.

A replica is a table of records in segments, each with its offset range and the hash of its bytes; bytes are hashed where they are read, and only hashes
move. Leaves hash a record with its offset range; nodes hash their children in order, FAN at a time, up to one node a segment and
on to one root. The audit compares the roots and descends only into nodes that differ; what is left at the bottom
are the records that are corrupt, missing or extra. Offsets are prefix sums in two steps, over groups of a segment's records and
within a group, so that a segment of very many records is no single task's.

Defined results: null url or html count as empty; pages with a null page_id go to segment -1 in order of their
hash, and rows that repeat a page_id follow each other there likewise; two empty replicas agree; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import written

FAN = 16


def records(pages: DataFrame, per_segment: int = 256, version: Column | None = None) -> DataFrame:
    """WARC response records of pages: segment, seq (place in the segment), page_id, record_offset, size, record_sha. version: what a record begins with."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0") if version is None else version, F.lit("\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )
    segment = F.coalesce(F.floor(F.col("page_id") / per_segment), F.lit(-1)).cast("long")
    rows = pages.select(segment.alias("segment"), "page_id", F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("record_sha"))
    # groups in order of page_id and hash; equal records are dealt, as their order is free
    key = ["segment", "page_id", "part", "salt"]
    rows = written(rows.withColumn("part", F.substring("record_sha", 1, 2)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16))), "records")
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("segment").orderBy("page_id", "part", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("first", F.sum("n").over(earlier) - F.col("n")).withColumn("base", F.sum("bytes").over(earlier) - F.col("bytes"))
    same = reduce(lambda x, y: x & y, [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    both = rows.alias("r").join(groups.select(*key, "first", "base").alias("g"), same).select("r.*", "first", "base")
    order = Window.partitionBy(*key).orderBy("record_sha")
    offset = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return both.select("segment", (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("seq"), "page_id", (F.col("base") + offset).alias("record_offset"), "size", "record_sha")


def leaves(replica: DataFrame) -> DataFrame:
    """The replica's leaves: segment, seq, page_id, record_offset, size, digest."""
    return replica.select("segment", "seq", "page_id", "record_offset", "size", F.sha2(F.concat_ws(":", "record_offset", "size", "record_sha"), 256).alias("digest"))


def over(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (key, digest) over children (key, place, digest), FAN each at most."""
    return nodes.groupBy(*key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))


def depth(most: int) -> int:
    """Levels of FAN until numbers up to `most` are one."""
    levels = 1
    while FAN**levels <= most:
        levels += 1
    return levels


def within(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (segment, node, digest) of the levels within segments, the leaves first: node is seq by powers of FAN."""
    out = [leaf.select("segment", F.col("seq").alias("node"), "digest")]
    for _ in range(levels):
        out.append(written(over(out[-1].select("segment", F.floor(F.col("node") / FAN).alias("up"), F.col("node").alias("place"), "digest"), ["segment", "up"]).withColumnRenamed("up", "node"), "nodes"))
    return out


def above(segments: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (node, digest) from the segments up to the root."""
    out = [segments.select(F.col("segment").alias("node"), "digest")]
    for _ in range(levels):
        out.append(written(over(out[-1].select(F.floor(F.col("node") / FAN).alias("up"), F.col("node").alias("place"), "digest"), ["up"]).withColumnRenamed("up", "node"), "nodes"))
    return out


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes whose digests differ or that one side lacks."""
    both = a.select(*keys, F.col("digest").alias("digest_a")).join(b.select(*keys, F.col("digest").alias("digest_b")), keys, "full")
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def audit(good: DataFrame, other: DataFrame) -> DataFrame:
    """Records in which two replicas differ: segment, seq, page_id, record_offset, size, status (corrupt, missing or extra in the second), digests."""
    left, right = written(leaves(good), "leaves"), written(leaves(other), "leaves")
    ends = left.unionByName(right).agg(F.max("segment"), F.abs(F.min("segment")), F.max("seq")).first()
    inner, outer = depth(ends[2] or 0), depth(max(ends[0] or 0, ends[1] or 0))
    low = [within(x, inner) for x in (left, right)]
    high = [above(x[-1], outer) for x in low]
    bad = differing(high[0][-1], high[1][-1], ["node"]).select("node")
    for level in range(outer - 1, -1, -1):
        a, b = (t[level].join(bad.select(F.col("node").alias("up")), F.floor(F.col("node") / FAN) == F.col("up"), "left_semi") for t in high)
        bad = written(differing(a, b, ["node"]).select("node"), "bad")
    bad = bad.select(F.col("node").alias("segment"), F.lit(0).cast("long").alias("node"))
    for level in range(inner - 1, -1, -1):
        up = bad.select(F.col("segment").alias("at"), F.col("node").alias("up"))
        a, b = (t[level].join(up, (F.col("segment") == F.col("at")) & (F.floor(F.col("node") / FAN) == F.col("up")), "left_semi") for t in low)
        bad = written(differing(a, b, ["segment", "node"]).select("segment", "node"), "bad")
    keys = ["segment", "seq"]
    a, b = (x.join(bad.withColumnRenamed("node", "seq"), keys, "left_semi") for x in (left, right))
    b = b.select(*keys, F.col("page_id").alias("page_b"), F.col("record_offset").alias("offset_b"), F.col("size").alias("size_b"), F.col("digest").alias("digest_b"))
    both = a.withColumnRenamed("digest", "digest_a").join(b, keys, "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return both.select(*keys, F.coalesce("page_id", "page_b").alias("page_id"), F.coalesce("record_offset", "offset_b").alias("record_offset"), F.coalesce("size", "size_b").alias("size"), status.alias("status"), "digest_a", "digest_b")


def damaged(pages: DataFrame) -> DataFrame:
    """The records of a second replica for trials: each 97th page's record has one byte changed, each 389th page's record is lost."""
    marked = F.coalesce(F.pmod("page_id", F.lit(97)) == 5, F.lit(False))
    replica = records(pages, version=F.when(marked, "WARC/1.1").otherwise("WARC/1.0"))
    return replica.where(F.coalesce(F.pmod("page_id", F.lit(389)) != 7, F.lit(True)))

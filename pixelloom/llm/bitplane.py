"""Token ids as bit planes: fixed-size blocks of ids, transposed, each plane under zstandard, with a chunk index.

File format: a Parquet folder with one row a block. Columns: shard and block number, first id of the
block within its shard, number of ids, `planes` (the zstd frames, lowest plane first; ids are as
wide as the block's largest one needs), and the chunk index: for each document with ids in the block
its doc_id, start within the shard and length. Shards hold ascending ranges of (doc_id, text's hash, row), and ids run on
over the blocks of a shard, so a block can be decoded alone and a document found without decoding.

Shards are the ranges of one range partitioning, so a doc_id that many rows share, or none, is dealt over several; their
number follows the ids, up to MOST_SHARDS, beyond which shards grow, and a task streams its shard in any case.

Defined results: a null text is an empty one (it still has its end id); a null doc_id sorts first;
rows that repeat a doc_id are documents of their own, in order of their text's hash; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import batches_of, strings, written
from pixelloom.llm.tokens import encoder, id_type, with_end

FORMAT = "shard int, block int, first_id long, n_ids int, planes array<binary>, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>"
MOST_SHARDS = 50_000


def to_planes(ids: np.ndarray, kind: str = "bit", level: int = 3) -> list[bytes]:
    """The planes of a block, lowest first, each compressed."""
    pack = zstandard.ZstdCompressor(level=level).compress
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = int(ids.max()).bit_length() if len(ids) else 0
    columns = [np.ascontiguousarray(octets[:, k]) for k in range(-(-width // 8))]
    if kind == "byte":
        return [pack(c.tobytes()) for c in columns]
    return [pack(np.packbits(columns[k // 8] & np.uint8(1 << k % 8)).tobytes()) for k in range(width)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit", first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block of n, or only those from first to before last."""
    unpack = zstandard.ZstdDecompressor().decompress
    last = n if last is None else last
    octets = np.zeros((last - first, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(unpack(plane), np.uint8)[first:last]
        return octets.view("<u4").ravel()
    skip = first % 8  # planes open at whole bytes
    for k in range(0, len(planes), 8):
        column = np.zeros(skip + last - first, np.uint8)
        for bit, plane in enumerate(planes[k : k + 8]):
            some = np.frombuffer(unpack(plane), np.uint8)[first // 8 : -(-last // 8)]
            column |= np.unpackbits(some, count=len(column)) << np.uint8(bit)
        octets[:, k // 8] = column[skip:]
    return octets.view("<u4").ravel()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, cut: str = "blank") -> DataFrame:
    """Of each document, as a written table: doc_id, ids (with the end id, as id_type() says), n_tokens, its text's hash and a number of its row."""
    kind = id_type(tokenizer, end_id)
    width = int(kind[-1])

    def run(batches):
        for batch in batches_of(batches):
            ids, starts = with_end(*encoder(tokenizer, cut)(strings(batch)), end_id)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(starts.astype(np.int64) * width), pa.py_buffer(ids.astype(kind))])
            yield pa.record_batch([batch.column(0), data.cast(pa.binary()), pa.array(np.diff(starts).astype(np.int64)), batch.column(2)], names=["doc_id", "ids", "n_tokens", "text_hash"])

    made = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, text_hash long")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "ids", compression="zstd")


def write_planes(docs: DataFrame, tokenizer: str, end_id: int, cut: str = "blank", block: int = 1 << 16, ids_per_shard: int = 1 << 22, kind: str = "bit") -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the written table of FORMAT."""
    ids, width = encoded(docs, tokenizer, end_id, cut), id_type(tokenizer, end_id)
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // max(ids_per_shard, -(-total // MOST_SHARDS))))

    def blocks(batches):
        part = None
        for batch in batches:
            for shard, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part is None:  # a task has one shard
                    part = Blocks(shard, block, kind)
                part.add(doc, np.frombuffer(data.as_buffer(), width))
                yield from part.rows(False)
        if part:
            yield from part.rows(True)

    order = ["doc_id", "text_hash", "row"]
    dealt = ids.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return written(dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "ids").mapInArrow(blocks, FORMAT), "bitplane", compression="none")


class Blocks:
    """Gathers the ids of one shard into blocks."""

    def __init__(self, shard: int, size: int, kind: str):
        self.shard, self.size, self.kind, self.at, self.number = shard, size, kind, 0, 0
        self.held, self.n, self.docs, self.ready = [], 0, [], []

    def add(self, doc, ids: np.ndarray) -> None:
        start = self.at
        self.at += len(ids)
        place = 0
        while place < len(ids):
            take = min(len(ids) - place, self.size - self.n)
            self.held.append(ids[place : place + take])
            self.docs.append((doc, start, len(ids)))
            self.n, place = self.n + take, place + take
            if self.n == self.size:
                self._close()

    def _close(self) -> None:
        doc_ids, starts, lengths = zip(*self.docs, strict=True)
        row = (self.shard, self.number, self.number * self.size, self.n, to_planes(np.concatenate(self.held), self.kind), doc_ids, starts, lengths)
        self.ready.append(row)
        self.number, self.held, self.n, self.docs = self.number + 1, [], 0, []

    def rows(self, last: bool):
        if last and self.n:
            self._close()
        for row in self.ready:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in FORMAT.split(", ")])
        self.ready = []


def read_planes(blocks: DataFrame, kind: str = "bit") -> DataFrame:
    """The documents of a written table: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit).

    Blocks are decoded where they are read, and only as far as their documents are asked for. A document that lies in one block
    whole leaves the task as it is; only the parts of documents that run over blocks, two at most for each block, are shuffled.
    """

    def pieces(whole: bool):
        def run(batches):
            for batch in batches:
                for one in range(batch.num_rows):
                    row = batch.slice(one, 1).to_pylist()[0]
                    first = row["first_id"]
                    start, length = np.array(row["doc_starts"], np.int64), np.array(row["doc_lengths"], np.int64)
                    a, b = np.maximum(start, first), np.minimum(start + length, first + row["n_ids"])
                    some = np.flatnonzero((b - a == length) == whole)
                    if len(some):
                        # whole documents stand side by side and are opened at once; of the others, one at either end of the block, each its own ids
                        opened = [(a[some[0]], b[some[-1]])] if whole else list(zip(a[some], b[some], strict=True))
                        data = b"".join(from_planes(row["planes"], row["n_ids"], kind, int(x - first), int(y - first)).tobytes() for x, y in opened)
                        at = 4 * np.concatenate([[0], np.cumsum(b[some] - a[some])])
                        parts = [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        columns = [pa.array(np.full(len(some), row["shard"], np.int32)), pa.array([row["doc_ids"][i] for i in some], pa.int64()), pa.array(start[some]), pa.array(length[some]), pa.array(a[some]), pa.array(parts, pa.binary())]
                        yield pa.record_batch(columns, names=["shard", "doc_id", "shard_start", "n_tokens", "at", "ids"])

        return blocks.mapInArrow(run, "shard int, doc_id long, shard_start long, n_tokens long, at long, ids binary")

    key = ["shard", "shard_start", "doc_id", "n_tokens"]
    cut = pieces(False).groupBy(*key).agg(F.expr("listagg(ids) within group (order by at)").alias("ids"))
    # one row a shard, of which there are MOST_SHARDS at most
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    ends = np.cumsum([n for _, n in totals]).tolist()
    before = blocks.sparkSession.createDataFrame([(s, e - n) for (s, n), e in zip(totals, ends, strict=True)], "shard int, before long")
    return pieces(True).select(*key, "ids").unionByName(cut).join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")

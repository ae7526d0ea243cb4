"""Shared helpers of the training-data operators: written tables, tables by path, text arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session that names none gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, rows: int = 1000, by: tuple[str, ...] = (), at: str | None = None, **options) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe against lost executors. rows: Arrow batches of at most so many, for the while of writing. by: columns with a folder for each value. at: a folder to add to."""
    spark = df.sparkSession
    path, before = at or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(ROWS_KEY)
    try:
        if not 0 < int(before) <= rows:
            spark.conf.set(ROWS_KEY, str(rows))
        df.write.mode("append").partitionBy(*by).options(**options).parquet(path)
    finally:
        spark.conf.set(ROWS_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, most: int = 4_000_000, weight=None) -> DataFrame:
    """A written table of ids, marked for broadcast while it has at most that many rows (or that sum of weight); beyond, joins with it are shuffled."""
    small = df.limit(most + 1).count() <= most if weight is None else (df.agg(F.sum(weight)).first()[0] or 0) <= most
    return F.broadcast(df) if small else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with signs added until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of(column: str = "doc_id"):
    """crc32 of the id as text; -1 for a null id, which so belongs to no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(-1))


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
#: Columns that name a row of documents in tables of our own: rows with the same doc_id and text are one.
KEY = ["_doc_key", "_text_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """KEY and the text (null: empty) of docs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(KEY[0]), F.xxhash64(text).alias(KEY[1]), text.alias("text"))


def doc_id():
    return F.nullif(F.col(KEY[0]), F.lit(NO_ID)).alias("doc_id")


def joined_by_key(docs: DataFrame, other: DataFrame, how: str, keep: tuple[str, ...] = (), weight=None) -> tuple[DataFrame, list[str]]:
    """docs joined with a written table (KEY, keep) by what names a row, and the names that keep got; names that docs has already stay its own. weight: as beside() has it."""
    own, there, *names = fresh(docs, "_own_key", "_own_hash", *KEY, *keep)
    left = docs.withColumns({own: F.coalesce("doc_id", F.lit(NO_ID)), there: F.xxhash64(F.coalesce("text", F.lit("")))})
    right = beside(other, weight=weight).select(*(F.col(c).alias(n) for c, n in zip((*KEY, *keep), names, strict=True)))
    return left.join(right, (F.col(own) == F.col(names[0])) & (F.col(there) == F.col(names[1])), how).drop(own, there, names[0], names[1]), names[2:]


def strings(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of a batch as large strings with nulls made empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and each text's start, with the total at the end."""
    texts = texts.cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1]) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw[offsets[0] :], offsets - offsets[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and each text's start, with the total at the end."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; 0 for empty ranges."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return out


def batches_of(batches, most: int = 1 << 20, column: str = "text", rows: int = 8192):
    """Record batches cut so that a piece has at most `rows` rows and its texts about `most` bytes; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            below = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, below + most, "right"))))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


#: Bases of the polynomial hashes of words and word sequences; any odd numbers do.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def ranged_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of values[begin:end] for each range, from one running sum: sum of v[i] * base^i, times base^-begin."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def word_ranges(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (run without ASCII white space) in the bytes of texts, and the first word of each text, with the number of words at the end."""
    inside = np.ones(len(raw) + 1, bool)
    inside[:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    inside[-1] = False
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & (~before | fresh))
    end = np.flatnonzero(before & (~inside | fresh))
    return begin, end, np.searchsorted(begin, starts)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z made small."""
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of texts, and the first word of each text, with the number of words at the end."""
    raw, starts = utf8(texts)
    begin, end, first = word_ranges(raw, starts)
    return ranged_hashes(lowered(raw).astype(np.uint64) + np.uint64(1), begin, end), first

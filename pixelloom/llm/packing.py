"""Cost-balanced packing of documents into sequences of bounded length.

A document's ids are cut into full sequences, which are done, and a tail. Only tails are shuffled: they are packed in groups
of about `ids_per_group` ids, dealt by hash. Each group opens just as many sequences as its ids need, takes
tails by descending cost (a * length + b * length^2, one piece attending to itself) and puts each into
the sequence of lowest cost that has room; where none has, the tail is cut over those with most
room. So a group's padding stays below one sequence.

Defined results: a null text is an empty one (its end id alone is packed); rows that repeat a
document are packed on their own; a null doc_id is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.bitplane import encoded
from pixelloom.llm.tokens import id_type

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bytes of tails that a shuffle task gets.
TASK_BYTES = 64 << 20


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(document, start in it, length, sequence) of the pieces that pack tails of these lengths; the pieces of a sequence in order of their offsets."""
    room = np.full(-(-int(lengths.sum()) // size), size, np.int64)
    cost, out = np.zeros(len(room)), []
    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            fits = room >= left
            to = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            take = min(left, int(room[to]))
            out.append((int(doc), start, take, to))
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, ids_per_group: int = 1 << 19, cut: str = "space") -> DataFrame:
    """One row a piece, as PIECES says; ids are little-endian 32-bit. sequence_id: of a tails' sequence the group in the upper 32 bits and a number in it below, of a full sequence a number from 2^62 on."""
    ids, kind = encoded(docs, tokenizer, end_id, cut), id_type(tokenizer, end_id)
    width, tail = int(kind[-1]), F.col("n_tokens") % size
    total = ids.agg(F.sum(tail)).first()[0] or 0
    groups = max(1, -(-total // ids_per_group))
    tasks = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * width // TASK_BYTES))

    def full(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                n, data = batch.column(2)[one].as_py(), np.frombuffer(batch.column(1)[one].as_buffer(), kind).astype("<u4").tobytes()
                starts = np.arange(0, n - size + 1, size)
                count = len(starts)
                doc = pa.array([batch.column(0)[one].as_py()] * count, pa.int64())
                parts = pa.array([data[4 * a : 4 * (a + size)] for a in starts.tolist()], pa.binary())
                yield pa.record_batch([doc, pa.array(starts), pa.array(np.full(count, size)), parts, pa.array(np.full(count, n)), pa.array(np.zeros(count, np.int64))], names=["doc_id", "start", "length", "ids", "doc_tokens", "offset"])

    whole = ids.where(F.col("n_tokens") >= size).select("doc_id", "ids", "n_tokens").mapInArrow(full, "doc_id long, start long, length long, ids binary, doc_tokens long, offset long")
    whole = whole.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())

    def group_pieces(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "row"], kind="stable").reset_index(drop=True)
        lengths, tokens = rows["tail"].to_numpy(), rows.n_tokens.to_numpy()
        d, start, length, seq = np.array(assign(lengths, size, linear, quadratic), np.int64).reshape(-1, 4).T
        out = pd.DataFrame({"doc_id": rows.doc_id.iloc[d].array, "start": (tokens - lengths)[d] + start, "length": length, "doc_tokens": tokens[d], "sequence_id": (int(rows.group.iloc[0]) << 32) + seq})
        flat = np.frombuffer(b"".join(rows.ids), kind).astype("<u4").tobytes()
        begin = 4 * (np.cumsum(lengths) - lengths)[d] + 4 * start
        out["ids"] = [flat[a : a + 4 * n] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
        out["offset"] = out.groupby("sequence_id").length.cumsum() - out.length
        return out[[x.split()[0] for x in PIECES.split(", ")]]

    tails = ids.where(tail > 0).select("doc_id", "row", "n_tokens", tail.alias("tail"), F.expr(f"substring(ids, cast((n_tokens - n_tokens % {size}) * {width} + 1 as int))").alias("ids"))
    tails = tails.withColumn("group", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups))).repartition(tasks, "group")
    return tails.groupBy("group").applyInPandas(group_pieces, PIECES).unionByName(whole.select(*(x.split()[0] for x in PIECES.split(", "))))

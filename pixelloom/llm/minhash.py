"""Near-duplicates by ProbMinHash signatures of shingle sets, banding and verification.

Shingles are five lower-cased words (a text of one to four words is one shingle), each of weight 1
however often it occurs. Each shingle's arrivals are a Poisson process whose rate is its weight; an
arrival falls into a random register, each register keeps its earliest arrival, and a shingle stops
once its time passes the latest time any register still holds. With equal weights two registers are
equal with the Jaccard similarity of the sets as probability, the measure that is verified; bands of
registers give candidates, and a link is a Jaccard similarity of the shingle sets of at least 0.8,
checked for every candidate on the whole sets. Bands miss a pair of similarity J with probability
(1 - J^6)^32: never for equal sets, 6 in 100,000 at 0.8.

Texts with the same words collapse into one representative first. A bucket of up to `small` texts
yields its pairs. A larger one yields a star, all of its texts against one hub; if its texts are then still of
several classes, they are compared in blocks on their whole sets, so that no link between classes is lost however
large a bucket is, and a block yields only links that join classes.

Copies of one text meet by the hash of its words; texts with very many copies, few by their number, are
looked up in a broadcast table instead.

Defined results: a null text, or one without a word, is a class of its own; a null doc_id has a null
class and is kept; rows of one doc_id are one document, with all their texts, and without_duplicates() keeps one of them, whose
text comes first by hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import BASE, BASE2, batches_of, beside, fresh, mixed, powers, ranged_hashes, strings, word_hashes, written
from pixelloom.llm.components import components

WORDS = 5
#: Bits of a shingle's hash; the rest of 64 hold a text's place in its batch.
BITS = 50
#: Bytes of text that a task works on at once; its arrays take some 60 times as many.
PIECE = 1 << 18


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: place of the text and hash; and two hashes of each text's words."""
    words, first = word_hashes(texts)
    count = np.diff(first)
    gram = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k, p in enumerate(powers(BASE, WORDS)):
        gram += padded[k : k + len(words)] * p
    gram = mixed(gram)
    place = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(words)) + WORDS <= first[1:][place]
    prints = [ranged_hashes(words, first[:-1], first[1:], b) for b in (BASE, BASE2)]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    keys = np.concatenate([place[inside].astype(np.uint64) << np.uint64(BITS) | gram[inside] >> np.uint64(64 - BITS), short.astype(np.uint64) << np.uint64(BITS) | prints[0][short] >> np.uint64(64 - BITS)])
    keys = np.unique(keys)
    return (keys >> np.uint64(BITS)).astype(np.int64), keys & np.uint64((1 << BITS) - 1), *prints


def signatures(place: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers: the 32-bit print of the element that came first into each register, under its time in the upper 32 bits."""
    held = np.full(n * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    if not len(place):
        return held.reshape(n, registers)
    number = np.bincount(place, minlength=n)
    # so many arrivals at once that a text's registers are mostly filled
    repeat = np.clip(np.ceil(registers * (np.log(registers) + 1) / np.maximum(number, 1)), 1, registers * 7).astype(np.int64)
    time, at = np.zeros(len(place)), np.zeros(len(place), np.int64)
    mark = mixed(element + np.uint64(BASE)) & np.uint64(0xFFFFFFFF)
    active = np.arange(len(place))
    while len(active):
        each = repeat[place[active]]
        who = np.repeat(active, each)
        begin = np.cumsum(each) - each
        step = np.arange(len(who)) - np.repeat(begin, each) + at[who]
        dice = mixed(element[who] * np.uint64(BASE2) + mixed(step.astype(np.uint64) + np.uint64(1)))
        wait = -np.log(((dice >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)) / weight[who]
        run = np.cumsum(wait)
        since = run - np.repeat(run[begin] - wait[begin], each) + time[who]
        slot = place[who] * registers + ((dice & np.uint64(0xFFFFFF)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(held, slot, since.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | mark[who])
        time[active], at[active] = since[begin + each - 1], at[active] + each
        latest = held.reshape(n, registers).max(axis=1)
        active = active[(time[active].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) < latest[place[active]]]
        repeat = np.maximum(1, repeat // 4)
    return held.reshape(n, registers)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, two prints of the words and the bands' hashes (null without a word)."""
    registers = bands * rows

    def run(batches):
        for batch in batches_of(batches, PIECE):
            place, element, a, b = shingles(strings(batch))
            held = signatures(place, element, np.ones(len(place)), batch.num_rows, registers) & np.uint64(0xFFFFFFFF)
            keys = np.zeros((batch.num_rows, bands), np.uint64) + mixed(np.arange(bands).astype(np.uint64) + np.uint64(7))
            for k in range(rows):
                keys = mixed(keys * np.uint64(BASE) + held[:, k::rows])
            empty = np.bincount(place, minlength=batch.num_rows) == 0
            lists = [None if e else k for e, k in zip(empty, keys.view(np.int64), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "print_a", "print_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print_a long, print_b long, bands array<long>")


def item_sets(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(doc, items): the shingle sets, as hashes of BITS bits, of the documents in used (doc_id); a set for each text of a document."""

    def sets(batches):
        for batch in batches_of(batches, PIECE):
            place, element, *_ = shingles(strings(batch))
            bounds = np.searchsorted(place, np.arange(batch.num_rows + 1))
            data = [element[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["doc", "items"])

    return docs.join(beside(written(used.distinct(), "used")), "doc_id").select("doc_id", "text").mapInArrow(sets, "doc long, items binary").distinct()


def verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that Jaccard similarity or more; only texts in pairs are read into sets."""

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (a, b))
                n = len(x) + len(y)
                both = n - len(np.unique(np.concatenate([x, y]))) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                keep.append(both > 0 and both >= least * (n - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    items = written(item_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))), "sets")
    left, right = items.toDF("a", "items_a"), items.toDF("b", "items_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(check, "a long, b long")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]):
    """For each set the sizes of its intersections with all others."""
    _, code = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    sizes = [len(x) for x in (*sets, *others)]
    begin = np.cumsum([0, *sizes])
    own, theirs, starts = code[: begin[len(sets)]], code[begin[len(sets)] :], begin[len(sets) :] - begin[len(sets)]
    mark = np.zeros(len(code), np.int32)
    for i in range(len(sets)):
        mark[own[begin[i] : begin[i + 1]]] = 1
        yield np.add.reduceat(mark[theirs], starts[:-1])
        mark[own[begin[i] : begin[i + 1]]] = 0


def blocks_of(open_members: DataFrame, items: DataFrame, least: float, block: int = 256) -> DataFrame:
    """Links (a, b) that join classes within buckets, by blocks: each block of texts meets each other one once."""
    sizes = open_members.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = open_members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    sent = dealt.select("key", "doc", "class", "part", F.explode(others).alias("other")).select("key", "doc", "class", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(rows.x.iloc[0]), int(rows.y.iloc[0])
        mine, theirs = rows[rows.part == x], rows[rows.part == y]
        a, b = ([np.frombuffer(v, "<u8") for v in r["items"]] for r in (mine, theirs))
        joined = {c: c for c in rows["class"]}

        def top(c):
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        out = []
        if a and b and len(joined) > 1:
            sizes, names, docs = np.array([len(v) for v in b]), theirs["class"].to_numpy(), theirs.doc.to_numpy()
            for own, doc, name, both in zip(a, mine.doc, mine["class"], overlaps(a, b), strict=True):
                for j in np.flatnonzero((both >= least * (len(own) + sizes - both)) & (names != name)):
                    if top(name) != top(names[j]):
                        joined[top(name)] = top(names[j])
                        out.append((min(doc, docs[j]), max(doc, docs[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sent.join(items, "doc").groupBy("key", "x", "y").applyInPandas(meet, "a long, b long").distinct()


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id; all columns stay."""
    found = written(near_duplicates(docs, **options), "classes")
    dropped = written(found.where("not kept").select("doc_id").distinct(), "dropped")
    twice = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    left = docs.join(beside(dropped), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return left
    own, row, repeated = fresh(docs, "_own", "_row", "_repeated")
    rows = left.where("doc_id is not null").join(beside(twice).withColumnRenamed("doc_id", repeated), F.col("doc_id") == F.col(repeated), "left_semi")
    one = rows.groupBy(F.col("doc_id").alias(own)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(F.coalesce("text", F.lit("")))).alias(row))
    return left.join(beside(twice), "doc_id", "left_anti").select(*docs.columns).union(one.select(f"{row}.*"))


def first_copies(marks: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The smallest doc_id of each text (print_a, print_b, doc), and marks with it. Texts of which more than one in `most` rows is a copy are `most` at most: those are broadcast, and the rest has no hot key."""
    prints = written(marks.where("bands is not null and doc_id is not null").groupBy("print_a", "print_b").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "prints")
    total = prints.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(prints.where(F.col("copies") > max(1.0, total / most)).select("print_a", "print_b", "doc"))
    key = ["print_a", "print_b"]
    cold = marks.join(hot, key, "left_anti").join(prints.select(*key, "doc"), key, "left")
    return prints.select(*key, "doc"), cold.select(*marks.columns, "doc").unionByName(marks.join(hot, key).select(*marks.columns, "doc"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 6, small: int = 8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class) and kept (whether it is that document) for each row."""
    docs = docs.select("doc_id", "text")
    marks = written(signed(docs, bands, rows), "signed")
    _, named = first_copies(marks)
    own = written(named.select("doc_id", F.when(F.col("bands").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("doc")).alias("doc"), F.when(F.col("doc_id") == F.col("doc"), F.col("bands")).alias("bands")), "own")
    heads = own.where("bands is not null").dropDuplicates(["doc", "bands"]).select("doc", "bands")
    keyed = heads.select("doc", F.explode(F.array_distinct("bands")).alias("key"))
    # documents of several texts, each of which may have its own first copy
    mixed_ids = written(own.where("doc is not null").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("doc_id"), "mixed")
    bound = written(own.join(beside(mixed_ids), "doc_id").where("doc <> doc_id").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct(), "bound")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("hub")).where("size > 1")
    members = written(keyed.join(shared, "key"), "buckets")

    few = members.where(F.col("size") <= small).select("key", "doc")
    pairs = few.toDF("key", "a").join(few.toDF("key", "b"), "key").where("a < b").select("a", "b")
    pairs = pairs.union(members.where((F.col("size") > small) & (F.col("doc") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("doc").alias("b"))).distinct()
    links = written(verified(written(pairs, "pairs"), docs, threshold), "found")
    classes = written(components(links.union(bound)), "classes")
    at = members.where(F.col("size") > small).join(classes, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "doc").alias("class"))
    at = written(at, "large")
    several = at.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one < other").select("key")
    left = written(at.join(several, "key"), "open")
    if not left.isEmpty():
        more = blocks_of(left, item_sets(docs, left.select(F.col("doc").alias("doc_id"))), threshold)
        classes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    out = own.join(classes, own["doc"] == classes["node"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc")).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))

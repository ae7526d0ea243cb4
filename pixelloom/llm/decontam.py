"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts and benchmark items become templates: numbers, units after numbers and names (capitalised words of any script within a
sentence) turn into typed placeholders, the rest into lower-case words without punctuation. Windows of
`window` template words, and of the case-folded words themselves, are hashed and joined. A pair counts if
the document has at least `share` of the item's windows, `run` of them one after another, or windows over `cover` of the
item's words. If the words themselves reach that, nothing more is asked; if only the template does, names must
stand for names one to one, and equal numbers or units of the document for equal ones of the item (not the other way round, as two roles may have one
number), so that re-parameterised copies are caught and loose look-alikes are not. A placeholder is looked up by the matching windows over it, so insertions may move it. Numbers are digits; number words are words.

Texts are read twice and not shuffled while the pairs that may count, ids only, are few enough to be broadcast.

Defined results: a null or empty text matches nothing; an item with fewer words than a window matches where all its
words follow one another, in any case; items of the same text each match; rows that repeat a document or an item count once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import KEY, NO_ID, beside, doc_id, joined_by_key, keyed, written

#: Units of measure that are placeholders after a number.
UNITS = "km|m|cm|mm|kg|g|mg|t|lb|lbs|oz|mi|mile|miles|ft|feet|inch|inches|h|hour|hours|min|minute|minutes|s|sec|second|seconds|day|days|week|weeks|month|months|year|years|percent|usd|eur|dollar|dollars|euro|euros|cent|cents|l|ml|liter|liters|litre|litres|mph|kmh|kw|w|v|hz"
#: A letter sign that stands for a point or comma within a number.
POINT = "ˑ"
SLOTS = ("<num>", "<unit>", "<name>")


def spaced(text: Column) -> Column:
    """The text with numbers in one piece and units apart from them."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", POINT)
    return F.regexp_replace(whole, rf"(?i)(?<=[0-9])({UNITS})\b", " $1")


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}<>]+", " ")), " ")


def template(text: Column) -> Column:
    """Template words; as many as words(spaced(text)), each for the word in its place."""
    named = F.regexp_replace(spaced(text), r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+", "<name>")
    unit = F.regexp_replace(named, rf"(?i)(?<=[0-9] )(?:{UNITS})\b", "<unit>")
    return words(F.lower(F.regexp_replace(unit, rf"[0-9]+(?:{POINT}[0-9]+)*", "<num>")))


def folded(text: Column) -> Column:
    """Lower-case words; the word in each place of template()."""
    return words(F.lower(spaced(text)))


def windows_of(hashes: str, size: int) -> Column:
    made = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))
    return F.when(F.size(hashes) >= size, made)


def with_windows(rows: DataFrame, window: int) -> DataFrame:
    """rows (text) with template, values (case-folded), the hashes of their words, and windows of both. To be opened with explode_outer: explode would have Spark test the arrays in a filter of its own, computed once more."""
    rows = rows.withColumn("template", template(F.col("text"))).withColumn("values", folded(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("template", lambda w: F.xxhash64(w))).withColumn("plain", F.transform("values", lambda w: F.xxhash64(w)))
    return rows.withColumn("windows", windows_of("hashes", window)).withColumn("verbatim", windows_of("plain", window))


def of_kind(kind: str):
    return lambda e: e["kind"] == kind


def longest(places: Column) -> Column:
    """The longest run of consecutive numbers in an array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, p):
        run = F.when(p == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda s: s["best"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = 6, share: float = 0.5, broadcast_rows: int = 500_000, run: int = 8, cover: float = 0.8) -> DataFrame:
    """doc_id, text_hash, item_id, matched (distinct windows), item_windows, share, slots, consistent for each pair found; only verbatim or consistent ones.

    The items' windows are broadcast while they are at most `broadcast_rows`; beyond, both sides are shuffled.
    """
    rows = keyed(docs)
    asked = with_windows(items.select("item_id", "text").where("item_id is not null").dropDuplicates(["item_id", "text"]), window)
    asked = asked.withColumn("n_words", F.size("values")).where(F.get("values", F.lit(0)) != "")
    brief = sorted(r["n_words"] for r in asked.where(F.col("n_words") < window).select("n_words").distinct().collect())
    whole = F.when(F.col("n_words") >= window, F.col("verbatim"))
    for n in brief:
        whole = F.when(F.col("n_words") == n, windows_of("plain", n)).otherwise(whole)
    lines = asked.select("item_id", F.lit("t").alias("kind"), F.posexplode_outer("windows").alias("place", "hash")).union(asked.select("item_id", F.lit("v"), F.posexplode_outer(whole))).where("hash is not null").distinct()
    distinct = lines.select("item_id", "hash").distinct()
    bounded = distinct.count() <= broadcast_rows
    small = (lambda df: F.broadcast(df)) if bounded else (lambda df: df)
    known = distinct.groupBy("hash").agg(F.collect_set("item_id").alias("items"))
    looked = with_windows(rows, window)
    none = F.array().cast("array<bigint>")
    both = [F.coalesce(c, none) for c in (F.col("windows"), F.col("verbatim"), *(windows_of("plain", n) for n in brief))]
    seen = looked.select(*KEY, F.explode_outer(F.concat(*both)).alias("hash"))
    hits = seen.join(small(known), "hash").groupBy(*KEY, "hash").agg(F.first("items").alias("items")).select(*KEY, F.explode("items").alias("item_id")).groupBy(*KEY, "item_id").agg(F.count("*").alias("hits"))
    totals = lines.groupBy("item_id").agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col("hash"))).alias(f"all_{k}") for k in "tv")).join(asked.groupBy("item_id").agg(F.min("n_words").alias("n_words")), "item_id")
    # so many windows at least in any pair that one of the rules below accepts
    fewest = F.least(F.lit(float(run)), *(F.lit(share) * F.when(F.col(f"all_{k}") > 0, F.col(f"all_{k}")) for k in "tv"), F.lit(cover / window) * F.col("n_words"))
    pairs = written(hits.join(small(totals), "item_id").where(F.col("hits") >= fewest), "pairs")

    # where the item's windows lie in the document: places by shift
    pair = [*KEY, "item_id"]
    full = with_windows(rows.join(beside(pairs), KEY), window)
    at = None
    for kind, column in (("t", F.col("windows")), ("v", F.col("verbatim")), *(("v", windows_of("plain", n)) for n in brief)):
        opened = full.select(*pair, F.lit(kind).alias("kind"), F.posexplode_outer(column).alias("at", "hash"))
        at = opened if at is None else at.union(opened)
    shifts = at.join(small(lines), ["item_id", "kind", "hash"]).groupBy(*pair, "kind", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"), F.collect_set("hash").alias("codes"))
    shifts = shifts.withColumn("run", longest(F.col("places")))
    placed = shifts.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct((-F.size("places")).alias("order"), "shift", "kind", "places", "codes", "run"))).alias("shifts"))
    placed = full.select(*pair, "all_t", "all_v", "n_words", "template", words(spaced(F.col("text"))).alias("stood")).join(placed, pair)
    for k in "tv":
        placed = placed.withColumn(k, F.filter("shifts", of_kind(k)))
        inside = F.flatten(F.transform(F.array_distinct(F.flatten(F.transform(k, lambda e: e["places"]))), lambda p: F.sequence(p, p + window - 1)))
        placed = placed.withColumn(f"matched_{k}", F.size(F.array_distinct(F.flatten(F.transform(k, lambda e: e["codes"])))))
        placed = placed.withColumn(f"share_{k}", F.coalesce(F.try_divide(f"matched_{k}", f"all_{k}"), F.lit(0.0)))
        long = F.coalesce(F.array_max(F.transform(k, lambda e: e["run"])), F.lit(0)) >= run
        placed = placed.withColumn(f"holds_{k}", (F.col(f"share_{k}") >= share) | (F.size(F.array_distinct(inside)) >= F.lit(cover) * F.col("n_words")) | long)
    slots = asked.select("item_id", F.posexplode_outer(F.arrays_zip(F.col("template"), words(spaced(F.col("text"))).alias("value"))).alias("place", "slot")).where(F.col("slot.template").isin(*SLOTS))
    slots = slots.select("item_id", "place", F.col("slot.template").alias("kind"), F.col("slot.value").alias("value"))
    lists = slots.groupBy("item_id").agg(F.collect_list(F.struct("place", "kind", "value")).alias("slots"))
    placed = placed.where("holds_t or holds_v").join(lists, "item_id", "left")

    def stands(s):
        """The document's word for a slot, at the shift of most windows among those with a window over the slot."""
        over = F.filter("t", lambda e: F.exists(e["places"], lambda p: (p <= s["place"]) & (p + window > s["place"])))
        return F.get("stood", s["place"] + F.get(over, F.lit(0))["shift"])

    there = F.transform(F.coalesce("slots", F.array().cast(lists.schema["slots"].dataType)), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), stands(s).alias("stands")))
    placed = placed.withColumn("there", F.array_distinct(F.filter(there, lambda s: s["stands"].isNotNull())))
    names, rest = F.filter("there", lambda s: s["kind"] == "<name>"), F.filter("there", lambda s: s["kind"] != "<name>")
    said = lambda slots, *parts: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(*(s[p] for p in parts))))) == F.size(slots)
    one = said(names, "value") & said(names, "stands") & said(rest, "kind", "stands")
    placed = placed.withColumn("best", F.when(F.col("share_t") >= F.col("share_v"), F.struct(F.col("matched_t").alias("matched"), F.col("all_t").alias("all"))).otherwise(F.struct(F.col("matched_v").alias("matched"), F.col("all_v").alias("all"))))
    out = placed.select(doc_id(), KEY[1], "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.all").alias("item_windows"), F.greatest("share_t", "share_v").alias("share"), F.size("there").alias("slots"), one.alias("consistent"), "holds_t", "holds_v")
    return out.where("holds_v or (holds_t and consistent)").drop("holds_t", "holds_v").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that contain an item; all columns stay."""
    found = written(contaminated(docs, items, **options).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(KEY[0]), KEY[1]).distinct(), "found")
    return joined_by_key(docs, found, "left_anti")[0].select(*docs.columns)

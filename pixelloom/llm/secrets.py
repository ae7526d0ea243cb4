"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Base kinds are regular expressions, matched leftmost and without overlaps; a span is the whole match, in code points,
end exclusive. A span's place is the running sum of what split() leaves between the matches.

Texts are read once: cheap tests first, then each kind's matches side by side; all that follows works on the matches.

The battery looks at runs of 16 or more signs of the usual encodings outside base spans, at two grains: up to an inner
"=" or a base span, and pieces of letters and digits alone. The longest passing span stands. For each distinct run: the encoding is
inferred from its signs (hex, base32, base36, base62, base64; plain numbers are none), then a chi-squared test of
the alphabet's uniformity, a runs test about the alphabet's middle and a lag-1 serial-correlation test must each
leave randomness possible (p >= alpha). The false-discovery side: the likelihood of the run under uniform draws, over
that under the corpus' own letter frequencies, is an e-value against "ordinary text", so exp(-log ratio)
bounds its p-value whatever the length; Benjamini-Hochberg runs on it within strata of encoding and length.
Letter frequencies and strata cover all documents.

Defined results: a null text is an empty one, without spans; rows that repeat a document have the same spans
each; a null doc_id is kept; other columns are left alone.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import KEY, beside, doc_id, joined_by_key, keyed, written

#: The base kinds in their order, each with its pattern, the group that is measured and its least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
LEAST = 16
RANDOM = "random"
#: What a text with a match of "assign" holds in any case; and a ":" or "=".
NAMES = r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
RUN = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{LEAST},}}"
#: What is tested of an uncovered run: up to an inner "=", and letters and digits alone.
GRAINS = {"coarse": rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}", "fine": rf"[A-Za-z0-9]{{{LEAST},}}"}
#: Encodings by the signs they use, in the order in which they are tried.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[0-9A-Za-z+/_-]+=*$", "+/-0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
}


def literal(pattern: str) -> Column:
    return F.lit(pattern)


def matches(kind: str, pattern: str, group: int, column: str = "text") -> Column:
    """A column's matches of a pattern: kind, i, gap (signs since the match before), size and value (the group)."""
    value = F.regexp_extract_all(column, literal(pattern), F.lit(0))
    zipped = F.arrays_zip(
        F.transform(F.split(column, pattern, -1), lambda s: F.length(s)).alias("gap"),
        F.transform(value, lambda s: F.length(s)).alias("size"),
        (F.regexp_extract_all(column, literal(pattern), F.lit(group)) if group else value).alias("value"),
    )
    return F.transform(zipped, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))


def opened(rows: DataFrame, arrays: list[Column], *keep: str) -> DataFrame:
    """keep and the matches in arrays, a row each."""
    found = rows.select(*keep, F.array(*arrays).alias("kinds")).select(*keep, F.explode_outer("kinds").alias("all")).select(*keep, F.explode_outer("all").alias("m"))
    return found.select(*keep, *(F.col(f"m.{c}").alias(c) for c in ("kind", "i", "gap", "size", "value"))).where("size is not null")


def scanned(docs: DataFrame) -> DataFrame:
    """KEY, kind, start, end and value of the base kinds' matches that count, and of runs ("run"). One pass over the texts; access and hex lie in runs whole, and are looked for there."""
    named = (F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))) & F.rlike("text", literal(NAMES))
    run = F.rlike("text", literal(RUN.replace(",}", "}")))
    made = [F.when(named, matches("assign", KINDS["assign"][0], 1)), F.when(run, matches("run", RUN, 0))]
    rows = written(opened(docs, made, *KEY).distinct(), "matches")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*KEY, "kind").orderBy("i"))
    spans = rows.withColumn("end", end).select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")
    spans = written(spans.where((F.col("kind") == "run") | (F.length("value") >= KINDS["assign"][2])), "spans")
    return written(spans.unionByName(within(spans.where("kind = 'run'"), {k: KINDS[k][0].replace("]+", f"]{{{n},}}") for k, n in (("access", 16), ("hex", 24))})), "spans")


def within(parts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """KEY, kind, start, end and value of the patterns' matches in parts (KEY, start, value) of texts."""
    rows = opened(parts.select(*KEY, F.col("start").alias("at"), F.col("value").alias("part")), [matches(k, p, 0, "part") for k, p in patterns.items()], *KEY, "at")
    end = F.col("at") + F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*KEY, "at", "kind").orderBy("i"))
    return rows.withColumn("end", end).select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def uncovered(spans: DataFrame) -> DataFrame:
    """KEY, start and value of the parts of runs outside all base spans. A part begins where its run or a base span in it does end, at the furthest base end so far, and goes on to the next base span or the run's end."""
    order = Window.partitionBy(*KEY).orderBy("start", F.col("kind") != "run")
    so_far, later = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(1, Window.unboundedFollowing)
    run = F.col("kind") == "run"
    rows = spans.select(*KEY, "kind", "start", "end", F.when(run, F.col("value")).alias("run"))
    rows = rows.withColumn("reach", F.max(F.when(~run, F.col("end"))).over(so_far)).withColumn("next", F.min(F.when(~run, F.col("start"))).over(later))
    rows = rows.withColumn("own", F.last(F.when(run, F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("run").alias("value"))), ignorenulls=True).over(so_far))
    rows = rows.withColumn("from", F.greatest(F.col("own.start"), F.coalesce("reach", F.lit(0)))).withColumn("to", F.least(F.col("own.end"), F.coalesce("next", F.col("own.end"))))
    rows = rows.where(F.col("to") - F.col("from") >= LEAST)
    return rows.select(*KEY, F.col("from").alias("start"), F.expr("substring(own.value, cast(from - own.start + 1 as int), cast(to - from as int))").alias("value")).distinct()


def tail(z: Column) -> Column:
    """Two-sided tail of the normal law, by the logistic approximation (within 0.0002 of it)."""
    a = F.abs(z)
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.least(F.lit(0.07056) * a * a * a + F.lit(1.5976) * a, F.lit(700.0))))


def battery(tokens: DataFrame) -> DataFrame:
    """Of distinct runs (value): encoding, alphabet size and the p-values of the three tests under randomness."""
    code = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(ENCODINGS.items()):
        code = F.when(F.rlike("value", literal(pattern)), F.lit(name)).otherwise(code)
    code = F.when(F.rlike("value", literal("^(?:[0-9]+|[-_=+/]+)$")), F.lit(None)).otherwise(code)
    signs = F.create_map(*[x for name, (_, s) in ENCODINGS.items() for x in (F.lit(name), F.lit(s))])
    sizes = F.create_map(*[x for name, size in (("hex", 16), ("base32", 32), ("base36", 36), ("base62", 62), ("base64", 64)) for x in (F.lit(name), F.lit(float(size)))])
    rows = tokens.withColumn("code", code).where("code is not null")
    rows = rows.withColumn("alphabet", signs[F.col("code")]).withColumn("size", sizes[F.col("code")])
    folded = F.when(F.col("code") == "hex", F.lower("value")).when(F.col("code") == "base36", F.lower("value")).otherwise(F.col("value"))
    rows = rows.withColumn("n", F.length("value").cast("double")).withColumn("signs", F.split(folded, ""))
    rows = rows.withColumn("signs", F.filter("signs", lambda c: c != ""))
    counts = F.transform(F.array_distinct("signs"), lambda c: F.size(F.filter("signs", lambda x: x == c)).cast("double"))
    rows = rows.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    rows = rows.withColumn("places", F.transform("signs", lambda c: F.instr(F.col("alphabet"), c).cast("double") - (F.col("size") + 1) / 2))
    pairs = F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.size("places") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("pairs", pairs)
    rows = rows.withColumn("runs", F.aggregate("pairs", F.lit(1.0), lambda s, p: s + F.when((p["a"] > 0) != (p["b"] > 0), 1.0).otherwise(0.0)))
    rows = rows.withColumn("high", F.aggregate("places", F.lit(0.0), lambda s, p: s + F.when(p > 0, 1.0).otherwise(0.0)))
    rows = rows.withColumn("total", F.aggregate("places", F.lit(0.0), lambda s, p: s + p)).withColumn("power", F.aggregate("places", F.lit(0.0), lambda s, p: s + p * p))
    rows = rows.withColumn("lagged", F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["a"] * p["b"]))
    df = F.col("size") - 1
    chi = F.col("squares") * F.col("size") / F.col("n") - F.col("n")
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (F.lit(1.0) - F.lit(2.0) / (F.lit(9.0) * df))) / F.sqrt(F.lit(2.0) / (F.lit(9.0) * df))
    pq = F.col("high") * (F.col("n") - F.col("high"))
    mean = F.lit(1.0) + F.lit(2.0) * pq / F.col("n")
    z_runs = F.try_divide(F.col("runs") - mean, F.sqrt(F.greatest((mean - 1) * (mean - 2) / (F.col("n") - 1), F.lit(1e-9))))
    centre = F.col("total") / F.col("n")
    var = F.greatest(F.col("power") / F.col("n") - centre * centre, F.lit(1e-9))
    z_serial = (F.col("lagged") / F.col("n") - centre * centre) / var * F.sqrt("n")
    return rows.select("value", "times", "code", "size", "n", F.when(z_chi > 0, tail(z_chi)).otherwise(1.0).alias("p_chi"), tail(z_runs).alias("p_runs"), tail(z_serial).alias("p_serial"))


def random_values(tokens: DataFrame, alpha: float, discovery: float, digits: float) -> DataFrame:
    """The distinct runs that the battery takes for random: value. tokens: value, times."""
    # values are few against texts, and dear: dealt over all tasks, tested once
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tested = battery(tokens.repartition(max(tasks, 8), "value"))
    # the corpus' letters: signs of runs of letters only, at most 52 rows
    letters = tokens.where(F.rlike("value", literal("^[A-Za-z]+$"))).select("times", F.explode_outer(F.split("value", "")).alias("sign")).where("sign <> ''").groupBy("sign").agg(F.sum("times").cast("double").alias("times"))
    model = {r["sign"]: r["times"] for r in letters.collect()}
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    total = sum(model.values()) + 0.5 * len(alphabet)
    logs = {c: (model.get(c, 0.0) + 0.5) / total * (1 - digits) for c in alphabet} | {c: digits / 15 for c in "0123456789+/=_-"}
    table = F.create_map(*[x for c, p in sorted(logs.items()) for x in (F.lit(c), F.lit(log(p)))])
    text_log = F.aggregate(F.split("value", ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(table, c), F.lit(0.0)))
    tested = tested.withColumn("evidence", -F.col("n") * F.log("size") - text_log)
    tested = tested.withColumn("bin", F.greatest(F.floor("evidence"), F.lit(0))).withColumn("band", F.floor(F.log2("n")).cast("int"))
    tested = written(tested.select("value", "times", "code", "band", "bin", "p_chi", "p_runs", "p_serial"), "tested")
    strata = tested.groupBy("code", "band", "bin").agg(F.sum("times").alias("times"))
    falling = Window.partitionBy("code", "band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("code", "band")
    strata = strata.select("code", "band", "bin", F.sum("times").over(falling).alias("above"), F.sum("times").over(whole).alias("all"))
    bars = strata.where(F.col("all") * F.exp(-F.col("bin").cast("double")) <= F.lit(discovery) * F.col("above")).groupBy("code", "band").agg(F.min("bin").alias("bar"))
    passed = tested.where((F.col("p_chi") >= alpha) & (F.col("p_runs") >= alpha) & (F.col("p_serial") >= alpha))
    return passed.join(F.broadcast(bars), ["code", "band"]).where("bin >= bar and bin > 0").select("value")


def clear_of(spans: DataFrame, solid: Column) -> DataFrame:
    """The spans that are solid or overlap none that is."""
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spans = spans.withColumn("reach", F.max(F.when(solid, F.col("end"))).over(before)).withColumn("next", F.min(F.when(solid, F.col("start"))).over(after))
    return spans.where(solid | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))).drop("reach", "next")


def find_secrets(docs: DataFrame, alpha: float = 1e-3, discovery: float = 0.01, digits: float = 0.02) -> DataFrame:
    """KEY, kind, start, end: base spans, and spans the battery adds where no base span lies. bars are few rows: encodings times lengths by powers of two."""
    spans = scanned(keyed(docs))
    runs = written(within(uncovered(spans), GRAINS), "runs")
    tokens = written(runs.groupBy("value").agg(F.count("*").alias("times")), "values")
    values = written(random_values(tokens, alpha, discovery, digits), "random")
    every = spans.where(F.col("kind").isin(*KINDS)).drop("value").unionByName(runs.join(beside(values), "value").drop("value"))
    base = F.col("kind").isin(*KINDS)
    coarse = clear_of(every.where("kind <> 'fine'"), base)
    kept = clear_of(coarse.unionByName(every.where("kind = 'fine'")), F.col("kind") != "fine")
    return kept.select(*KEY, F.when(base, F.col("kind")).otherwise(F.lit(RANDOM)).alias("kind"), "start", "end")


def by_document(spans: DataFrame) -> DataFrame:
    """KEY and the document's spans in order of start, then of kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate([*KINDS, RANDOM]) for x in (F.lit(k), F.lit(i))])
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans"))


def of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: its spans by kind, counted and joined."""
    found = written(by_document(find_secrets(docs, **options)), "spans")
    rows = keyed(docs).select(*KEY)
    joined = rows.join(beside(found, weight=F.size("spans")), KEY, "left").select(doc_id(), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = {k: of_kind(k) for k in (*KINDS, RANDOM)}
    return joined.select("doc_id", *(number[k].alias(f"n_{k}") for k in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), number[RANDOM].alias("n_random"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each secret replaced by [kind]; n_chars follows the text. All rows and columns stay."""
    spans = find_secrets(docs, **options)
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("_cuts"), F.max("end").alias("_last"))
    joined, (cut, last) = joined_by_key(docs, written(cuts, "cuts"), "left", ("_cuts", "_last"), F.size("_cuts"))
    pieces = F.transform(cut, lambda s: F.when(s["start"] >= s["from"], F.concat(F.substring("text", s["from"] + 1, s["start"] - s["from"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), F.substring("text", F.col(last) + 1, F.length("text"))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)

"""The pipeline's stages: each against brute force or its operator's own rows, on tables with odd rows and clashing names."""

from __future__ import annotations

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import decontam, secrets
from test_training_data import classes

SF = "/root/testdata/sf0.001"
CLASH = ["_lang", "_score", "_cuts", "_last", "_doc_key", "_text_hash", "_own_key", "_own", "held_out", "bands", "ids"]


def test_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 34 --"), (None, "the house by the sea was old and the rain came down on it"), (9004, "x " * 20_000)], "doc_id long, text string")
    docs = base.unionByName(odd, allowMissingColumns=True).unionByName(base.where("doc_id in (3, 5)")).withColumns({c: F.lit(c) for c in CLASH})
    run = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())

    kept = run["language"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.where("_lang <> '_lang' or _score <> '_score'").isEmpty()
    lettered = [r for r in rows(docs) if re.search(r"[^\W\d_]", r[2])]
    left = rows(kept)
    assert set(left) <= set(lettered) and len(left) > 0.97 * len(lettered)

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    one = run["near_duplicates"](spark, kept, SF)
    named = {r[1]: r[2] for r in left if not r[0]}
    want = sorted({(False, i, named[i]) for i, c in classes(named).items() if i == c} | {r for r in left if r[0]})
    assert one.columns == docs.columns and rows(one) == want

    one = spark.createDataFrame(one.collect(), docs.schema)
    clean = run["decontamination"](spark, one, SF)
    bad = {(r.doc_id is None, r.doc_id or 0) for r in decontam.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and clean.columns == docs.columns and rows(clean) == [r for r in want if r[:2] not in bad]

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    red = run["secrets"](spark, clean, SF)
    assert red.columns == docs.columns and red.where("_cuts <> '_cuts' or _doc_key <> '_doc_key' or _text_hash <> '_text_hash'").isEmpty()
    said = {(r.doc_id is None, r.doc_id or 0): r.spans for r in secrets.report(clean).collect()}

    def cut(text: str, spans: str) -> str:
        out, at = "", 0
        for kind, a, b in sorted((x.split(":") for x in spans.split(",") if x), key=lambda s: (int(s[1]), int(s[2]))):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        return out + text[at:]

    assert rows(red) == sorted((*r[:2], cut(r[2], said[r[:2]])) for r in rows(clean))

    red = spark.createDataFrame(red.collect(), docs.schema)
    pieces = run["packing"](spark, red, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for null, doc, text in rows(red):
        own = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == (None if null else doc)), key=lambda p: p.start))
        assert own == b"".join(i.to_bytes(4, "little") for i in [*t.encode(text, add_special_tokens=False).ids, 0])


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name

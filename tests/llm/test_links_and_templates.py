"""Links of documents with several texts, near copies, weighted signatures; templates against a plain version."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import regex

from pixelloom.llm import decontam, minhash


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_documents_of_three_texts(spark):
    a, b, c = (" ".join(words(random.Random(k), 30)) for k in range(3))
    rows = [(1, a), (2, b), (3, c), (10, a), (10, b), (10, c), (11, b), (12, "on its own here and there")]
    got = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, 1), (11, 1), (12, 12)}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near_copies_are_found(spark):
    rng, rows = random.Random(4), []
    for k in range(120):
        base = words(rng, rng.randint(60, 300), 3000)
        rows.append((10 * k, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((10 * k + j, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 300
    assert sum(got[a] == got[b] for a, b in pairs) / len(pairs) > 0.99
    near = {i: {b for p in pairs for b in p if i in p} for i in sets}
    assert all(got[i] == i for i in sets if not near[i])


def test_weighted_signatures_estimate_probability_jaccard():
    rng, registers = np.random.default_rng(6), 4096
    for _ in range(6):
        x, y = (np.where(rng.random(40) < 0.7, rng.integers(1, 9, 40), 0).astype(float) for _ in range(2))
        held = []
        for v in (x, y):
            on = np.flatnonzero(v)
            element = minhash.mixed(on.astype(np.uint64) + np.uint64(1))
            held.append(minhash.signatures(np.zeros(len(on), np.int64), element, v[on], 1, registers)[0] & np.uint64(0xFFFFFFFF))
        both = np.flatnonzero((x > 0) & (y > 0))
        want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
        assert (held[0] == held[1]).mean() == pytest.approx(want, abs=0.04)


SLOT = ("<num>", "<unit>", "<name>")


def spaced(text):
    whole = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", decontam.POINT, text or "")
    return regex.sub(rf"(?<=[0-9])({decontam.UNITS})\b", r" \1", whole, flags=regex.I)


def cut(text):
    return [w for w in regex.sub(r"[^\p{L}\p{N}<>]+", " ", text).strip().split(" ")]


def readings(text):
    s = spaced(text)
    t = regex.sub(r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+", "<name>", s)
    t = regex.sub(rf"(?<=[0-9] )(?:{decontam.UNITS})\b", "<unit>", t, flags=regex.I)
    t = regex.sub(rf"[0-9]+(?:{decontam.POINT}[0-9]+)*", "<num>", t)
    return cut(t.lower()), cut(s.lower()), cut(s)


def windows(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def longest(places):
    best = 0
    for p in places:
        n = 0
        while p + n in places:
            n += 1
        best = max(best, n)
    return best


def plain(doc, item, window=6, share=0.5, run=8, cover=0.8):
    """matched, item_windows, slots if the pair counts, else None."""
    dt, dv, ds = readings(doc)
    it, iv, is_ = readings(item)
    n = len(iv)
    size = min(n, window)
    lines = {"t": windows(it, window), "v": windows(iv, size)}
    at = {"t": windows(dt, window), "v": windows(dv, size) if doc else []}
    shifts = {k: {} for k in "tv"}
    for k in "tv":
        for i, h in enumerate(at[k]):
            for p, g in enumerate(lines[k]):
                if g == h:
                    shifts[k].setdefault(i - p, []).append(p)
    found, holds = {}, {}
    for k in "tv":
        codes = {lines[k][p] for ps in shifts[k].values() for p in ps}
        every = len(set(lines[k]))
        inside = {q for ps in shifts[k].values() for p in ps for q in range(p, p + window)}
        found[k] = len(codes), every
        holds[k] = bool(codes) and (len(codes) / every >= share or len(inside) >= cover * n or any(longest(set(ps)) >= run for ps in shifts[k].values()))
    order = sorted(shifts["t"].items(), key=lambda e: (-len(set(e[1])), e[0]))
    there = set()
    for p, kind in enumerate(it):
        if kind in SLOT:
            over = [s for s, ps in order if any(q <= p < q + window for q in ps)]
            if over and 0 <= p + over[0] < len(ds):
                there.add((kind, is_[p], ds[p + over[0]]))
    names, rest = [s for s in there if s[0] == "<name>"], [s for s in there if s[0] != "<name>"]
    once = lambda slots, *k: len({tuple(s[i] for i in k) for s in slots}) == len(slots)
    consistent = once(names, 1) and once(names, 2) and once(rest, 0, 2)
    if not (holds["v"] or (holds["t"] and consistent)):
        return None
    k = max("tv", key=lambda k: (found[k][0] / found[k][1] if found[k][1] else 0, k == "t"))
    return (*found[k], len(there))


FRAME = "{0} has {1} apples and gives {2} of them to {3} on the way to the market before the rain while {0} waits for {4} km"


def test_templates_equal_plain(spark):
    rng = random.Random(7)
    names = ["Peter", "Anna", "Łukasz", "Мария", "Élodie", "Joana", "Frank"]
    vocabulary = "the old river runs by small towns where people sell bread and cheese every morning after rain".split()
    fill = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [FRAME.format("Maria", 12, 5, "Peter", 3), "Short one here", "A quiet road of six words", fill(14) + " and then Anna paid 7 eur for 3 kg of it", fill(9), FRAME.format("Maria", 12, 5, "Peter", 3)]
    docs = [None, "", "so a QUIET road, of six words it was", "It said: short one here."]
    for _ in range(60):
        base = rng.choice(items)
        text = regex.sub(r"[0-9]+", lambda m: str(rng.choice([m[0], rng.randint(1, 40)])), base)
        for name in ("Maria", "Peter", "Anna"):
            if rng.random() < 0.6:
                text = text.replace(name, rng.choice(names))
        w = text.split()
        a = rng.randrange(len(w))
        w = w[a:] + w[:a] if rng.random() < 0.1 else w[rng.choice([0, 0, 2, 6]) :]
        if rng.random() < 0.4:
            w.insert(rng.randrange(len(w) + 1), "indeed")
        docs.append(f"{fill(rng.randint(0, 9))} {' '.join(w)} {fill(rng.randint(0, 9))}")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.item_windows, r.slots) for r in decontam.contaminated(table, asked).collect()}
    want = {(i, k): found for i, d in enumerate(docs) for k, q in enumerate(items) if (found := plain(d, q))}
    assert got.keys() == want.keys() and len(want) > 30
    assert got == want


def test_names_of_any_script(spark):
    item = "Maria has 12 apples and gives 5 of them to Peter before lunch on a cold day in the park"
    copies = {1: item.replace("Maria", "Joana").replace("Peter", "Frank"), 2: item.replace("Maria", "Мария").replace("Peter", "Łukasz"), 3: "nothing of the kind is said in this text at all, not even once"}
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, asked).collect()} == {1, 2}


def test_items_that_share_all_windows(spark):
    asked = spark.createDataFrame([(k, FRAME.format("Maria", 12, 5, "Peter", 3)) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, FRAME.format("Maria", 12, 5, "Peter", 3)), (2, "no")], "doc_id long, text string")
    assert Counter(r.doc_id for r in decontam.contaminated(docs, asked).collect()) == {1: 40}

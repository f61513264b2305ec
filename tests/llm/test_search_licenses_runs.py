"""Lexical search, license scan and periodic runs against brute force, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score bigint, _id string, _text string, _row string, rank int, item_id string, runs string, blocks string"
CLASH = (1, "a", "b", "c", 2, "d", "e", "f")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def table(spark, texts, schema=SCHEMA, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, *CLASH) for i, t in zip(ids, texts)], schema).repartition(3)


def prose(rng, n, words="the of and cat dog run tree house blue sky été naïve x1 zeta".split()):
    return " ".join(rng.choice(words) for _ in range(n))


# ---- lexical search --------------------------------------------------------------------------------

def brute_search(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        weight = {}
        for q in set(terms(text)):
            df = sum(q in w for _, w in held)
            weight[q] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) if df else 0
        for i, w in held:
            m = 50 + (50 * len(w) * n) // length
            score = sum(v * ((10**9 * w.count(q)) // (1000 * w.count(q) + 20 * m)) for q, v in weight.items())
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search_texts():
    rng = random.Random(3)
    rare = [f"w{i}" for i in range(400)]
    texts = [prose(rng, rng.randint(1, 60)) + " " + prose(rng, 8, rare) for _ in range(250)]
    texts += [texts[0]] * 40 + [None, "", " \n.", "THE Cat-dog's", "Ünïcode ünïcode ÉTÉ", prose(rng, 20000, rare), "the " * 3000]
    items = [prose(rng, 12) + " " + prose(rng, 4, rare) for _ in range(25)] + [None, "", "...", "nothing_known qqqq", texts[0], "the", texts[0], prose(rng, 5000, rare)]
    return texts, items


@pytest.mark.parametrize("k", [3, 50])
def test_search(spark, search_texts, monkeypatch, k):
    from mendcast.llm import lexical_search as ls

    # small shards, ranges and query blocks, so that bounds, skipping and merging are used
    for name, value in {"SHARD_POSTINGS": 500, "RANGE": 16, "BLOCK_TERMS": 100}.items():
        monkeypatch.setattr(ls, name, value)
    texts, items = search_texts
    docs = table(spark, texts)
    queries = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    got = ls.ranked_search(docs, queries, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(list(enumerate(texts)), list(enumerate(items)), k)


def test_search_skips_what_cannot_be_found():
    from mendcast.llm import lexical_search as ls

    rng = np.random.default_rng(1)
    n = 4000
    lists = [np.unique(rng.integers(0, n, size)).astype("<i4") for size in (5, 40, 900, 2500)]

    class Packed:
        def __init__(self, a):
            self.a = a

        def as_buffer(self):
            return self.a.tobytes()

    import pyarrow as pa

    row = {"docs": pa.scalar(list(range(n)), pa.list_(pa.int64())), "n": Packed(np.full(n, 20, "<i8")), "term": Packed(np.arange(4, dtype="<i4")),
           "size": Packed(np.array([len(x) for x in lists], "<i4")), "doc": Packed(np.concatenate(lists)),
           "tf": Packed(np.concatenate([rng.integers(1, 9, len(x)) for x in lists]).astype("<i8"))}
    weight = np.array([6000, 4000, 1200, 300])
    shard = ls.Shard(row, weight, n, 20 * n)
    full = np.zeros(n, np.int64)
    np.add.at(full, shard.doc, shard.part)
    best = ls.Best(10)
    looked = []
    add = best.add
    best.add = lambda scores, docs, at: (looked.extend(at), add(scores, docs, at))
    shard.search(np.arange(4, dtype=np.int32), best)
    want = sorted(range(n), key=lambda d: (-full[d], d))[:10]
    assert [r[3] for r in best.rows] == want and [-r[0] for r in best.rows] == full[want].tolist()
    assert len(looked) < 200  # of more than 2,500 documents with a term


def test_search_ids_and_empty_tables(spark):
    from mendcast.llm.lexical_search import ranked_search

    texts = ["a b", "a b", "a c", "d"]
    text_ids = table(spark, texts, SCHEMA.replace("doc_id bigint", "doc_id string"), ["z", None, "b", "c"])
    items = spark.createDataFrame([(None, "A b"), (7, "b"), (7, "b")], "item_id bigint, text string")
    got = [tuple(r) for r in ranked_search(text_ids, items, 2).collect()]
    assert sorted(got, key=str) == brute_search(list(zip(["z", None, "b", "c"], texts)), [(None, "A b"), (7, "b"), (7, "b")], 2)
    none = spark.createDataFrame([], SCHEMA)
    assert ranked_search(none, items).collect() == [] and ranked_search(text_ids, items.where("false")).collect() == []


# ---- licenses --------------------------------------------------------------------------------------

def brute_licenses(text):
    from mendcast.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD

    ws = terms(text)
    places = sorted((p, label) for phrase, label in PHRASES for p in range(len(ws)) if ws[p: p + len(terms(phrase))] == terms(phrase))
    hits = []
    for t, (label, template) in enumerate(TEMPLATES):
        tokens, size = set(terms(template)), 8
        while size < len(terms(template)):
            size *= 2
        for begin in range(0, max(len(ws), 1), size):
            shared = tokens & set(ws[begin: begin + 2 * size])
            if 100 * len(shared) >= round(100 * THRESHOLD) * len(tokens):
                hits.append((begin, begin + 2 * size, t, label, shared, len(tokens)))
    named = [h for h in hits if not any(
        o[0] < h[1] and o[1] > h[0] and (h[4] < o[4] or (h[4] == o[4] and o[5] < h[5])) for o in hits)]
    base = {label for _, label in places}
    return (len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
            ",".join(sorted(base | {h[3] for h in named})), 1.0 if places else max([len(h[4]) / h[5] for h in hits], default=0.0))


LINES = [
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "licensed under CC BY-NC-SA 4.0", "licensed under the GNU Lesser General Public License version 3",
]


def test_licenses(spark):
    from mendcast.llm.license_scan import TEMPLATES, document_labels, scan_licenses

    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 70)) + " " + line + "\n" + prose(rng, rng.randint(0, 70)) for line in LINES + [t for _, t in TEMPLATES] for _ in range(3)]
    texts += [f"{a} {b}" for a in LINES for b in LINES[:3]]
    vocabulary = sorted({w for _, t in TEMPLATES for w in terms(t)})
    texts += [prose(rng, 300, vocabulary) for _ in range(30)]  # many partial overlaps
    edited = [t.split() for _, t in TEMPLATES if len(t.split()) > 12]
    texts += [" ".join(w if rng.random() > 0.08 else "other" for w in e) for e in edited for _ in range(4)]
    texts += [None, "", "...", "mit", "MIT\nlicense mit license", "cc by cc by", "gnu general public", "x " * 9000 + LINES[1], LINES[0], LINES[0]]
    docs = table(spark, texts)
    got = {r[0]: tuple(r)[1:] for r in document_labels(docs).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    labels = {line: got[len(texts) - 1][5] if line == LINES[0] else brute_licenses(line)[5] for line in LINES}
    assert labels[LINES[0]] == "gpl,gpl-3.0" and labels[LINES[2]] == "cc-by,cc-by-nc-4.0" and labels[LINES[4]] == "all-rights-reserved"
    blocks = {r["_id"]: r["blocks"] for r in scan_licenses(docs).collect()}
    last = blocks[len(texts) - 1]
    assert any(b["label"] == "gpl-3.0" and b["containment"] == 1.0 and b["named"] and b["first_word"] == 0 for b in last)
    assert any(b["label"] == "lgpl-3.0" and not b["named"] for b in last)
    assert document_labels(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- periodic runs ---------------------------------------------------------------------------------

def brute_runs(ws):
    out = set()
    for q in range(1, len(ws) // 4 + 1):
        i = q
        while i < len(ws):
            j = i
            while j < len(ws) and ws[j] == ws[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and not any((i - q, j - i + q, p) in out for p in range(1, q)):
                out.add((i - q, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a\x0ba\x0ca a\ra a", "a b a b a b a", "a b a b a b a b", "a b " * 6, "é è " * 7, "a a a a a a", "a a a a a a"]
    out += [prose(rng, n, "a b".split()) for n in (10, 40, 200) for _ in range(60)]
    out += [prose(rng, 300, "a b c d e f".split()) for _ in range(40)]
    for _ in range(150):
        unit = prose(rng, rng.randint(1, 40), "a b c d".split()).split()
        inner = unit * rng.randint(2, 5) + unit[: rng.randint(0, len(unit))]
        whole = prose(rng, rng.randint(0, 20), "a b c".split()).split() + inner * rng.choice((1, 1, 4)) + prose(rng, 9, "a b c".split()).split()
        out.append(" ".join(whole))
    return out


def test_runs_equal_brute_force(spark):
    from mendcast.llm.periodic_runs import periodic_runs

    texts = periodic_texts()
    got = {r["_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = brute_runs(ws)
        assert got[i] == (want, collapsed(ws, want)), t
    assert sum(len(r) for r, _ in got.values()) > 500
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_of_long_texts():
    from mendcast.llm.periodic_runs import runs_of_texts

    rng = random.Random(8)
    unit = prose(rng, 30_000, [f"w{i}" for i in range(50)]).split()
    (found, rest), (same, one), = runs_of_texts([" ".join(["x", *unit * 4, "y"]).encode(), b"a " * 200_000])
    assert (1, 120_000, 30_000) in found and rest.split()[0] == b"x" and rest.split()[-1] == b"y" and len(rest.split()) <= 30_002
    assert same == [(0, 200_000, 1)] and one == b"a"


def test_runs_query(spark, tmp_path):
    from mendcast.llm.queries import QUERIES

    rng = random.Random(9)
    texts = periodic_texts()[::3] + [prose(rng, rng.randint(1, 400)) for _ in range(300)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if j < a else ws[a + (j - a) % p] for j, w in enumerate(ws)]
            planted += 1
        runs = brute_runs(ws)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(ws, runs))]
        want = dict(zip("start length period".split(), best or (None,) * 3))
        assert got[i] == {"doc_id": i, "n_runs": len(runs), **want, "exponent_milli": 1000 * best[1] // best[2] if best else None,
                          "runs_sha256": sha[0], "collapsed_sha256": sha[1]}
    assert planted > 20

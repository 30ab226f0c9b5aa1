"""Periodic runs, ranked search and MinHash near-duplicates against plain Python and DuckDB."""

from __future__ import annotations

import math
import os
import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures
from compare import duck, mismatch
from holdfast.llm import minhash_dedup, periodic_runs, queries, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).cache()


@pytest.fixture(scope="module")
def pairs():
    return {row[0]: row[1] for row in fixtures.rows()}


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_ranked_search", "op13_minhash_dedup"])
def test_queries_equal_their_texts(spark, sf_dir, name):
    assert mismatch(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.TEXTS[name]) is None


def all_runs(words: list[str]) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def repetitive(pick: random.Random, n: int) -> str:
    words = [f"w{pick.randint(0, pick.choice([0, 1, 2, 5, 40]))}" for _ in range(n)]
    for _ in range(pick.randint(0, 3)):
        start, period, end = pick.randrange(n), pick.randint(1, max(1, n // 3)), pick.randint(1, n)
        for i in range(start + period, end):
            words[i] = words[i - period]
    return pick.choice([" ", "\n", " \t"]).join(words)


@pytest.mark.parametrize("tile_words", [24, 4096])
def test_periodic_runs(spark, docs, tile_words):
    pick = random.Random(4)
    texts = [repetitive(pick, pick.randint(1, 200)) for _ in range(300)] + ["x " * 5000, " a b c" * 900 + " d"]
    texts += [None, "", " \n", "é ü " * 8, texts[0]]
    made = [(i % 290 or None, t, 0, 0, 0) for i, t in enumerate(texts)]
    # Extra columns that have names used inside.
    frame = spark.createDataFrame(made, "doc_id long, text string, doc long, period long, runs long")
    expected = []
    for doc_id, text, *_ in made:
        words = fixtures.WORD.findall(text or "")
        runs = all_runs(words)
        gone = {i for start, period, length in runs for i in range(start + period, start + length)}
        expected.append((doc_id, runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapsed(frame, tile_words).collect()]
    assert sum(bool(runs) for _, runs, _ in expected) > 60
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert periodic_runs.collapsed(docs).count() == docs.count()
    assert periodic_runs.collapsed(docs.limit(0)).count() == 0


def test_tiles_of_a_long_text_are_dealt(spark):
    pick = random.Random(6)
    words = [f"w{pick.randint(0, 9999)}" for _ in range(6000)]
    words[1000:5000] = (words[100:150] * 80)[:4000]
    frame = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    cut = frame.selectExpr("doc_id AS doc", "text").mapInArrow(periodic_runs.dealt(256), periodic_runs.TILES)
    sizes = dict(cut.groupBy("octave").agg(F.max(F.length("codes") / 4)).collect())
    assert cut.count() >= 20 and all(n <= max(256, 8 * periodic_runs.stride(k)) + 6 * periodic_runs.reach(k) for k, n in sizes.items())
    [row] = periodic_runs.collapsed(frame, 256).collect()
    assert [tuple(x) for x in row.runs] == all_runs(words) != []


def best(texts: dict, items: dict, top: int) -> list[tuple]:
    held = {i: Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in texts.items()}
    held = {i: c for i, c in held.items() if c}
    n, total = len(held), sum(c.total() for c in held.values())
    rows = []
    for item, terms in items.items():
        scores = []
        for doc, own in held.items():
            m = 10 + (90 * own.total() * n) // total
            score = 0
            for term in terms:
                if own[term]:
                    df = sum(term in c for c in held.values())
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * own[term]) // (1000 * own[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        rows += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(rows)


@pytest.mark.parametrize("short, block", [(4, 1 << 24), (1, 2000), (1 << 20, 2000), (2, 300)])
def test_ranked_search(spark, pairs, short, block, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    pick = random.Random(8)
    texts = {i: t for i, t in pairs.items() if len(t or "") < 5000}
    texts |= {200 + i: " ".join(pick.choices(["Alpha", "beta,", "γάμμα", "x9", "a.b"], k=pick.randint(1, 30))) for i in range(120)}
    texts |= {400: "same words, twice", 399: "Same words, twice", 401: "--- !!"}
    asked = [(i, texts[pick.choice(list(texts))]) for i in range(30)]
    asked += [(30, "same"), (30, "words"), (31, "beta alpha γάμμα x9 b"), (32, None), (33, "?!"), (34, "unheard"), (None, "alpha")]
    terms: dict[int, set] = {}
    for item, text in asked:
        if item is not None:
            terms.setdefault(item, set()).update(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    frame = spark.createDataFrame([(i, t, 0, "s") for i, t in texts.items()], "doc_id long, text string, item_id long, score string").repartition(3)
    items = spark.createDataFrame(asked, "item_id long, text string")
    found = sorted(tuple(r) for r in ranked_search.ranked(frame, items, 7, short).collect())
    assert found == best(texts, terms, 7)


def test_ranked_search_of_awkward_rows(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "item_id long, text string")
    made = spark.createDataFrame([(None, "alpha alpha"), (5, "alpha"), (5, "alpha"), (6, None)], "doc_id long, text string")
    rows = ranked_search.ranked(made, items).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in rows] == [(1, 1, 5), (1, 2, 5)] and rows[0].score == rows[1].score > 0
    assert ranked_search.ranked(docs.limit(0), items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0
    benchmark = docs.selectExpr("doc_id AS item_id", "text").where("length(text) < 3000")
    whole = sorted(tuple(r) for r in ranked_search.ranked(docs, benchmark).collect())
    monkeypatch.setattr(ranked_search, "PART_TERMS", 200)
    assert sorted(tuple(r) for r in ranked_search.ranked(docs, benchmark).collect()) == whole


@pytest.mark.parametrize("block", [2, 64])
def test_minhash_dedup(spark, docs, pairs, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    pick = random.Random(9)
    texts = {i: t for i, t in pairs.items() if len(t or "") < 5000}
    base = [f"v{i}" for i in range(90)]
    for i in range(60):  # a chain of copies whose ends are far apart, and loose texts that share a half
        base[pick.randrange(90)] = f"n{i}"
        texts[300 + i] = " ".join(base)
        texts[400 + i] = " ".join([*base[:60], *(f"o{i}x{k}" for k in range(25))])
    made = [(i, t, 1, "x", 0) for i, t in texts.items()] + [(None, texts[300], 1, "x", 0), (301, texts[301], 1, "x", 0), (None, None, 1, "x", 0)]
    frame = spark.createDataFrame(made, "doc_id long, text string, n long, key string, component long")
    expected = fixtures.groups(list(texts.items()), 2, 80)
    found = minhash_dedup.near_duplicates(frame).collect()
    assert len(found) == len(made)
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id) == expected[row.doc_id] and row.kept == (row.doc_id == row.component_id)
    assert minhash_dedup.near_duplicates(docs).count() == docs.count()
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_loose_members_of_a_bucket_meet(spark, monkeypatch):
    # Members of one bucket: two that no centre is linked with, yet with each other, in blocks of their own.
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    plan = minhash_dedup.Plan(bands=1, rows=2, least_equal=2)
    sketch = "abcd" + "e" * (minhash_dedup.PARITIES // 8)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (9, 9), (10, 9), (11, 9)], "id long, component long")
    members = spark.createDataFrame([(7, i, 9) for i in range(1, 12)], "bucket long, id long, size long")
    known = members.selectExpr("id", "10L AS n", f"CAST('{sketch}' AS binary) AS sketch")
    group = dict(labels.collect())
    expected = {(a, b) for a in range(1, 12) for b in range(a + 1, 12) if group.get(a, a) != group.get(b, b)}
    assert {tuple(r) for r in minhash_dedup.third_round(members, labels, known, plan).collect()} == expected


def test_star_components(spark):
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(pick.randint(200, 260), pick.randint(200, 260)) for _ in range(40)]
    label = {i: i for link in links for i in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = dict(minhash_dedup.star_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: c for i, c in label.items() if any(i in link and link[0] != link[1] for link in links)}

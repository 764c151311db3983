import random
import re

import numpy as np
import pytest
from graphloom.llm import ngram_join
from graphloom.llm.trie_join import link_components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                t[rng.randrange(len(t))] = rng.choice(words)
            t += rng.choices(words, k=rng.choice((0, 0, 3)))
        else:
            t = rng.choices(words, k=rng.choice((1, 3, 8, 30, 60)))
        texts.append(" ".join(t))
    return [(i * 3, t.upper() if rng.random() < 0.2 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("blocks", [False, True])
def test_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 1500)
        monkeypatch.setattr(ngram_join, "ENTRIES", 200)
    rows = corpus(random.Random(4 + blocks), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(tuple(r) for r in ngram_join.shingle_components(docs).collect())
    assert found == brute(rows)


def test_shingles_by_chance_make_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", 32)  # as in a large corpus, the sketch can't tell rare shingles apart
    rng, seen = random.Random(7), []
    units = ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda candidates, percent: seen.append(candidates.count()) or units(candidates, percent))
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(rng.randint(90, 120))]
        rows.append((k, " ".join(own + passages[k] + passages[(k + 1) % 60])))
    rows.append((99, rows[5][1] + " tail"))
    found = sorted(tuple(r) for r in ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == brute(rows)
    assert 2 <= seen[0] < 10


@pytest.mark.parametrize("few", [1, 2, 5])
def test_pairs_and_runs_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "ENTRIES", 300)
    monkeypatch.setattr(ngram_join, "CELLS", 32)
    rows = corpus(random.Random(20 + few), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join.shingle_components(docs).collect()) == brute(rows)


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(3000):
        n, m, both = rng.integers(1, 300), rng.integers(0, 60), rng.integers(0, 60)
        s = rng.integers(0, 1 << 63, n + m + both, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(s[: n + m]), np.unique(np.concatenate([s[:n], s[n + m :]]))
        shared = len(np.intersect1d(a, b))
        linked = 100 * shared >= 75 * (len(a) + len(b) - shared)
        may = ngram_join._may_link(len(a), ngram_join._parity(a), len(b), ngram_join._parity(b), 75)
        assert may or not linked
        ruled_out += not may
    assert ruled_out > 500


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (9, "one TWO"), (None, "one two"), (None, "alone here"), (3, "x " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int")
    found = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()), key=str)
    assert found == sorted([("5", 0, 5), ("6", 0, 6), ("7", 0, 7), ("8", 1, 8), ("9", 1, 8), ("9", 1, 8), ("None", 1, 8), ("None", 1, None), ("3", 1, 3)], key=str)
    assert ngram_join.shingle_components(docs.limit(0)).collect() == []


def test_trie_matches_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        sets, n = [], rng.randint(1, 25)
        for _ in range(n):
            s = set(rng.choice(sets).tolist()) ^ {rng.randrange(50)} if sets and rng.random() < 0.6 else set(rng.choices(range(50), k=rng.randint(1, 25)))
            sets.append(np.array(sorted(s or {1}), np.uint64))
        side = np.array([rng.randint(0, 1) for _ in sets]) if rng.random() < 0.4 else None
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if (side is None or side[i] != side[j]) and 100 * len(a & b) >= 75 * len(a | b):
                    x, y = label[i], label[j]
                    label = [min(x, y) if v in (x, y) else v for v in label]
        assert link_components(sets, 75, side).tolist() == label

"""The pipeline's stages against plain versions of them, on rows with copies, secrets, nulls, ties and repeats."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from graphloom.llm import decision_list, queries
from graphloom.llm.text_stats import RATIOS
from pyspark.sql import functions as F
from test_lines_secrets_stats import GAP, spans, stats, whole_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int"


def rows():
    rng = random.Random(31)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))

    passage = words(35) + "\n" + words(12)
    texts = [f"{words(20)}\n{passage}\n{words(15)}" for _ in range(6)] + [words(rng.randint(10, 120)) for _ in range(20)]
    for t in texts[6:12]:
        own = t.split()
        texts += [t, " ".join(own[: len(own) // 2] + ["x"] + own[len(own) // 2 :]), " ".join(reversed(own))]
    texts += [f"{words(12)} password = hunter2{k} {words(5)} AKIA{'Q7' * 9} {words(3)}" for k in range(4)]
    texts += [f"{words(14)} token=abc{k}def deadbeef{'0a' * 12}" for k in range(2)]
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}", len(t), i) for i, t in enumerate(texts)]
    return out + [(500, None, None, None, None, 1), (501, "", "en", "s", 0, 2), (502, " \n\t", "en", "s", 3, 3), out[3], out[-1], (None, words(30), "en", "s", 200, 4)]


def key(d):
    return (1 << 62) if d is None else d


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def least_of_components(docs):
    """The doc_id of each document that stays: the least of those that links reach, over all pairs."""
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    return {min((key(docs[i][0]), docs[i][1]) for i in range(len(docs)) if group[i] == group[k])[0] if sets[k] else key(docs[k][0]) for k in range(len(docs))}


def redacted(text):
    out, at = [], -1
    for start, _, end in spans(text):
        if start > at:  # spans that touch are one
            out.append(text[max(at, 0) : start] + "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[max(at, 0) :]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(501, 0), (None, 0), (3, None)], "doc_id long, quality int")
    labels.write.parquet(f"{at}/labels.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        seen.append(docs.collect())
    return seen


def test_quality_keeps_rows_as_they_are(staged):
    start, kept = staged[0], staged[1]
    assert {tuple(r) for r in kept} <= {tuple(r)[:5] for r in start}
    assert sum(len((r["text"] or "").split()) > 9 for r in kept) >= 0.9 * sum(len((r["text"] or "").split()) > 9 for r in start)


def test_line_dedup_stage(staged):
    before, after = staged[1], staged[2]
    want = whole_runs(list({(key(r["doc_id"]), r["text"]) for r in before}))
    full = lambda t: [x for x in (GAP.sub(" ", x).strip(" ") for x in (t or "").split("\n")) if x]
    left = {}
    for r in after:
        left.setdefault(key(r["doc_id"]), []).append(full(r["text"]))
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    for d, lines in want.items():
        gone = not lines and any(full(r["text"]) for r in before if key(r["doc_id"]) == d)
        assert (d not in left) if gone else all(x == lines for x in left[d])


def test_near_duplicates_stage(staged):
    before, after = staged[2], staged[3]
    docs = list({(r["doc_id"], r["text"]) for r in before})
    assert sorted(key(r["doc_id"]) for r in after) == sorted(least_of_components(docs))


def test_secrets_stage(staged):
    before = {key(r["doc_id"]): r["text"] for r in staged[3]}
    assert len(staged[4]) == len(staged[3])
    for r in staged[4]:
        text = before[key(r["doc_id"])]
        assert r["text"] == (None if text is None else redacted(text)) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    assert any("[SECRET]" in (r["text"] or "") for r in staged[4])


def test_packing_stage(staged):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    for r in staged[4]:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((p for p in staged[5] if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)


def test_empty_tables_pass_every_stage(spark, staged, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_decision_list_verdicts_by_hand(spark):
    rng = random.Random(17)
    texts = [" ".join(w + rng.choice(("#", "$", "")) * (i % 3 == 0) for w in (rng.choice(["alpha", "bet", "c", "delta"]) + str(rng.randrange(50)) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    texts += [None, "", "a b c d e " * 12, "one two three four five six seven eight nine ten"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(0, texts[0], False)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    judged, rules = decision_list.apply_rules(docs, labels)
    assert rules
    for r in judged.withColumns({f"r_{k}": F.expr(v) for k, v in RATIOS.items()}).collect():
        n_words, *_, repeated = stats(texts[r["doc_id"]])
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        met = [k for k, rule in enumerate(rules, 1) if all((r[c.feature] > c.threshold) if c.above else (r[c.feature] <= c.threshold) for c in rule)]
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, met[0] if met else 0, not failed and not met)
    assert judged.count() == len(texts) + 1


def test_near_duplicates_take_no_candidates_by_chance(spark, monkeypatch):
    from graphloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CELLS", 32)  # as in a large corpus, the sketch can't tell rare shingles apart
    seen, units = [], ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda candidates, percent: seen.append(candidates.count()) or units(candidates, percent))
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(40)]
    texts = [" ".join([*(f"o{k}x{i}" for i in range(100)), passages[k], passages[(k + 1) % 40]]) for k in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, texts[7] + " tail"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(40))
    assert 2 <= seen[0] < 10

import random
from hashlib import sha256

import corpus_pipeline
from graphloom.llm import bpe, cotraining, queries


def test_cotraining_on_held_out_labels(spark):
    rng = random.Random(9)

    def text(good):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
        return " ".join(words if good else [w + rng.choice(("%%%", "***", "")) for w in words])

    rows = [(i, text(i % 4 > 0), "en", f"src{i % 4 if i % 5 else 9}", 300) for i in range(400)] + [(900, None, None, None, None), (901, "", "xx", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in cotraining.classify_quality(docs, labels).collect()}
    held_out = [i for i in range(400) if i % 3]
    assert sum(found[i]["kept"] == (i % 4 > 0) for i in held_out) >= 0.97 * len(held_out)
    assert len(found) == 402
    blind = cotraining.classify_quality(docs.select("doc_id", "text"), labels.limit(0)).collect()
    assert all(r["quality_score"] == 0.5 and r["kept"] for r in blind)
    assert cotraining.classify_quality(docs.limit(0), labels).count() == 0


def test_bpe_matches_tiktoken(spark):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bpe.load_ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "  a  b ", "x\n\n y", "I'll don't 'S ", "a\0b c\0 d", "　ü  ", "é" * 50, "a" * 500, "<|endoftext|> hi", "tab\t tab \t", "日本語 テスト", "end\n", " lead", "a b c a b c"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id long, text string, ids int")
    rows = bpe.encode_texts(docs, ranks, PATTERN).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == plain.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"])
    assert bpe.encode_texts(docs.limit(0), ranks, PATTERN).count() == 0


def test_bpe_query_columns_match_tiktoken(spark, tmp_path, monkeypatch):
    """The query's own columns, with few common words, small caches, repeated rows and a match of over 1 MiB."""
    import tiktoken
    from public_tokenizers import PATTERN

    rng = random.Random(11)
    monkeypatch.setattr(bpe, "COMMON_WORDS", 40)
    monkeypatch.setattr(bpe, "COMMON_ROW", 10)
    ranks = bpe.load_ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def word():
        return "".join(rng.choices("etaoinsré'-1.", k=rng.randint(1, 14)))

    vocabulary = [word() for _ in range(60)]
    texts = [None, "", "".join(rng.choices("abcdeé", k=1_200_000)) + " end", "ab" * 600_000, " " * 3000 + "x", "\n\n  \tx \n", "a\0 b"]
    texts += [rng.choice(("", " ", "  ", "\n")).join(rng.choice(vocabulary) if rng.random() < 0.8 else word() for _ in range(rng.randint(0, 80))) for _ in range(120)]
    texts += ["".join(rng.choices("abc", k=n)) for n in (255, 256, 257, 258, 1000)]
    rows = [(i, t, b"x", "clash") for i, t in enumerate(texts)] + [(9, texts[9], b"", ""), (None, "no id", b"", "")]
    spark.createDataFrame(rows, "doc_id long, text string, decoded binary, n_tokens string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_byte_bpe(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted([*range(len(texts)), 9])
    for r in found:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest()), r["doc_id"]
        assert r["decoded_sha256"] == sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    kept = {r["doc_id"] for r in seen["quality classifier"]}
    assert all(d in kept for d, q in labels.items() if q == 1 and len((start[d]["text"] or "").split()) > 9)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    assert {r["doc_id"] for r in seen["line dedup"]} <= kept and all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"])
    assert len({r["doc_id"] for r in seen["n-gram Jaccard join"]}) == len(seen["n-gram Jaccard join"])
    assert len(seen["secret scans"]) == len(seen["n-gram Jaccard join"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["secret scans"]}
    assert corpus_pipeline.packing(spark, corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/0").limit(0), sf), sf).count() == 0

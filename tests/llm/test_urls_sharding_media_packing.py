import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from graphloom.llm import packing, queries, sharding, telephony, url_filter
from pyspark.sql import functions as F


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards)
    counts = np.bincount(table)
    assert sharding.is_prime(len(table)) and counts.max() - counts.min() <= 1
    without = sharding.lookup_table(shards[:-1], len(table))
    assert sum(a != b for a, b in zip(table, without, strict=True) if a != 6) < 0.15 * len(table)
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "k long, slot string")
    found = sharding.assign_shards(docs, "k", shards).collect()
    for r in found:
        slot = sharding._hash("" if r["k"] is None else str(r["k"])) % len(table)
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    assert len(found) == 4 and sharding.assign_shards(docs.limit(0), "k", shards).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_url_rules_and_trees(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://b.net/de", "https://x.example.com/de/1", "http://y.org/fr/", "http://y.org/en", "ftp://example.net", "http://net/x", "http://h/p#/q?z"]
    urls += [f"http://site{i}.test/en/{i}" for i in range(200)] + [f"http://casino-win{i}.test/{i}?a=1&b=2" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    label = F.col("host").contains("casino").cast("int")
    found = {r["page_id"]: r for r in url_filter.filter_urls(pages, queries.URL_RULES, label).collect()}
    parts = [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("b.net", "/de"), ("x.example.com", "/de/1"), ("y.org", "/fr/"), ("y.org", "/en"), ("example.net", ""), ("net", "/x"), ("h", "/p")]
    assert [(found[i]["host"], found[i]["path"]) for i in range(11)] == parts
    assert [found[i]["rule"] for i in range(11)] == [None, None, None, "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, "net/", None]
    assert [found[i]["verdict"] for i in (3, 4, 5, 6, 9)] == ["allow", "block", "block", "allow", "block"]
    bad = [found[i]["verdict"] == "block" for i in range(211, 271)]
    assert all(found[i]["verdict"] == "allow" for i in range(11, 211)) and all(bad)
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, label).count() == 0
    x = np.array([[random.Random(i).randrange(100), i % 7] for i in range(400)])
    y = (x[:, 0] > 50).astype(float)
    base, trees = url_filter.boost(x[:300], y[:300])
    score = base + sum(url_filter._predict(t, x[300:]) for t in trees)
    assert ((score > 0) == (y[300:] == 1)).mean() > 0.95


def test_url_trees_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    pages = pages.union(pages.filter("page_id % 50 = 0")).withColumn("verdict", F.lit("clash"))
    bad = F.col("host").rlike("(^|[.-])(" + "|".join(queries.BAD_HOST_WORDS) + ")([.-]|$)").cast("int")
    unseen = F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0
    found = url_filter.filter_urls(pages, queries.URL_RULES, F.when(~unseen, bad))
    assert found.count() == pages.count()
    judged = found.filter(unseen & F.col("rule").isNull()).select(bad.alias("bad"), (F.col("verdict") == "block").cast("int").alias("blocked")).collect()
    assert sum(r["bad"] for r in judged) and sum(r["bad"] == r["blocked"] for r in judged) >= 0.95 * len(judged)


def test_tree_columns_give_what_the_trees_predict(spark):
    """Scores of the conditional expressions against the trees in numpy, for features of random URLs."""
    rng = random.Random(14)
    urls = ["http://" + "".join(rng.choices("ab-.1", k=rng.randint(1, 30))) + "/" + "".join(rng.choices("x/1?&", k=rng.randint(0, 20))) for _ in range(200)] + [None, ""]
    parsed = url_filter.parse_urls(spark.createDataFrame(list(enumerate(urls)), "id long, url string")).withColumn("y", (F.length("host") % 2).cast("int"))
    model = url_filter.train(parsed, "y")
    assert model.trees
    names = [f"f_{k}" for k in url_filter.FEATURES]
    rows = url_filter.lexical(parsed, "url", model.suffix_column()).select("id", *names).collect()
    scores = {r["id"]: r["url_score"] for r in model.score(parsed, "url").collect()}
    x = np.array([[r[n] for n in names] for r in rows])
    want = model.base + sum(url_filter._predict(t, x) for t in model.trees)
    assert np.allclose([scores[r["id"]] for r in rows], want)


def ima(block):
    """One block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for code in itertools.chain.from_iterable((b & 15, b >> 4) for b in block[4:]):
        step = int(telephony._IMA_STEPS[index])
        move = (step >> 3) + sum(step >> s for bit, s in ((4, 0), (2, 1), (1, 2)) if code & bit)
        value = max(-32768, min(32767, value + (-move if code & 8 else move)))
        index = max(0, min(88, index + int(telephony.IMA_INDEX_MOVE[code & 7])))
        out.append(value)
    return out


def test_codecs():
    assert telephony.MULAW[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [ima(bytes(b)) for b in blocks]
    data = rng.integers(0, 256, 512, dtype=np.uint8).tobytes()
    for codec in telephony.CODECS:
        tag, rate, _, back = telephony.unpack(telephony.pack(data, codec))
        assert (tag, rate, back) == (telephony.CODECS[codec], 8000, data)
    assert telephony.resample(np.array([0, 100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 100]
    for bad in (b"", b"RIFF1234WAVE", telephony.pack(data)[:-9]):
        with pytest.raises(ValueError):
            telephony.unpack(bad)


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 100, "x" * 64, "y" * 65]
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    for r in telephony.digest_media(telephony.store_texts(docs)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
    media = spark.createDataFrame([(1, telephony.pack(b"\x00\x80")), (2, None), (3, b"junk")], "id long, media binary")
    rows = {r["id"]: r for r in telephony.decode_media(media).collect()}
    assert np.frombuffer(rows[1]["pcm"], "<i2").tolist() == [-32124, 0, 32124, 32124] and rows[2]["pcm"] is None and rows[3]["error"]
    assert telephony.digest_media(telephony.store_texts(docs.limit(0))).count() == 0


def plain_pcm(media):
    """Samples at 16 kHz of a file, one by one, by its format's own rule."""
    tag, rate, block, data = telephony.unpack(media)
    if tag == telephony.FORMAT_IMA:
        pcm = [s for at in range(0, len(data), block) for s in ima(data[at : at + block])]
    else:
        pcm = [int((telephony.MULAW if tag == telephony.FORMAT_MULAW else telephony.ALAW)[b]) for b in data]
    assert rate == 8000
    return [(v if k % 2 == 0 else (v + pcm[min(k // 2 + 1, len(pcm) - 1)]) // 2) for k in range(2 * len(pcm)) for v in [pcm[k // 2]]]


def test_text_digests_match_a_plain_reading(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "é" * 100, "x" * 64, "y" * 65, "a", *("".join(rng.choices("ab é\n", k=rng.randint(0, 300))) for _ in range(30)), "long " * 20_000]
    docs = spark.createDataFrame([(i, t, b"m", 1) for i, t in enumerate(texts)] + [(None, "no id", b"", 2)], "doc_id long, text string, media binary, n_bytes int")
    stored = {r["doc_id"]: bytes(r["media"]) for r in telephony.store_texts(docs).collect()}
    assert {telephony.unpack(m)[0] for m in stored.values()} == {telephony.CODECS[c] for c in telephony.TEXT_CODECS}
    found = telephony.digest_media(telephony.store_texts(docs)).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        raw = ("no id" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = stored[r["doc_id"]]
        assert telephony.unpack(media)[3] == payload
        assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
        pcm = plain_pcm(media)
        squares = int((sum(v * v for v in pcm) // len(pcm)) ** 0.5)
        crossings = sum((a < 0) != (b < 0) for a, b in itertools.pairwise(pcm))
        raw_pcm = np.array(pcm, "<i2").tobytes()
        assert r["feature"] == f"ms={len(pcm) // 16};peak={max(map(abs, pcm))};rms={squares};crossings={crossings};crc={zlib.crc32(raw_pcm)}"
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(raw_pcm), hashlib.sha256(raw_pcm).hexdigest())


def test_malformed_media_have_errors(spark):
    data = bytes(range(256)) * 2
    good = {c: telephony.pack(data, c) for c in telephony.CODECS}
    at = good["mulaw"].index(b"fmt ") + 8
    no_rate = good["mulaw"][: at + 4] + bytes(4) + good["mulaw"][at + 8 :]
    short_format = b"RIFF" + (28).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + good["mulaw"][at : at + 8]
    stereo = good["mulaw"][: at + 2] + b"\2\0" + good["mulaw"][at + 4 :]
    cut_header = telephony.pack(data[:258], "ima")
    half_sample = telephony.pack(data[:5], "pcm")
    bad = [b"", b"RIFF", no_rate, short_format, stereo, cut_header, half_sample, good["pcm"][:-3], good["ima"].replace(b"\x11\0", b"\x99\0", 1)]
    rows = [(i, len(m), m) for i, m in enumerate([*good.values(), *bad])] + [(90, None, None), (91, 0, telephony.pack(b"")), (92, 0, telephony.pack(data[:300], "ima"))]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    decoded = {r["doc_id"]: r for r in telephony.decode_media(media.withColumn("error", F.lit(1))).collect()}
    digests = {r["doc_id"]: r for r in telephony.digest_media(media).collect()}
    assert all(decoded[i]["error"] is None for i in (0, 1, 2, 3, 90, 91, 92)) and all(decoded[i]["error"] for i in range(4, 13))
    assert all(digests[i]["feature"].startswith("error=") and digests[i]["media_sha256"] and digests[i]["pcm_bytes"] is None for i in range(4, 13))
    assert digests[90]["feature"] is None and digests[90]["media_bytes"] is None and digests[91]["pcm_bytes"] == 0
    for i in (0, 1, 2, 3, 92):
        assert digests[i]["pcm_sha256"] == hashlib.sha256(decoded[i]["pcm"]).hexdigest() and digests[i]["feature"] == decoded[i]["feature"]
    short = ima(data[:256]) + ima(data[256:300])
    assert np.frombuffer(decoded[92]["pcm"], "<i2")[::2].tolist() == short


def test_closest_fill_matches_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        space = rng.randint(0, 40)
        taken = packing.closest_fill(counts, space)
        assert all(n <= counts[k] for k, n in taken.items())
        best = max(s for s in (sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in itertools.product(*[range(c + 1) for c in counts.values()])) if s <= space)
        assert sum(k * n for k, n in taken.items()) == best


def test_packing_of_whole_windows_and_equal_lengths(spark):
    """Most rows have one length: whole windows, and empty texts as fillers of one id."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = ["the " * 4095] * 40 + ["the " * 9000] * 5 + [""] * 300 + [None] * 7 + ["the " * k for k in (1, 2, 4094, 4090, 100, 100)]
    docs = spark.createDataFrame([(i % 50, t, 5, "x") for i, t in enumerate(texts)] + [(None, "the", 6, "y")], "doc_id long, text string, length int, sequence_id string").repartition(5)
    rows = packing.pack_documents(docs, packing.word_tokenizer(spark, path)).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(len((t or "").split()) + 1 for t in texts) + 2
    assert sum(r["length"] for r in rows) == total and len(by_sequence) <= -(-total // packing.WINDOW) + 1
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_packing_is_gapless(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [None, "", "It's <|endoftext|> Ünï x\x1cy ΣΑΣ", *(" ".join(rng.choices(["the", "cat's", "Haus,", "été", "x1y", "日本"], k=rng.choice((1, 40, 300, 9000)) + rng.randrange(90))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, packing.word_tokenizer(spark, path)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // packing.WINDOW) + 1
    assert packing.pack_documents(docs.limit(0), packing.word_tokenizer(spark, path)).count() == 0

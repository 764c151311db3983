import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from graphloom.llm import decision_list, line_dedup, secret_scan, text_stats

GAP = re.compile(r"[ \t-\r]+")


def dedup(rows, min_words=line_dedup.MIN_WORDS, max_lines=line_dedup.MAX_LINES):
    seen, gone = {}, set()
    for d, text in sorted(rows):
        lines = [(no, GAP.sub(" ", x).strip(" ")) for no, x in enumerate((text or "").split("\n"))]
        lines = [(no, x) for no, x in lines if x]
        for i in range(len(lines)):
            n = words = 0
            while i + n < len(lines) and n < max_lines and words < min_words:
                words += len(lines[i + n][1].split(" "))
                n += 1
            if words < min_words and n < max_lines:
                continue
            content = tuple(x for _, x in lines[i : i + n])
            if content in seen:
                gone |= {(d, no) for no in range(lines[i][0], lines[i + n - 1][0] + 1)}
            seen.setdefault(content, d)
    return {d: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone) for d, t in rows}


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choices(["a", "b", "cc", "é"], k=rng.choice((1, 2, 9, 35)))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 15)))) for i in range(60)] + [(90, None), (91, ""), (92, "x y\n" * 3000)]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_lines int").repartition(4)
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    want = dedup(rows)
    assert {d: r["text"] for d, r in found.items()} == want
    for d, text in rows:
        count = lambda t: sum(bool(GAP.sub("", x)) for x in (t or "").split("\n"))
        assert (found[d]["n_lines"], found[d]["n_deleted"]) == (count(text), count(text) - count(want[d]))
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_passage_of_fifty_words_goes_from_later_documents(spark):
    passage = "\n".join(" ".join(f"p{k}" for k in range(i, i + 13)) for i in range(0, 52, 13))
    rows = [(1, f"first\n{passage}\nend"), (2, f"other text\n{passage}\nlast"), (3, "clean words\nof its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "other text\nlast", 3: rows[2][1]}


def whole_runs(rows, min_words=line_dedup.MIN_WORDS, max_lines=line_dedup.MAX_LINES):
    """By pairs of places: what is left, but for blank lines, without the maximal runs that are equal to earlier ones and long enough."""
    places, gone = [], set()
    for d, text in sorted(rows):
        lines = [(no, GAP.sub(" ", x).strip(" ")) for no, x in enumerate((text or "").split("\n"))]
        places.append([(d, no, x) for no, x in lines if x])
    for b, later in enumerate(places):
        for a, early in enumerate(places[: b + 1]):
            for shift in range(1 - len(early), len(later)):
                if a == b and shift <= 0:
                    continue
                run = []
                for i in range(max(0, shift), len(later) + 1):
                    if i < len(later) and i - shift < len(early) and later[i][2] == early[i - shift][2]:
                        run.append(later[i])
                        continue
                    if len(run) >= max_lines or sum(len(x.split(" ")) for *_, x in run) >= min_words:
                        gone |= {(d, no) for d, no, _ in run}
                    run = []
    left = {d: [] for d, _ in rows}
    for lines in places:
        for d, no, x in lines:
            left[d] += [x] if (d, no) not in gone else []
    return left


def test_whole_repeated_runs_go(spark):
    rng = random.Random(12)
    lines = [" ".join(rng.choices(["a", "b", "cc", "é"], k=rng.choice((1, 2, 9, 20, 35)))) for _ in range(9)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for i in range(50)] + [(90, None), (91, ""), (92, "x y\n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    full = lambda t: [x for x in (GAP.sub(" ", x).strip(" ") for x in (t or "").split("\n")) if x]
    want = whole_runs(rows)
    assert {r["doc_id"]: full(r["text"]) for r in line_dedup.dedup_lines(docs, whole_runs=True).collect()} == want
    assert want != {d: full(t) for d, t in dedup(rows).items()}


def test_line_dedup_query_takes_whole_runs(spark, tmp_path, monkeypatch):
    """The query and its SQL against pairs of places: a two-line run, one common window, ties, repeated and null rows."""
    import duckdb
    from graphloom.llm import common, queries

    monkeypatch.setattr(common, "HEAVY", 4)
    rng = random.Random(21)
    tail = " ".join(f"l{i}" for i in range(30)) + "\nthe tail of the run"
    lines = [" ".join(rng.choices(["a", "b", "cc", "é"], k=rng.choice((1, 2, 9, 20, 35)))) for _ in range(9)] + ["", "  "]
    rows = [(1, f"one\n{tail}\nx y"), (2, f"two\n{tail}\nz w"), (3, None), (4, ""), (5, "x y\n" * 40), (6, "x y\n" * 40)]
    rows += [(10 + i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for i in range(40)]
    two = " ".join(f"m{i}" for i in range(31)) + "\n\n  \n" + " ".join(f"n{i}" for i in range(31))
    rows += [(60, f"{two}\n\nv"), (61, f"a\n\n{two}\n\nb"), (62, "\n" + "\n\n".join(reversed(two.split("\n\n  \n"))) + "\n")]
    rows += [(100 + i, f"own {i}\n" + " ".join(f"w{k}" for k in range(32)) + f"\nend {i}") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_deleted int, key string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    full = lambda t: [x for x in (GAP.sub(" ", x).strip(" ") for x in (t or "").split("\n")) if x]
    assert {d: full(r["text"]) for d, r in found.items()} == whole_runs(rows)
    assert found[2]["text"] == "two\nz w" and found[2]["n_deleted"] == 2 and found[3]["text"] is None
    assert found[61]["text"] == "a\n\n\nb" and found[62]["text"] == "\n"
    sql = queries.oracle_sql()["op3_line_dedup"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")
    for d, text, n, gone in duckdb.sql(sql).fetchall():
        assert (found[d]["text"] or "", found[d]["n_lines"], found[d]["n_deleted"]) == (text, n, gone)
    twice = line_dedup.dedup_lines(docs.union(docs), whole_runs=True).collect()
    assert len(twice) == 2 * len(rows) and all(r["text"] == found[r["doc_id"]]["text"] for r in twice)


def test_pipeline_drops_the_end_of_a_repeated_run_and_exact_copies(spark):
    def line(k, n):
        return " ".join(f"{k}{i}" for i in range(n))

    passage = line("p", 40) + "\n" + line("q", 20)
    rows = [(0, line("p", 40) + "\nother end"), (1, f"first\n{passage}\nend"), (2, f"own line\n{passage}\nlast"), (3, passage), (4, "clean words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = {0: rows[0][1], 1: f"first\n{line('q', 20)}\nend", 2: "own line\nlast", 4: "clean words"}
    assert left == {d: (t, len(t)) for d, t in want.items()}


def test_long_documents_take_time_in_proportion(spark):
    """Documents of 60,000 lines, one a copy, through the pipeline's stage with its filter: quadratic work would take minutes."""
    import time

    text = "\n\n".join(f"a{i} b{i % 7}" for i in range(60_000))
    rows = [(1, text), (2, "own\n" + text), (3, text[: len(text) // 2] + " end\nlast"), (4, "\n" * 60_000)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    began = time.monotonic()
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert time.monotonic() - began < 60
    assert left[1] == text and left[2].strip() == "own" and left[3].split("\n")[-1] == "last" and len(left[3]) < 50 and left[4] == "\n" * 60_000


def spans(text):
    text, out = text or "", []
    for kind, pattern in enumerate((secret_scan.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+", secret_scan.CANDIDATE)):
        for m in re.finditer(pattern, text):
            v = m[0]
            if kind == 3:
                best = min(
                    sum(secret_scan.term(c) for c in Counter(v[j : j + secret_scan.WINDOW]).values()) for j in range(len(v) - secret_scan.WINDOW + 1)
                )
                bits = next(b for _, p, b in secret_scan.CLASSES if re.search(p, v))
                keep = not any(re.search(p, v) for p in secret_scan.ALLOWED) and best <= secret_scan.ceiling(bits)
            else:
                keep = (kind == 0 and len(m[2]) >= 6, kind == 1 and len(v) >= 20, kind == 2 and len(v) >= 24)[kind]
            if keep:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(3)
    pieces = ["password = hunter22", "Api_Key: 'short'", "token=\"abcDEF123456\"", "AKIA" + "Z9" * 9, "AKIAAKIASHORT", "deadbeef" * 4, "0123456789abcdef0123456", "ünïcode 😀",
              "3fA9kQz81LmXcV02bNtR7yUw", "01234567-89ab-cdef-0123-456789abcdef", "an-ordinary-slug-of-words-2024", "EXAMPLE9kQz81LmXcV02bNt", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    rows = [(i, rng.choice(("\n", " ", "")).join(rng.choices(pieces, k=rng.randint(0, 7)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "x" * 50_000 + " token=" + "Q1w2" * 40)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, secrets string")
    found = secret_scan.find_secrets(docs)
    for r, digest in zip(found.orderBy("doc_id").collect(), secret_scan.scan_digest(found).orderBy("doc_id").collect(), strict=True):
        want = spans(r["text"])
        assert [tuple(s) for s in r["secrets"]] == want, r["text"]
        base = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want if k < 3)
        assert digest["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and digest["n_hex"] == sum(k == 2 for _, k, _ in want)
    for r in secret_scan.redact(found).collect():
        assert r["text"] is None or not any(k < 3 and k != 0 for _, k, _ in spans(r["text"])), r["text"]
    assert any(k == 3 for _, t in rows for _, k, _ in spans(t))
    assert math.isclose(secret_scan.term(4) / 1e6, 8)


def test_long_candidates_overflow_no_stack(spark):
    """Texts of 100,000 characters on which a recursive pattern would end the executor."""
    n = 100_000
    texts = ["a-" * (n // 2) + "12345", "a-" * (n // 2) + "a1234", "a" * n + "7", "abc/" * (n // 4) + "9", "x_1" * (n // 3), "0123456789abcdef" * (n // 16),
             "01234567-89ab-cdef-0123-456789abcdef" * (n // 36), "secret=" + "k9" * n, "token: " + "-" * n, "AKIA" + "Z" * n, "password" * (n // 8), "api_key" + " " * n + "=abcdef1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.find_secrets(docs).collect():
        assert [tuple(s) for s in r["secrets"]] == spans(texts[r["doc_id"]]), r["doc_id"]


def stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_text_stats(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice((" ", "\n", "\t ")).join(rng.choices(["a", "b#", "ü😀", "c|d", "\n", "e"], k=rng.choice((0, 3, 12, 60))))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "For " * 5000), (93, "a b c d e x a b c d e y a b c d e")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    found = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in text_stats.text_stats(docs).collect()}
    assert found == {d: stats(t) for d, t in rows}


def test_decision_list_learns_and_keeps_clean_documents(spark):
    rng = random.Random(7)

    def words(k):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(k))

    rows = [(i, words(40) if i % 3 else " ".join(w + rng.choice("%*#") for w in words(40).split())) for i in range(300)] + [(900, None), (901, words(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(299, None), (None, 1)], "doc_id long, quality int")
    judged, rules = decision_list.apply_rules(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert rules and all(kept[i] == (i % 3 > 0) for i in range(300)) and not kept[900] and not kept[901]
    assert decision_list.apply_rules(docs, labels.limit(0))[1] == []
    assert decision_list.apply_rules(docs.limit(0), labels)[0].count() == 0

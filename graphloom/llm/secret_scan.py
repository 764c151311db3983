r"""Secret scans: base patterns, and sliding-window Shannon entropy by character class over candidate strings.

The base patterns find assignments to secret names, access keys and long hexadecimal strings. The method
adds candidates: runs of token characters in which some window of WINDOW characters has at least the
entropy that its character class asks for. The entropy follows from counts that are kept while the window
slides: each step adds the character that enters, takes out the one that leaves and corrects the sum of
c * log2(c) by those two counts alone, in whole millionths, so that it is exact in every engine. Candidates
that an allow-list pattern matches are passed over.

All of it is column expressions over one scan; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short has no long enough match inside it either, so the least lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: In this order spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: (class, pattern of a whole candidate, least entropy of its best window in bits); the first that fits counts.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
)
#: Candidates that aren't secrets: no digit or no letter, UUIDs, dates and other digit groups, placeholders, lower-case slugs.
#: The slug's repeats are possessive, so the JVM loops over them: a plain repeated group recurses once for each of a slug's
#: words, and a long slug overflows the stack. As words and separators share no character, both match the same strings.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i:example|sample|dummy|placeholder|changeme|notasecret)",
    r"^[a-z]++(?:[_/-][a-z]++)*+[_/-]?[0-9]{1,4}$",
)
MILLION = 1_000_000


def term(count: int) -> int:
    """count * log2(count) in whole millionths."""
    return round(count * math.log2(count) * MILLION) if count else 0


def ceiling(bits: float, window: int = WINDOW) -> int:
    """A window's entropy is at least ``bits`` if its sum of terms is at most this."""
    return math.floor(window * (math.log2(window) - bits) * MILLION)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int, test: str = "true") -> Column:
    """Of each match m of pattern that passes test: start, kind, end in code points."""
    p = _sql(pattern)
    return F.expr(
        f"""if(not {text} rlike {p}, cast(array() as array<struct<start:int,kind:int,end:int>>),
          filter(aggregate(
            zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0),
                     (gap, m) -> named_struct('gap', length(gap), 'm', m)),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int>>)),
            (a, x) -> if(x.m is null, a, named_struct(
              'at', a.at + x.gap + length(x.m),
              'out', if({test.replace("m.", "x.m")}, concat(a.out, array(named_struct(
                'start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + length(x.m)))), a.out))),
            a -> a.out), s -> true))"""
    )


def _terms() -> str:
    return "array(" + ",".join(str(term(c)) for c in range(WINDOW + 2)) + ")"


def _best_window(candidate: str) -> str:
    """The least sum of terms of a window of the candidate, by sliding counts.

    The codes stay outside the fold's state, which has a fixed size, so the work grows with the length alone.
    """
    last = f"t >= {WINDOW}"
    codes = f"transform(split({candidate}, ''), c -> instr({_sql(ALPHABET)}, c))"
    step = f"""(a, t) -> named_struct(
        'counts', transform(a.counts, (n, k) -> n + if(k + 1 = cs[t], 1, 0) - if({last} and k + 1 = cs[t - {WINDOW}], 1, 0)),
        'total', a.total + if({last} and cs[t] = cs[t - {WINDOW}], 0,
            __terms[a.counts[cs[t] - 1] + 1] - __terms[a.counts[cs[t] - 1]]
            + if({last}, __terms[a.counts[cs[t - {WINDOW}] - 1] - 1] - __terms[a.counts[cs[t - {WINDOW}] - 1]], 0)),
        'best', if({last}, least(a.best, a.total), a.best))"""
    start = f"named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'total', 0, 'best', 2147483647)"
    return f"transform(array({codes}), cs -> aggregate(sequence(0, size(cs) - 1), {start}, {step}, z -> least(z.best, z.total)))[0]"


def _entropy_test() -> str:
    """Whether a candidate m. is no allowed string and has a window of enough entropy."""
    allowed = " or ".join(f"m. rlike {_sql(p)}" for p in ALLOWED)
    limit = "case " + " ".join(f"when m. rlike {_sql(p)} then {ceiling(bits)}" for _, p, bits in CLASSES) + " end"
    return f"(not ({allowed}) and {_best_window('m.')} <= {limit})"


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secrets``: an array of (start, kind, end) sorted by start, then by the order of KINDS.

    Positions count code points, end exclusive. A null or empty text has none; an empty table gives an
    empty result; repeated rows get equal arrays; a column of docs that is named secrets is replaced.
    Candidates may have any length: no pattern here recurses.
    """
    value = f"length(regexp_extract(m., {_sql(ASSIGN)}, 2)) >= {MIN_VALUE}"
    own = docs.drop("secrets")
    found = own.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__terms", F.expr(_terms()))
    parts = [
        _spans("__t", ASSIGN, 0, value),
        _spans("__t", ACCESS, 1),
        _spans("__t", HEX, 2),
        _spans("__t", CANDIDATE, 3, _entropy_test()),
    ]
    return found.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("__t", "__terms")


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def scan_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that find_secrets() found, a row for each row.

    A null id stays null, a row without secrets has zeros and the digest of an empty string, repeated rows stay
    repeated, and an empty table gives an empty result. Other columns are passed over.
    """

    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        doc_id,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """found with each span of ``secrets`` in its text replaced by mark; overlapping spans are replaced as one.

    A null text stays null, a text without spans stays as it is; repeated rows are treated alike, an empty table
    stays empty, and all other columns are kept.
    """
    merged = """aggregate(secrets, cast(array() as array<struct<start:int,end:int>>),
      (a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))),
        concat(a, array(named_struct('start', s.start, 'end', s.end)))))"""
    pieces = f"""concat(
      array_join(transform(__m, (s, i) -> concat(substring({text}, if(i = 0, 0, __m[i - 1].end) + 1, s.start - if(i = 0, 0, __m[i - 1].end)), {_sql(mark)})), ''),
      substring({text}, element_at(__m, -1).end + 1))"""
    return (
        found.withColumn("__m", F.expr(merged))
        .withColumn(text, F.expr(f"if(size(__m) = 0 or {text} is null, {text}, {pieces})"))
        .drop("__m")
    )


def secrets_sql(relation: str, id_column: str = "doc_id", text: str = "text") -> str:
    """DuckDB SQL for scan_digest(): windows are counted one by one, without sliding."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds: Sequence[tuple[int, str, str]] = (
        (0, ASSIGN, f"length(regexp_extract(m, {q(ASSIGN)}, 2)) >= {MIN_VALUE}"),
        (1, ACCESS, "true"),
        (2, HEX, "true"),
        (3, CANDIDATE, _entropy_sql(q)),
    )
    parts = " UNION ALL ".join(
        f"""SELECT id, row_no, {k} AS kind, start_at AS s, start_at + length(m) AS e FROM (
          SELECT id, row_no, m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start_at
          FROM (SELECT id, row_no, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
            SELECT id, row_no, regexp_extract_all(t, {q(p)}) AS ms, string_split_regex(t, {q(p)}) AS gaps FROM base))) WHERE {test}"""
        for k, p, test in kinds
    )
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    joined = f"coalesce(string_agg({name} || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind)"
    return f"""
WITH base AS (SELECT {id_column} AS id, row_number() OVER () AS row_no, coalesce({text}, '') AS t FROM {relation}),
found AS ({parts})
SELECT base.id AS {id_column}, CAST(count(*) FILTER (kind = 0) AS BIGINT) AS n_assign,
  CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS n_hex,
  sha256({joined} FILTER (kind < 3), '')) AS base_sha256, {joined}, '') AS spans
FROM base LEFT JOIN found USING (row_no) GROUP BY base.id, row_no"""


def _entropy_sql(q) -> str:
    terms = "[" + ",".join(str(term(c)) for c in range(WINDOW + 1)) + "]"
    # The patterns as they are, but for possessive repeats, which DuckDB's automaton neither knows nor needs.
    allowed = " OR ".join(f"regexp_matches(m, {q(p.replace('++', '+').replace('*+', '*'))})" for p in ALLOWED)
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, {q(p)}) THEN {ceiling(b)}" for _, p, b in CLASSES) + " END"
    window = f"string_split(substr(m, j, {WINDOW}), '')"
    total = f"list_sum(list_transform(list_distinct({window}), lambda c: {terms}[1 + len(list_filter({window}, lambda d: d = c))]))"
    best = f"list_min(list_transform(range(1, length(m) - {WINDOW - 2}), lambda j: {total}))"
    return f"NOT ({allowed}) AND {best} <= {limit}"

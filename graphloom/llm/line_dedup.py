r"""Line dedup by winnowing over line hashes.

A line is a piece of a text between line feeds; its white space is normalised and blank lines are passed
over. A *window* begins at a line and takes lines until it has ``min_words`` words or ``max_lines`` lines, or
ends at a line and takes lines backwards; windows that reach neither don't count. Of each window the line with
the least hash is its fingerprint, so every repeated run that is as long as a window is guaranteed to share a
fingerprint with its earlier occurrence. Only the minima that windows select are kept, each with the windows
that selected it; minima whose hash has one place in the corpus are dropped.

At the others the match is extended both ways. The windows around a fingerprint say by their hashes how far
it reaches: one is equal to an earlier one if all its lines are. The windows that begin at a run's lines
carry a match from its first line on, those that end at them carry it to its last line. So the lines that go are
exactly the union of all maximal runs of ``min_words`` words or ``max_lines`` lines that occur earlier in the
order (doc_id, line). Comparing with one earlier occurrence alone would miss runs: the first place of a
fingerprint needn't be where the longest match is.

Positions are joined by hash and never in pairs: a line that a third of all documents have costs as many rows
as it has occurrences, and those are dealt to many tasks. Only hashes, counts and line numbers are shuffled;
texts are once, to be rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, spread_join

#: A run of this many words is found wherever it repeats...
MIN_WORDS = 30
#: ... and so is one of this many lines, however short they are.
MAX_LINES = 8

_LINES = r"filter(transform(split(__text, '\n', -1), l -> trim(regexp_replace(l, '[ \\t-\\r]+', ' '))), t -> t <> '')"
_HASHED = """transform(__lines, (t, no) -> named_struct(
  'no', no, 'h', xxhash64(t), 'g', xxhash64('second', t), 'w', length(t) - length(replace(t, ' ', '')) + 1))"""
_AHEAD = "slice(__h, i + 1, {max_lines})"
_BACK = "reverse(slice(__h, greatest(i + 2 - {max_lines}, 1), least(i + 1, {max_lines})))"
_LENGTH = """aggregate({lines}, named_struct('n', 0, 'w', 0),
  (a, x) -> if(a.w >= {min_words}, a, named_struct('n', a.n + 1, 'w', a.w + x.w)))"""


def fingerprints(docs: DataFrame, text: str, doc_id: str, min_words: int, max_lines: int, whole_runs: bool = True) -> DataFrame:
    """A row for each minimum that windows select: document, hash ``print``, line, and ``spans``, the windows that selected it.

    Lines are numbered without blank ones, from 0. A span has its first and last line and two hashes of its content. Windows that follow each other and have
    one minimum are one row; those that begin at lines and those that end at them have rows of their own.
    """

    def sizes(lines: str) -> str:
        return f"transform(__h, (x, i) -> {_LENGTH.format(lines=lines.format(max_lines=max_lines), min_words=min_words)})"

    fits = f"(s.w >= {min_words} or s.n >= {max_lines})"
    forward = f"filter(transform(__n, (s, i) -> if({fits}, slice(__h, i + 1, s.n), null)), win -> win is not null)"
    # A window back from a line that is also one ahead from its first line counts once.
    new = "__n[i + 1 - s.n].n <> s.n"
    back = f"filter(transform(__b, (s, i) -> if({fits} and {new}, slice(__h, i + 2 - s.n, s.n), null)), win -> win is not null)"
    chosen = """transform({windows}, win -> named_struct(
      'least', array_min(transform(win, x -> named_struct('h', x.h, 'no', x.no))),
      'span', named_struct('first_no', win[0].no, 'last_no', element_at(win, -1).no,
        'c1', xxhash64(transform(win, x -> x.h)), 'c2', xxhash64(transform(win, x -> x.g)))))"""
    starts = "filter(sequence(0, size({c}) - 1), i -> size({c}) > 0 and (i = 0 or {c}[i].least.no <> {c}[i - 1].least.no))"
    rows = """transform({c}_at, (at, j) -> named_struct('print', {c}[at].least.h, 'print_no', {c}[at].least.no,
      'spans', transform(slice({c}, at + 1, coalesce(get({c}_at, j + 1), size({c})) - at), x -> x.span)))"""
    sides = {"__f": forward} | ({"__r": back} if whole_runs else {})
    found = (
        docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        .withColumn("key", F.xxhash64("__text"))
        .withColumn("__lines", F.expr(_LINES))
        .withColumn("__h", F.expr(_HASHED))
        .select("id", "key", "__h", F.expr(sizes(_AHEAD)).alias("__n"), *([F.expr(sizes(_BACK)).alias("__b")] if whole_runs else []))
        .select("id", "key", *[F.expr(chosen.format(windows=w)).alias(c) for c, w in sides.items()])
        .select("id", "key", *sides, *[F.expr(starts.format(c=c)).alias(f"{c}_at") for c in sides])
    )
    return found.select("id", "key", F.expr("inline(concat(" + ", ".join(rows.format(c=c) for c in sides) + "))"))


def repeated_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_words: int = MIN_WORDS,
    max_lines: int = MAX_LINES,
    whole_runs: bool = True,
) -> DataFrame:
    """Documents that have later repeated runs: id, key (hash of the text), ``go``, the numbers of their lines without
    blank ones, and ``bound``, those of them that go together with the next one."""
    prints = cut(fingerprints(docs, text, doc_id, min_words, max_lines, whole_runs))
    place = F.struct("id", "key", "print_no")
    recurring = cut(
        prints.groupBy("print")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("many"))
        .filter(F.col("a") != F.col("b"))
        .select("print", "many")
    )
    near = cut(spread_join(prints, recurring, ["print"], ["id", "print_no"], "inner").select("id", "key", F.expr("inline(spans)")))
    here = F.struct("id", "key", "first_no")
    firsts = cut(
        near.groupBy("c1", "c2")
        .agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("many"))
        .filter(F.col("first") != F.col("last"))
        .select("c1", "c2", "first", "many")
    )
    later = spread_join(near, firsts, ["c1", "c2"], ["id", "first_no"], "inner").filter(here > F.col("first"))
    # Numbers of the lines that go together with the next one: then so do the blank lines between the two.
    if whole_runs:
        bound = "filter(go, (k, j) -> get(go, j + 1) = k + 1)"
    else:
        bound = "array_distinct(flatten(transform(filter(spans, s -> s.last_no > s.first_no), s -> sequence(s.first_no, s.last_no - 1))))"
    return (
        later.groupBy("id", "key")
        .agg(F.collect_set(F.struct("first_no", "last_no")).alias("spans"))
        .select("id", "key", "spans", F.expr("array_sort(array_distinct(flatten(transform(spans, s -> sequence(s.first_no, s.last_no)))))").alias("go"))
        .select("id", "key", "go", F.expr(bound).alias("bound"))
    )


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_words: int = MIN_WORDS,
    max_lines: int = MAX_LINES,
    whole_runs: bool = False,
) -> DataFrame:
    """docs with later repeated runs of lines taken out of ``text``, and the columns ``n_lines`` and ``n_deleted`` (long).

    With whole_runs repeated runs go to their last line, else up to the last window that begins in them and fits.
    Both count lines that aren't blank. A blank line goes if the lines before and after it go (without whole_runs:
    by one window). A null text stays null and has no lines. Rows that repeat a doc_id and a text are one document: they are treated alike. A null
    doc_id sorts last. An empty table gives an empty result. Other columns are kept; columns of docs that
    are named n_lines or n_deleted are replaced.
    """
    gone = repeated_lines(docs, text, doc_id, min_words, max_lines, whole_runs).select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("go").alias("__go"), F.col("bound").alias("__bound")
    )
    own = docs.drop("n_lines", "n_deleted")
    columns = [c for c in own.columns]
    keyed = own.withColumn("__i", F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))).withColumn(
        "__k", F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    )
    joined = keyed.join(
        gone.hint("shuffle_hash"), (keyed["__i"] == gone["__id"]) & (keyed["__k"] == gone["__key"]), "left"
    )
    # Lines and the places of full ones are bound by lambdas: a filter over the result must not work them out for each line.
    at = r"filter(sequence(0, size(l) - 1), i -> l[i] rlike '[^ \\t-\\r]')"
    between = "flatten(transform(__bound, k -> if(at[k + 1] > at[k] + 1, sequence(at[k] + 1, at[k + 1] - 1), array())))"
    gone = f"concat(transform(__go, k -> at[k]), {between})"
    kept = f"transform(array_except(sequence(0, size(l) - 1), {gone}), k -> l[k])"

    def of_lines(body: str) -> str:
        return f"transform(array(split(coalesce(`{text}`, ''), '\\n', -1)), l -> transform(array({at}), at -> {body})[0])[0]"

    left = F.expr(f"if(__go is null or `{text}` is null, `{text}`, {of_lines(f"array_join({kept}, '\\n')")})")
    return joined.select(
        *[left.alias(c) if c == text else F.col(c) for c in columns],
        F.expr(f"cast({of_lines('size(at)')} as bigint)").alias("n_lines"),
        F.expr("cast(if(__go is null, 0, size(__go)) as bigint)").alias("n_deleted"),
    )


def line_dedup_sql(relation: str, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> str:
    """The same with whole_runs for DuckDB, without windows: doc_id, text, n_lines, n_deleted.

    Pairs of equal lines, the later with each earlier one, that follow each other in both documents are a run; the
    later lines of runs that are long enough go.
    """
    gap = r"[ \t\n\x0B\f\r]"
    return rf"""
WITH pieces AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM {relation}),
lines AS (
  SELECT doc_id, no, t, length(t) - length(replace(t, ' ', '')) + 1 AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i
  FROM (SELECT doc_id, no, trim(regexp_replace(raw, '{gap}+', ' ', 'g')) AS t FROM pieces) WHERE t <> ''),
pairs AS (
  SELECT b.doc_id, b.no, b.i, b.w, a.doc_id AS early, b.i - a.i AS shift,
         b.i - row_number() OVER (PARTITION BY b.doc_id, a.doc_id, b.i - a.i ORDER BY b.i) AS run
  FROM lines a JOIN lines b ON a.t = b.t AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
runs AS (
  SELECT doc_id, min(no) AS first_no, max(no) AS last_no FROM pairs
  GROUP BY doc_id, early, shift, run HAVING sum(w) >= {min_words} OR count(*) >= {max_lines}),
gone AS (SELECT DISTINCT l.doc_id, l.no FROM lines l JOIN runs r ON l.doc_id = r.doc_id AND l.no BETWEEN r.first_no AND r.last_no),
told AS (SELECT p.doc_id, p.no, p.raw, l.no IS NOT NULL AS full_line, CASE WHEN l.no IS NOT NULL THEN g.no IS NOT NULL END AS goes
         FROM pieces p LEFT JOIN lines l ON p.doc_id = l.doc_id AND p.no = l.no LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.no = g.no),
marked AS (SELECT *, coalesce(goes, coalesce(last_value(goes IGNORE NULLS) OVER before, false) AND coalesce(first_value(goes IGNORE NULLS) OVER after, false)) AS del
           FROM told WINDOW before AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            after AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT del), '') AS text,
       CAST(count(*) FILTER (full_line) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (full_line AND del) AS BIGINT) AS n_deleted
FROM marked GROUP BY doc_id"""

"""Counts over whole texts as column expressions; one scan, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, words

SYMBOLS = r"[#*$%&|<>]"
#: Words of a window, for repeats inside a text.
REPEAT_WINDOW = 5

_WINDOWS = f"""if(size(__w) < {REPEAT_WINDOW}, cast(array() as array<bigint>),
  transform(sequence(0, size(__w) - {REPEAT_WINDOW}), i -> xxhash64({", ".join(f"__w[i + {k}]" for k in range(REPEAT_WINDOW))})))"""
_SORTED = """if(size(array_distinct(__g)) = size(__g), cast(array() as array<struct<h:bigint,i:int>>),
  array_sort(transform(__g, (h, i) -> named_struct('h', h, 'i', i))))"""
_REPEATED = """array_sort(transform(filter(
  transform(__s, (x, k) -> named_struct('i', x.i, 'again', (k > 0 and __s[k - 1].h = x.h) or (k + 1 < size(__s) and __s[k + 1].h = x.h))),
  x -> x.again), x -> x.i))"""
_COVERED = f"""cast(aggregate(transform(__r, (p, k) -> if(k + 1 < size(__r), least({REPEAT_WINDOW}, __r[k + 1] - p), {REPEAT_WINDOW})), 0, (a, x) -> a + x) as bigint)"""


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without ``text``, and counts (long) over it; a null text counts as empty, and all its counts are 0.

    n_words; word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in 5-word windows that the text has twice or more, all
    occurrences included; n_lines: lines with a word; n_upper, n_digits, n_marks: capitals, digits, and marks
    of exclamation or question; n_distinct: different words.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
    rest = [c for c in docs.columns if c != text and c not in names]

    def chars(pattern: str) -> str:
        return f"cast(length(__t) - length(regexp_replace(__t, '{pattern}', '')) as bigint)"

    return (
        docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__t"))
        .withColumn("__w", words("__t"))
        .withColumn("__g", F.expr(_WINDOWS))
        .withColumn("__s", F.expr(_SORTED))
        .withColumn("__r", F.expr(_REPEATED))
        .withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]")))
        .select(
            *rest,
            F.size("__w").cast("long").alias("n_words"),
            F.expr(r"cast(length(regexp_replace(__t, '[\\x20\\x09-\\x0D]+', '')) as bigint)").alias("word_chars"),
            F.expr(chars(SYMBOLS)).alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.expr(_COVERED).alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
            F.expr(chars(r"\\p{Lu}+")).alias("n_upper"),
            F.expr(chars("[0-9]+")).alias("n_digits"),
            F.expr(chars("[!?]+")).alias("n_marks"),
            F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        )
    )


#: Shares and means that rules and classifiers use, as SQL over the counts; whole numbers, so that thresholds are exact.
RATIOS = {
    "symbols_per_1000_words": "n_symbols * 1000 div greatest(n_words, 1)",
    "chars_per_100_words": "word_chars * 100 div greatest(n_words, 1)",
    "dup_lines_per_1000": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats_per_1000_words": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "upper_per_1000_chars": "n_upper * 1000 div greatest(word_chars, 1)",
    "digits_per_1000_chars": "n_digits * 1000 div greatest(word_chars, 1)",
    "marks_per_1000_words": "n_marks * 1000 div greatest(n_words, 1)",
    "distinct_per_1000_words": "n_distinct * 1000 div greatest(n_words, 1)",
    "words_per_line": "n_words div greatest(n_lines, 1)",
    "n_words": "n_words",
}


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, columns: list[str], limit: int, key: str = "doc_id") -> list[tuple]:
    """(hash, label, columns...) of labelled rows; over limit of them, about limit with the least hashes.

    Labels of one key are averaged and rounded; null labels and keys are passed over. Rows that agree in key and
    columns are one, so a key that many rows have can't pass the limit with all of them.
    """
    clean = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.round(F.avg(label)).cast("int").alias("__label"))
    joined = stats.join(clean, F.col(key) == F.col("__key")).select(F.xxhash64(key, *columns).alias("__hash"), "__label", *columns).distinct()
    return sorted(tuple(r) for r in bounded_sample(joined, "__hash", limit))

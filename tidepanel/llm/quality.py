"""Operator 9: quality rules as a threshold table, compiled into one projection of Spark expressions.

Every number is an integer count and every threshold is in thousandths, so a rule compares integers
and no rounding is involved. No user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD_SPACE


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * top / bottom <= most``; None: no bound. Texts with ``bottom`` 0 pass."""

    name: str
    top: str
    bottom: str
    least: int | None = None
    most: int | None = None


#: Length, symbol, stop-word and line ratios, in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2_000, most=12_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
    Rule("words_per_line", "n_words", "n_lines", least=2_000),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to a in is that it for was on are with as be at by this from or an have not but "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une est que dans pour qui sur par au ne se pas plus du "
    "el los las y del por con para su al lo como más".split()
)
#: Signs that may follow a stop word.
TAIL = ".,;:!?"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first included.

    Texts whose windows all differ are told by a set. In the others the windows are sorted with their
    places; equal neighbours give the places of repeated windows, and the words they cover are counted
    from the gaps between places.
    """
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    n = F.size(windows)

    def places(all_rows: Column) -> Column:
        same = lambda a, b: F.get(all_rows, a)["w"] == F.get(all_rows, b)["w"]
        hit = F.filter(all_rows, lambda x, k: F.coalesce((k > 0) & same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["last"]).cast("long")).alias("sum"), p.alias("last"))
        # each place adds three words less those that the place before has covered
        return F.aggregate(at, start, step, lambda acc: acc["sum"])

    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(_once(placed, lambda rows: _once(places(rows), covered)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for the row."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def with_counts(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` added, under ``prefix``."""
    t, w, v, li = (f"_q_{x}" for x in ("text", "words", "windows", "lines"))
    text, words = F.col(t), F.col(w)
    step = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    step = step.withColumn(w, F.array_remove(F.split(text, WORD_SPACE), ""))
    line = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    step = step.withColumns({v: F.when(F.size(words) >= 3, grams).otherwise(F.array().cast("array<string>")), li: line})
    bare = lambda x: F.lower(F.rtrim(x, F.lit(TAIL)))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(li) - F.size(F.array_distinct(li))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, F.col(v)).alias("n_repeat_words"),
        F.size(F.filter(words, lambda x: bare(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(li).cast("long").alias("n_lines"),
    )
    # a filter on the counts must not be pushed below them: it would compute each as often as it names it
    step = step.withColumn("_q_counts", F.explode(F.array(counts)))
    step = step.withColumns({f"{prefix}{c}": F.col("_q_counts")[c] for c in COUNTS}).drop("_q_counts")
    return step.drop(t, w, v, li)


def compile_rules(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """The threshold table as one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        top, bottom = F.col(f"{prefix}{r.top}") * 1000, F.col(f"{prefix}{r.bottom}")
        held = F.lit(True)
        if r.least is not None:
            held = held & (top >= bottom * r.least)
        if r.most is not None:
            held = held & (top <= bottom * r.most)
        passed = passed & ((bottom == 0) | held)
    return passed


def base_failed(prefix: str = "", *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < min_words) | (100 * repeated > max_repeat_percent * n)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every whole text.

    Null and empty texts have no words: all counts 0, base failed, not kept. Repeated rows and null ids
    are judged row by row; an empty table gives an empty result; only the two columns are read, so
    other columns cannot clash. Very long texts are judged whole: windows are compared by a sort, in
    n log n steps.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_q_source"))
    out = with_counts(rows, "_q_source").withColumn("base_failed", base_failed())
    kept = (~F.col("base_failed") & compile_rules(rules)).alias("kept")
    return out.select(id_col, *COUNTS[:5], "base_failed", kept, *COUNTS[5:])


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Null and empty texts go. Repeated rows and null ids are judged row by row; an empty table gives an empty result. The
    other columns travel as one, so no name of theirs can clash with a count. Very long texts are judged whole.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("source"))
    counted = with_counts(packed, "source", prefix="_q_")
    return counted.where(~base_failed("_q_") & compile_rules(rules, "_q_")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

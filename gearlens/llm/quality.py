"""Quality rules with adaptive thresholds from mergeable quantile sketches.

One pass measures every document.  The sketch of a measure in a language and source
counts its values in bins of equal ratio: sketches merge by adding, in any order, to
the same counts, and a quantile is off by at most half a bin.  A small source leans
on its language: to every sketch the language's own is added with the weight of
``PRIOR`` documents.  The thresholds read from them are joined back to filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship_by_value, stage, table

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT, WINDOW, SYMBOLS = 10, 20, 5, "#*$%&|<>"
#: Bins of the sketches for a factor of e (a bin is 0.5 % wide); documents that the
#: language weighs in each of its sources, and the points of equal rank that stand for it.
GRAIN, PRIOR, POINTS = 200, 200, 64
#: A measure is out of line above median + FENCE * (upper quartile - median, but
#: at least FLOOR), i.e. relative to its own group.
FENCE = 12.0
#: The floors keep the least fence inside a measure's range: 0.6 of the lines with
#: words, and a share of repeated words of 0.15 (above 0.2 the base rules reject).
FLOORS = {"symbol_share": 0.005, "dup_line_share": 0.05, "repeat_share": 0.0125}
#: The mean word length (code points) is fenced both ways by a ratio: median times
#: or over (quartile to median, but at least this) ** FENCE, 2.1 at least.
WORD_LENGTH_FLOOR = 1.065
#: Thresholds are broadcast up to this many groups.
BROADCAST_GROUPS = 100_000


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    t = text or ""
    words = t.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(t.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeat = 0
    if len(words) > WINDOW:
        number: dict = {}
        x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        n = len(x) - WINDOW + 1
        # number the windows exactly: pairs, then pairs of pairs, then the last word
        two = x[:-1] * len(number) + x[1:]
        two = np.unique(two, return_inverse=True)[1]
        k = int(two.max()) + 1
        four = np.unique(two[:n] * k + two[2:n + 2], return_inverse=True)[1]
        five, inverse, count = np.unique(four[:n] * len(number) + x[WINDOW - 1:], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse] > 1)
        edge = np.zeros(len(x) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        repeat = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), len(t) - spaces, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def text_lines(text: str | None) -> int:
    """Lines that hold a word."""
    return sum(1 for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(*measure(t.as_py()), text_lines(t.as_py())) for t in b.column(3)]
        cols = np.array(rows, np.int64).reshape(-1, 6).T
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(c) for c in cols]],
                                         ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def measures(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    schema = d.drop("text").withColumns({c: F.lit(0).cast("bigint") for c in
                                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}).schema
    m = d.mapInArrow(_measure, schema)
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    words = F.greatest("n_words", F.lit(1))
    return m.withColumns({
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words})


def bin_of(value):
    """Bin of a value >= 0; 0 has one of its own."""
    return F.when(value > 0, F.floor(F.log(value) * GRAIN))


def value_of(b):
    """The middle of a bin."""
    return F.when(b.isNull(), F.lit(0.0)).otherwise(F.exp((b + 0.5) / GRAIN))


def sketches(m: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, measure, value, weight): counts of the documents that pass the base
    rules, and the language's POINTS points."""
    names = [*FLOORS, "word_length"]
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), bin_of(F.col(c)).alias("bin")) for c in names]))
    own = stage(m.where("NOT base_failed").select("lang", "source", long).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")), "quality-sketches")
    lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "measure")
    upto = F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lang = lang.withColumn("upto", upto).withColumn("all", F.sum("n").over(group))
    # point i lies at rank (i + 1/2) / POINTS of the language: in the bin that reaches it
    place = lambda c: F.ceil(c * POINTS / F.col("all") - 0.5)                                  # noqa: E731
    lang = lang.withColumn("points", place(F.col("upto")) - place(F.col("upto") - F.col("n"))).where("points > 0")
    groups = own.select("lang", "source", "measure").distinct()
    lean = groups.join(lang.select(F.col("lang").alias("__lang"), F.col("measure").alias("__measure"), "bin", "points"),
                       F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("measure") == F.col("__measure")))
    weighed = own.select("lang", "source", "measure", "bin", F.col("n").cast("double").alias("weight")) \
        .union(lean.select("lang", "source", "measure", "bin", F.col("points") * (prior / POINTS)))
    return weighed.groupBy("lang", "source", "measure", "bin").agg(F.sum("weight").alias("weight")).withColumn("value", value_of(F.col("bin")))


def thresholds(m: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Upper (and for word_length lower) fences per lang and source, from the
    documents that pass the base rules."""
    s = sketches(m, prior)
    group = Window.partitionBy("lang", "source", "measure")
    s = s.withColumn("upto", F.sum("weight").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("all", F.sum("weight").over(group))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all") - 1e-6, F.col("value")))       # noqa: E731
    q = s.groupBy("lang", "source", "measure").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    mid, low, high = F.col("mid"), F.col("low"), F.col("high")
    ratio = lambda a, b: F.pow(F.greatest(a / b, F.lit(WORD_LENGTH_FLOOR)), F.lit(FENCE))           # noqa: E731
    of = lambda c, fence: F.max(F.when(F.col("measure") == c, fence))                               # noqa: E731
    fences = [of(c, mid + FENCE * F.greatest(high - mid, F.lit(floor))).alias(f"{c}_max") for c, floor in FLOORS.items()]
    fences += [of("word_length", mid * ratio(high, mid)).alias("word_length_max"), of("word_length", mid / ratio(mid, low)).alias("word_length_min")]
    return q.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*fences)


def rate(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Columns: doc_id, lang, source, the counts, shares and thresholds, base_failed,
    kept.  Null or empty text: all counts 0, fails the base rules.  Null lang or
    source is a group of its own.  A group without a passing document has no
    thresholds and needs none.  Repeated rows stay and count as often as they
    come; ties with a threshold are kept.  The verdicts do not depend on how the rows
    are dealt out.  An empty table gives no rows; other columns are ignored."""
    m = stage(measures(docs), "quality-measures")
    t = stage(thresholds(m, prior), "quality-thresholds")
    t = F.broadcast(t) if t.count() <= BROADCAST_GROUPS else t
    j = m.join(t, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    fine = (F.col("word_length") >= F.col("word_length_min"))
    for c in [*FLOORS, "word_length"]:
        fine = fine & (F.col(c) <= F.col(f"{c}_max"))
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE: dict[str, str] = {}
QUERIES = {"op2_adaptive_quality": op2_adaptive_quality}
ship_by_value(__name__)

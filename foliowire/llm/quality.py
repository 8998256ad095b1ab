"""Quality rules with thresholds taken from the corpus, per language and source.

Every document yields a few integer measures. Each measure of each (language, source) is summarised by a histogram
sketch over a fixed integer grid: adding two sketches is adding counts, so sketches merge exactly in any order, combine
on the map side and hold at most a few thousand counts whatever the corpus size.

The sketch of a group is read beside ``PRIOR`` documents' worth of its language's sketch, which in turn has ``PRIOR``
documents' worth of the whole corpus: large groups go by their own documents, small ones lean on the others, and no size
switches from one to the other. A fence lies ``REACH`` times as far beyond the tail quantile as that lies from the
median, so up to a tenth of a group may be bad without moving it far. A document is rejected when a measure lies outside
the fence of its group by more than a few occurrences; a short text is not condemned by one repeated line.

Defined results: a null text has no words; null languages and sources form groups of their own; rows that repeat a
doc_id are judged one by one; an empty table gives an empty result; other columns of the input are ignored by
``verdicts`` and returned unchanged by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliowire.llm.common import WORD, map_frames, materialise, small_side, split_words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents' worth of the wider sketch that is added to a narrower one.
PRIOR = 100
#: Weight of one document in a blended sketch; keeps the shares of the wider sketch in whole numbers.
UNIT = 1_000_000
#: Percent of the documents at or below the upper tail quantile; the lower one mirrors it.
TAIL = 85
#: A fence lies this many times the distance from median to tail quantile beyond it; the distance has at least a few cells.
REACH, LEAST_STEP = 6, 5
#: Measure -> (counted part, whole, cells for part = whole, last cell, occurrences granted beyond the fence, fence below as well).
MEASURES = {
    "symbol_rate": ("n_symbols", "n_words", 1000, 1000, 5, False),
    "upper_rate": ("n_upper", "word_chars", 1000, 1000, 10, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 1000, 2, False),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, 1000, 20, False),
    "word_length": ("word_chars", "n_words", 100, 5000, 0, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True


def repeated_words(words: list[str]) -> int:
    """Words covered by a window of three words that occurs at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(codes) + ids[1:]
    if len(codes) > 2_000_000:  # the product of three codes would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    text = text or ""
    words = split_words(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), int(_SYMBOL_BYTES[raw].sum()), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), int(((raw >= 65) & (raw <= 90)).sum()))


def _measured(batches: Iterator[pd.DataFrame], text: str = "text", keep: bool = False) -> Iterator[pd.DataFrame]:
    """The counts of column ``text`` beside the other columns, and beside the text itself if it is kept."""
    for batch in batches:
        values = np.array([measure(t) for t in batch[text]], np.int64).reshape(-1, len(COUNTS))
        yield pd.concat([batch if keep else batch.drop(columns=text), pd.DataFrame(values, batch.index, COUNTS)], axis=1)


def measures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source and the counts, without the text."""
    kept = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_frames(kept, _measured, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _cells() -> dict:
    """Grid cell of each measure, in integer arithmetic."""
    return {name: F.least(F.lit(top), F.expr(f"{scale} * {part} div greatest({whole}, 1)"))
            for name, (part, whole, scale, top, _, _) in MEASURES.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """The mergeable sketches: (lang, source, measure, cell, n) over documents that pass the base rules."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("long").alias("cell")) for m, c in _cells().items()])
    long = measured.where(~base_failed()).select("lang", "source", F.inline(cells))
    return long.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n"))


def _leaning(sketch: DataFrame, keys: list[str], wider: DataFrame, wider_keys: list[str]) -> DataFrame:
    """Weights (keys, measure, cell, weight): ``sketch`` merged by ``keys`` beside PRIOR documents' worth of ``wider``.

    ``wider`` has (wider_keys, measure, cell, weight, total) with the sum of its weights in documents.
    """
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    groups, lent = merged.select(*keys, "measure").distinct().alias("g"), wider.alias("w")
    same = F.col("g.measure") == F.col("w.measure")
    for key in wider_keys:
        same = same & F.col(f"g.{key}").eqNullSafe(F.col(f"w.{key}"))
    share = F.expr(f"{PRIOR} * w.weight div w.total")
    borrowed = groups.join(lent, same).select("g.*", "w.cell", share.alias("weight"))
    own = merged.withColumn("weight", UNIT * F.col("n")).drop("n")
    return own.unionByName(borrowed).groupBy(*keys, "measure", "cell").agg(F.sum("weight").alias("weight"))


def blended(sketch: DataFrame) -> DataFrame:
    """Weights per (lang, source, measure, cell) in units of a document: own, language and corpus counts."""
    # the corpus sketch has one row per cell of the grid, 9005 at most
    corpus = sketch.groupBy("measure", "cell").agg(F.sum("n").alias("n"))
    corpus = corpus.select("measure", "cell", (UNIT * F.col("n")).alias("weight"), F.sum("n").over(Window.partitionBy("measure")).alias("total"))
    of_lang = _leaning(sketch, ["lang"], F.broadcast(corpus), [])
    totals = sketch.groupBy(F.col("lang").alias("l"), F.col("measure").alias("m")).agg((F.sum("n") + PRIOR).alias("total"))
    lent = of_lang.join(small_side(totals), F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).drop("l", "m")
    return _leaning(sketch, ["lang", "source"], lent, ["lang"])


LIMITS = [f"max_{m}" for m in MEASURES] + [f"min_{m}" for m, v in MEASURES.items() if v[-1]]


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): the highest and, where a measure has one, the lowest accepted cell of each measure."""
    weights = blended(materialise(sketches(measured), "quality-sketch"))
    group = Window.partitionBy("lang", "source", "measure")  # at most the cells of the grid
    ranked = (weights.withColumn("below", F.sum("weight").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("total", F.sum("weight").over(group)))
    quantile = lambda percent: F.min(F.when(100 * F.col("below") >= percent * F.col("total"), F.col("cell")))
    read = ranked.groupBy("lang", "source", "measure").agg(
        quantile(100 - TAIL).alias("low"), quantile(50).alias("middle"), quantile(TAIL).alias("high"))
    step = lambda distance: REACH * F.greatest(distance, F.lit(LEAST_STEP))
    above, below = F.col("high") + step(F.col("high") - F.col("middle")), F.col("low") - step(F.col("middle") - F.col("low"))
    columns = []
    for limit in LIMITS:
        side, name = limit.split("_", 1)
        columns.append(F.max(F.when(F.col("measure") == name, above if side == "max" else below)).alias(limit))
    return read.groupBy("lang", "source").agg(*columns)


def _within(name: str):
    """Whether a document's measure stays within the fence of its group."""
    part, whole, scale, top, granted, both = MEASURES[name]
    value = F.expr(f"least({scale} * {part}, {top} * greatest({whole}, 1))")
    size = F.greatest(F.col(whole), F.lit(1))
    ok = value <= F.col(f"max_{name}") * size + scale * granted
    if both:
        ok = ok & (value >= F.col(f"min_{name}") * size)
    return F.coalesce(ok, F.lit(True))


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with base_failed, kept and, for documents past the base rules, the measures outside their fence."""
    m, f = measured.alias("m"), small_side(fences).alias("f")
    same = F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source"))
    joined = m.join(f, same, "left").select("m.*", *[F.col(f"f.{c}") for c in LIMITS]).withColumn("base_failed", base_failed())
    outside = F.array_compact(F.array(*[F.when(~F.col("base_failed") & ~_within(name), name) for name in MEASURES]))
    return joined.withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    measured = materialise(measures(docs), "quality-measures")
    fences = materialise(thresholds(measured), "quality-fences")
    return judged(measured, fences).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.

    The measures are taken once more beside the text instead of shuffling the texts for a join.
    """
    measured = materialise(measures(docs), "quality-measures")
    fences = materialise(thresholds(measured), "quality-fences")
    safe = [f"_c{k}" for k in range(len(docs.columns))]  # names that clash with no measure
    named = dict(zip(docs.columns, safe))
    beside = docs.toDF(*safe).select("*", *[F.col(named[c]).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"))])
    schema = StructType([*beside.schema.fields, *[StructField(c, LongType()) for c in COUNTS]])
    text = named["text"]
    measured_beside = map_frames(beside, lambda batches: _measured(batches, text, True), schema)
    return judged(measured_beside, fences).where("kept").select(*safe).toDF(*docs.columns)

"""Mixing sources to target weights, block by block.

The words of a source form one stream in an order fixed by hashes of doc_id, and are packed into blocks of a fixed number of
words. A source with target T and size S takes every block floor(T / S) times and, in one more epoch, as many blocks as the rest of T needs.
These draws of all sources are numbered through, and one pseudorandom permutation (a Feistel network with cycle walking)
sends each number to an output slot; consecutive slots form a shard. The source counts of a shard are thereby multinomial
draws conditioned on the source totals, so the mix as a whole meets its targets and no block is used more often than its
epochs allow; independent draws per shard would miss small targets and break the limit of three uses. Within an epoch the order of blocks is a permutation
of its own per source. Slots and blocks meet in an equi-join on (source, block), which spreads every source evenly.

Targets: source weights repeat a given tuple in the order of code points with null last and share the total size; a target stops at three
times its source's size and the excess is shared again by weight.

Defined results: null and empty texts have size 0 and are never taken; rows that repeat a doc_id are documents of their
own; a null source is a source; an empty table gives an empty result; other columns are ignored by ``taken`` and kept by
``mixed_documents``. Nothing depends on the layout of the input, except which of several rows with equal doc_id and size comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliowire.llm.common import WORD, WORD_PATTERN, map_frames, materialise, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 1024
#: Documents per piece of a source's stream; sizes are summed within pieces, then over pieces.
PIECE_DOCS = 2000
#: Draws expanded in one go, and in one task.
DRAWS, TASK_DRAWS = 1 << 15, 1 << 18
SEED = 20240229


def _mixed_bits(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x and a key, vectorised."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of range(size)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(_mixed_bits(np.array([seed & (2**64 - 1)], np.uint64), 7 * r + 1)[0]) for r in range(4)]

    def network(x):
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            left, right = right, left ^ (_mixed_bits(right, key) & mask)
        return (left << np.uint64(half)) | right

    out = network(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(size))).size:  # walk the cycle back into the range
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size and a row number (the named column, if any) that tells repeated rows apart."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"),
                       (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: source_no, source, source_size, weight, target. The windows run over sources only."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = (sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
                .withColumn("weight", weight).withColumn("most", F.lit(float(MAX_EPOCHS)) * F.col("source_size")))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = Window.partitionBy(F.lit(0))
    # shared so far if all sources with less room per weight are at their limit
    level = ((F.sum("source_size").over(everything) - (F.sum("most").over(by_room) - F.col("most")))
             / (F.sum("weight").over(everything) - (F.sum("weight").over(by_room) - F.col("weight"))))
    levelled = numbered.withColumn("level", level).withColumn("full", F.col("weight") * F.col("level") > F.col("most"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "source_no", "level"))).over(everything)["level"]
    return levelled.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * final)).select(
        "source_no", "source", "source_size", "weight", "target")


def _plan(goals: DataFrame, block_words: int) -> DataFrame:
    """Per source the blocks, the draws, and the number of the first draw among all."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = F.when(F.col("epochs") >= MAX_EPOCHS, 0).otherwise(F.least(F.round(rest / block_words).cast("long"), F.col("blocks")))
    counted = goals.withColumn("blocks", blocks).withColumn("epochs", epochs).withColumn("draws", F.col("epochs") * F.col("blocks") + extra)
    return (counted.withColumn("first", F.sum("draws").over(Window.orderBy("source_no")) - F.col("draws"))
            .withColumn("slots", F.sum("draws").over(Window.partitionBy(F.lit(0)))))


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            draw = np.arange(r.begin, min(r.begin + DRAWS, r.draws))
            epoch = draw // r.blocks
            block = np.empty_like(draw)
            for e in np.unique(epoch):
                own = epoch == e
                block[own] = permuted(draw[own] - e * r.blocks, int(r.blocks), SEED + 1_000_003 * int(r.source_no) + int(e) + 1)
            slot = permuted(r.first + draw, int(r.slots), SEED)
            yield pd.DataFrame({"source_no": r.source_no, "block": block, "epoch": epoch.astype(np.int32), "slot": slot,
                                "shard": slot // SHARD_SLOTS})


def draws(plan: DataFrame) -> DataFrame:
    """One row per output slot: source_no, block, epoch, slot, shard.

    The number of tasks follows the slots; the planner sees only the few rows they are expanded from.
    """
    some = plan.where("draws > 0")
    tasks = (plan.agg(F.max("slots")).first()[0] or 0) // TASK_DRAWS + 1
    pieces = some.select("source_no", "blocks", "draws", "first", "slots",
                         F.explode(F.expr(f"sequence(0L, draws - 1, {DRAWS}L)")).alias("begin"))
    return pieces.repartition(tasks, "source_no", "begin").mapInPandas(
        _drawn, "source_no long, block long, epoch int, slot long, shard long")


def _placed(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Where each document begins in the stream of its source: running sums within pieces, then over pieces."""
    pieces = max(1, sizes.count() // PIECE_DOCS)
    joined = sizes.join(goals.select("source", "source_no"), sizes["source"].eqNullSafe(goals["source"])).drop("source")
    keyed = joined.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    inner = Window.partitionBy("source_no", "piece").orderBy("doc_id", "size", "row")
    local = keyed.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    totals = keyed.groupBy("source_no", "piece").agg(F.sum("size").alias("words"))
    before = totals.withColumn("before", F.sum("words").over(Window.partitionBy("source_no").orderBy("piece")) - F.col("words"))
    return (local.join(before.drop("words"), ["source_no", "piece"])
            .select("row", "source_no", "size", (F.col("before") + F.col("within")).alias("begin")))


def block_parts(placed: DataFrame, block_words: int) -> DataFrame:
    """The words each document has in each block: row, source_no, block, word (first, counted in the document), words."""
    end = F.col("begin") + F.col("size")
    parts = placed.where("size > 0").select(
        "row", "source_no", "begin", end.alias("end"),
        F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")).alias("block"))
    start, stop = F.greatest(F.col("block") * block_words, "begin"), F.least((F.col("block") + 1) * block_words, "end")
    return parts.select("row", "source_no", "block", (start - F.col("begin")).alias("word"), (stop - start).alias("words"))


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The targets, and every slot filled with parts of documents: row, epoch, slot, shard, word, words."""
    goals = materialise(targets(sizes, weights), "mix-targets")
    slots = draws(_plan(goals, block_words))
    parts = block_parts(_placed(sizes, goals), block_words)
    # the planner sees the few rows that the slots are expanded from; they must not be broadcast
    return goals, parts.join(slots.hint("merge"), ["source_no", "block"]).select("row", "epoch", "slot", "shard", "word", "words")


def taken(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, its source's source_size and target, and the words the mix takes from it."""
    sizes = materialise(sized(docs), "mix-sizes")
    goals, filled = mix(sizes, weights, block_words)
    words = filled.groupBy("row").agg(F.sum("words").alias("taken"))
    wide = sizes.join(goals.withColumnRenamed("source", "s"), sizes["source"].eqNullSafe(F.col("s")))
    return wide.join(words, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: str, spans: list) -> str:
    """The words of ``text`` in the given (first word, number of words) spans; adjoining spans keep what stands between."""
    at = [m.span() for m in WORD.finditer(text)]
    runs: list[list[int]] = []
    for s in sorted((s["word"], s["words"]) for s in spans):
        if runs and runs[-1][1] == s[0]:
            runs[-1][1] += s[1]
        else:
            runs.append([s[0], s[0] + s[1]])
    if runs == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per document and epoch that takes from it, with the text taken and n_chars to match.

    All columns of ``docs`` are returned; those other than text and n_chars are repeated as they are.
    """
    row = unused("row_number", docs.columns)
    spans = unused("taken_spans", docs.columns)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    sizes = materialise(sized(numbered, row), "mix-sizes")
    _, filled = mix(sizes)
    wanted = filled.groupBy(F.col("row").alias(row), "epoch").agg(F.collect_list(F.struct("word", "words")).alias(spans))
    both = numbered.join(wanted.drop("epoch"), row)

    def cut(batches):
        for batch in batches:
            batch["text"] = [_cut(t, s) for t, s in zip(batch["text"], batch[spans])]
            yield batch

    out = map_frames(both, cut, both.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Exact similarity within a bounded history, duplicate flags, and block joins over embedding vectors.

Everything that compares items with earlier ones looks back a fixed number of positions in its scope, so the work per
row does not depend on the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.session import cut_lineage

BLOCK_ROWS = 2048  # vectors per side of one block join task
BALL_ROWS, MOST_BALLS = 1024, 2048  # vectors that a ball should hold, and balls of a table
SAMPLE_PER_BALL = 4  # vectors that pivots are chosen from, per ball
MOST_SIDES, SIDE_BYTES = 24, 1 << 25  # sides that a table is cut into for pairs within it, and how much a side may hold
PIECE_PAIRS = 1 << 22  # pairs that a task compares at a time


def _unit(column: pd.Series) -> np.ndarray:
    matrix = np.stack(column.to_numpy()).astype("float64")
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def with_position(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Adds ``position``, counted from 0 in ``order`` within each scope, without gathering a scope in one task.

    A global sort spreads any scope over many range partitions. The sorted rows are checkpointed, so their
    partition and row numbers stay fixed; offsets come from one small row per (scope, partition).
    """
    placed = cut_lineage(df.orderBy(*scope, *order).withColumn("_at", F.monotonically_increasing_id()))
    slot = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = slot.groupBy(*scope, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    before = F.sum("_n").over(W.partitionBy(*scope).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)) if scope else \
        F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return slot.join(offsets, [*scope, "_part"]).withColumn(
        "position", F.col("_before") + F.col("_at") - F.col("_start")).drop("_at", "_part", "_start", "_before")


def _placed(items: DataFrame, scope: list[str], order: list[str], id_col: str) -> DataFrame:
    return with_position(items.select(*dict.fromkeys([id_col, *scope, *order]), "vector"), scope, order)


def _history_blocks(placed: DataFrame, scope: list[str], id_col: str, history: int) -> DataFrame:
    """Positions cut into blocks of ``history``; a task holds a block as probe and the one before it."""
    block = F.floor(F.col("position") / history)
    sides = F.array(F.struct(block.alias("block"), F.lit(True).alias("probe")), F.struct((block + 1).alias("block"), F.lit(False).alias("probe")))
    return placed.select(id_col, *scope, "position", "vector", F.explode(sides).alias("s")).select(
        id_col, *scope, "position", "vector", "s.block", "s.probe")


def _lookback(pdf: pd.DataFrame, history: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a task, which are probes, their cosines to all rows, and which rows lie in their history."""
    pdf = pdf.sort_values("position")
    probe, vectors, position = pdf["probe"].to_numpy(), _unit(pdf["vector"]), pdf["position"].to_numpy()
    gap = position[probe][:, None] - position[None, :]
    return pdf, probe, vectors[probe] @ vectors.T, (gap > 0) & (gap <= history)


def earlier_similarity(items: DataFrame, scope: list[str], order: list[str], id_col: str, threshold: float = domain.DEDUP_SIMILARITY,
                       history: int = domain.HISTORY_STORE) -> DataFrame:
    """Largest cosine of each item to the ``history`` items before it in its scope, and the duplicate flag."""
    rows = _history_blocks(_placed(items, scope, order, id_col), scope, id_col, history)
    id_type = items.schema[id_col].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, probe, similar, before = _lookback(pdf, history)
        best = np.where(before, similar, 0.0).max(axis=1, initial=0.0)
        return pd.DataFrame({id_col: pdf[id_col].to_numpy()[probe], "max_similarity": best})

    scored = rows.groupBy(*scope, "block").applyInPandas(compare, f"{id_col} {id_type}, max_similarity double")
    return scored.withColumn("is_duplicate", F.col("max_similarity") >= threshold)


def distinct_vectors(items: DataFrame, scope: list[str], order: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of each scope without their copies, and the mapping of every copy to its first occurrence.

    Copies are reduced on the map side, so a vector held by a third of all rows costs one row per task.
    """
    rest = list(dict.fromkeys([*order, id_col]))
    firsts = items.groupBy(*scope, "vector").agg(F.min(F.struct(*rest)).alias("first"), F.count(F.lit(1)).alias("copies"))
    unique = firsts.select(*[F.col(f"first.{c}").alias(c) for c in rest], *[c for c in scope if c not in rest], "vector", "copies")
    repeated = unique.where("copies > 1").select(F.col(id_col).alias("first_id"), *scope, "vector")
    copies = items.select(*dict.fromkeys([id_col, *scope]), "vector").join(repeated, [*scope, "vector"]).where(
        F.col(id_col) != F.col("first_id")).select(id_col, "first_id")
    return unique, copies


def similar_pairs(items: DataFrame, scope: list[str], order: list[str], id_col: str, threshold: float,
                  history: int = domain.HISTORY_STORE) -> DataFrame:
    """(earlier_id, later_id, cosine): near-duplicate candidates within ``history`` distinct vectors of a scope.

    Copies of a vector are collapsed before the comparison and paired with their first occurrence only, so a
    crowd of copies yields as many pairs as it has members. A row meets at most ``history`` others.
    """
    unique, copies = distinct_vectors(items, scope, order, id_col)
    rows = _history_blocks(_placed(unique, scope, order, id_col), scope, id_col, history)
    id_type = items.schema[id_col].dataType.simpleString()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, probe, similar, before = _lookback(pdf, history)
        i, j = np.nonzero(before & (similar >= threshold))
        ids = pdf[id_col].to_numpy()
        return pd.DataFrame({"earlier_id": ids[j], "later_id": ids[probe][i], "cosine": similar[i, j]})

    found = rows.groupBy(*scope, "block").applyInPandas(match, f"earlier_id {id_type}, later_id {id_type}, cosine double")
    return found.unionByName(copies.select(F.col("first_id").alias("earlier_id"), F.col(id_col).alias("later_id"), F.lit(1.0).alias("cosine")))


def greedy_filter(kept: np.ndarray, kept_at: np.ndarray, vectors: np.ndarray, times: np.ndarray, threshold: float, store: int, memory: int,
                  ttl: float | None):
    """Similarity and flag of ordered unit vectors against the kept ones, and the kept ones afterwards.

    The newest ``memory`` kept vectors are consulted first, the newest ``store`` only when they show no
    duplicate. Kept vectors older than ``ttl`` seconds no longer count.
    """
    similarity, duplicate = np.zeros(len(vectors)), np.zeros(len(vectors), dtype=bool)
    for i, (vector, now) in enumerate(zip(vectors, times)):
        if ttl is not None and len(kept):
            alive = kept_at >= now - ttl
            kept, kept_at = kept[alive], kept_at[alive]
        near = kept @ vector if len(kept) else np.zeros(0)
        best = max(near[-memory:].max(initial=0.0), 0.0)
        if best < threshold:
            best = max(best, near.max(initial=0.0))
        similarity[i], duplicate[i] = best, best >= threshold
        if not duplicate[i]:
            kept = np.vstack([kept, vector[None, :]])[-store:] if len(kept) else vector[None, :]
            kept_at = np.append(kept_at, now)[-store:]
    return similarity, duplicate, kept, kept_at


def in_key_order(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Run a state through the ordered rows of every key: ``step(state, rows) -> (state, result rows)``.

    The rows of a key are sorted by the shuffle and streamed in pieces, so a key of any size needs the memory
    of one piece and of its state only.
    """
    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                if str(key) != current:
                    current, state = str(key), start()
                state, out = step(state, rows)
                yield out

    return placed.mapInPandas(run, schema)


def greedy_duplicates(items: DataFrame, scope: list[str], order: list[str], id_col: str, threshold: float = domain.DEDUP_SIMILARITY,
                      store: int = domain.HISTORY_STORE, memory: int = domain.HISTORY_MEMORY) -> DataFrame:
    """(id, max_similarity, is_duplicate) when an item is compared with the kept items of a bounded history before it.

    An item meets the newest ``memory`` kept items of its scope and, if none is similar, the newest ``store``.
    """
    id_type = items.schema[id_col].dataType.simpleString()

    def step(kept: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        vectors = _unit(rows["vector"])
        kept = kept.reshape(-1, vectors.shape[1])
        similarity, duplicate, kept, _ = greedy_filter(kept, np.zeros(len(kept)), vectors, np.zeros(len(vectors)), threshold, store, memory, None)
        return kept, pd.DataFrame({id_col: rows[id_col], "max_similarity": similarity, "is_duplicate": duplicate})

    slim = items.select(*dict.fromkeys([id_col, *scope, *order]), "vector")
    return in_key_order(slim, scope, order, lambda: np.zeros((0, 1)), step, f"{id_col} {id_type}, max_similarity double, is_duplicate boolean")


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, match: Callable, schema: str) -> DataFrame:
    """``match(left rows, right rows)`` for every pair of a left and a right block, each pair a task of bounded size.

    Rows with one value of a key column share a block. The comparison of all with all is the operator's work;
    what leaves a task is up to ``match``.
    """
    n_left, n_right = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (left, right))

    def dealt(df, key, own, other, n_own, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    a = dealt(left, left_key, "_left", "_right", n_left, n_right).groupBy("_left", "_right")
    b = dealt(right, right_key, "_right", "_left", n_right, n_left).groupBy("_left", "_right")
    return a.cogroup(b).applyInPandas(match, schema)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` rows, each the farthest from those chosen before, so that every neighbourhood of the sample has one."""
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Balls:
    """Unit vectors of a table, each in the ball of its nearest pivot; large balls in parts of bounded size.

    ``rows`` is the checkpointed table with ``_ball`` and ``_part``; pivots, radii and numbers of rows are small arrays.
    """

    def __init__(self, df: DataFrame, key: str):
        df = df.where(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
        count = df.count()
        balls = min(MOST_BALLS, -(-count // BALL_ROWS))
        sample = df.orderBy(F.xxhash64(key), key).limit(SAMPLE_PER_BALL * balls).select("vector").toPandas()
        self.pivots = pivots = _pivots(_unit(sample["vector"]), balls) if count else np.zeros((0, 1))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("vector")
                vectors = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
                ball = (vectors @ pivots.T).argmax(axis=1) if batch.num_rows else np.zeros(0, int)
                away = np.linalg.norm(vectors - pivots[ball], axis=1)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, max(1, vectors.shape[1])), pa.int32()), pa.array(vectors.ravel()))
                columns = [unit if k == at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ball, pa.int32()), pa.array(away)], [*batch.schema.names, "_ball", "_away"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _ball int, _away double"
        placed = cut_lineage(df.mapInArrow(placed, schema))
        self.radius, self.rows_in = np.zeros(len(pivots)), np.zeros(len(pivots), int)
        for r in placed.groupBy("_ball").agg(F.max("_away").alias("away"), F.count(F.lit(1)).alias("n")).collect():
            self.radius[r._ball], self.rows_in[r._ball] = r.away, r.n
        self.parts = -(-self.rows_in // BLOCK_ROWS)
        parts = F.array(*[F.lit(int(p)) for p in self.parts]) if len(pivots) else F.array(F.lit(1))
        self.rows = placed.drop("_away").withColumn("_part", F.pmod(F.xxhash64(key), F.get(parts, F.col("_ball"))).cast("int"))


def ball_pairs(spark, left: Balls, right: Balls, threshold: float) -> DataFrame:
    """(left, right, pairs): the balls that may hold two vectors with a cosine of ``threshold``, and how many pairs they make.

    For a ball with pivot b and radius s and one with c and r, no cosine exceeds b c + s |c| + r.
    """
    reach, extent = np.linalg.norm(right.pivots, axis=1), (left.pivots, left.radius, right.pivots, right.radius)
    left_rows, right_rows = left.rows_in, right.rows_in

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, s, c, r = extent
        for batch in batches:
            i = batch["id"].to_numpy()
            bound = b[i] @ c.T + s[i][:, None] * reach + r
            x, y = np.nonzero((bound >= threshold - 1e-9) & (left_rows[i][:, None] > 0) & (right_rows > 0))
            yield pd.DataFrame({"left": i[x].astype("int32"), "right": y.astype("int32"), "pairs": left_rows[i[x]] * right_rows[y]})

    return spark.range(len(left.pivots) if len(right.pivots) else 0).mapInPandas(near, "left int, right int, pairs long")


def ball_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float, match: Callable, schema: str) -> DataFrame:
    """``match(left rows, right rows)`` for the parts of all balls that may hold a pair with a cosine of ``threshold``.

    Rows come with unit vectors; balls whose bound is too low never meet. A task holds one part of either side.
    """
    a, b = Balls(left, left_key), Balls(right, right_key)
    parts = [F.array(*[F.lit(int(p)) for p in (x.parts if len(x.parts) else [1])]) for x in (a, b)]
    met = ball_pairs(left.sparkSession, a, b, threshold).select(
        F.col("left").alias("_left"), F.col("right").alias("_right"), F.get(parts[0], F.col("left")).alias("m"), F.get(parts[1], F.col("right")).alias("n"))
    met = cut_lineage(met.select("_left", "_right", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("_lpart"), "n").select(
        "_left", "_right", "_lpart", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_rpart")))
    keys = ["_left", "_lpart", "_right", "_rpart"]
    lefts = a.rows.withColumnsRenamed({"_ball": "_left", "_part": "_lpart"}).join(met, ["_left", "_lpart"])
    rights = b.rows.withColumnsRenamed({"_ball": "_right", "_part": "_rpart"}).join(met, ["_right", "_rpart"])
    return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInPandas(match, schema)


def cross_similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs across two tables with cosine at or above ``threshold``; exact."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id))]

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({left_id: [], right_id: [], "cosine": []})
        similar = np.stack(a["vector"]) @ np.stack(b["vector"]).T
        i, j = np.nonzero(similar >= threshold)
        return pd.DataFrame({left_id: a[left_id].to_numpy()[i], right_id: b[right_id].to_numpy()[j], "cosine": similar[i, j]})

    return ball_join(left.select(left_id, "vector"), right.select(right_id, "vector"), left_id, right_id, threshold, match,
                     f"{left_id} {kinds[0]}, {right_id} {kinds[1]}, cosine double")


class Sides:
    """Neighbouring balls of one table gathered into sides of many rows, large balls dealt over several.

    A row is sent once for every side that its own may hold a close pair with. There are about ``MOST_SIDES`` sides however many rows
    there are, until a side of ``SIDE_BYTES`` is reached, so what is sent grows with the rows. ``near`` tells which balls may hold a pair.
    """

    def __init__(self, balls: Balls, threshold: float):
        b, radius, filled = balls.pivots, balls.radius, balls.rows_in
        reach = np.linalg.norm(b, axis=1)
        bound = b @ b.T + radius[:, None] * reach + radius  # see ball_pairs
        self.near = (bound >= threshold - 1e-9) & (filled[:, None] > 0) & (filled > 0)
        most = max(1, min(SIDE_BYTES // (8 * b.shape[1]), max(BLOCK_ROWS, -(-int(filled.sum()) // MOST_SIDES))))
        self.first, self.count = np.zeros(len(b), int), np.maximum(1, -(-filled // most))
        side, room = 0, most
        for ball in np.lexsort((np.arange(len(b)), (b @ b[:MOST_SIDES].T).argmax(axis=1))) if len(b) else ():  # the first pivots lie far apart
            if room < most and filled[ball] > room:
                side, room = side + 1, most
            self.first[ball] = side
            if filled[ball] > most:
                side, room = side + self.count[ball], most
            else:
                room -= filled[ball]
        held = np.zeros((side + 1, len(b)), bool)
        for ball in range(len(b)):
            held[self.first[ball]:self.first[ball] + self.count[ball], ball] = True
        meet = (held.astype("float32") @ self.near.astype("float32") @ held.T.astype("float32")) > 0
        low, high = np.nonzero(np.triu(meet | meet.T))
        once = low != high
        #: the pairs of sides, in a row for each side that takes part
        self.meetings = pd.DataFrame({"_side": np.concatenate([low, high[once]]), "_low": np.concatenate([low, low[once]]), "_high": np.concatenate([high, high[once]])}, dtype="int32")

    def of(self, key: str):
        """The side of a row by its ball and key."""
        first, count = (F.array(*[F.lit(int(x)) for x in column]) if len(column) else F.array(F.lit(1)) for column in (self.first, self.count))
        return (F.get(first, F.col("_ball")) + F.pmod(F.xxhash64(key), F.get(count, F.col("_ball")))).cast("int").alias("_side")


def near_copies(items: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(earlier_id, later_id, cosine): all pairs of different vectors with a cosine of ``threshold``, wherever they stand.

    Exact: balls that cannot hold such a pair are never compared. A task holds two sides of balls and hands out its pairs piece by piece.
    Copies of a vector are collapsed first and paired with their first occurrence only, so a crowd of copies yields as many pairs as
    it has members.
    """
    unique, copies = distinct_vectors(items.select(id_col, "vector"), [], [id_col], id_col)
    unique = cut_lineage(unique.select(id_col, "vector").where(F.col(id_col).isNotNull()))
    balls = Balls(unique.withColumn("_given", F.col("vector")), id_col)
    sides = Sides(balls, threshold)
    near, id_type = sides.near, items.schema[id_col].dataType.simpleString()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.sort_values(["_side", "_ball"], kind="stable")
        vectors, ids, ball, side = _unit(rows["_given"]), rows[id_col].to_numpy(), rows["_ball"].to_numpy(), rows["_side"].to_numpy()
        low, high = rows["_low"].iloc[0], rows["_high"].iloc[0]
        partner = np.nonzero(side == high)[0]
        for own in np.unique(ball[side == low]):
            others = partner[near[own, ball[partner]] | near[ball[partner], own]]
            mine = np.nonzero((ball == own) & (side == low))[0]
            step = max(1, PIECE_PAIRS // max(1, len(others)))
            for at in range(0, len(mine) if len(others) else 0, step):
                part = mine[at:at + step]
                similar = vectors[part] @ vectors[others].T
                i, j = np.nonzero((similar >= threshold) & (others > part[:, None]))  # within a side each pair once
                a, b = ids[part[i]], ids[others[j]]
                yield pd.DataFrame({"earlier_id": np.where(a < b, a, b), "later_id": np.where(a < b, b, a), "cosine": similar[i, j]})[a != b]

    met = items.sparkSession.createDataFrame(sides.meetings, "_side int, _low int, _high int")
    sent = balls.rows.select(id_col, "_given", "_ball", sides.of(id_col)).join(met, "_side")
    found = sent.groupBy("_low", "_high").applyInPandas(match, f"earlier_id {id_type}, later_id {id_type}, cosine double")
    return found.unionByName(copies.select(F.col("first_id").alias("earlier_id"), F.col(id_col).alias("later_id"), F.lit(1.0).alias("cosine")))

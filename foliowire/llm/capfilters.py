"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product reaches a threshold. The directions form random
product codes: the rotated space is cut into two blocks, each block has a random code of its own, and every combination of a
codeword of each is a direction. List decoding finds all directions that a vector exceeds without trying them one by
one: a codeword is considered only where the best of the other block could complete it. Several codes with rotations of their own
even out how many filters a vector passes. Vectors that share a filter are compared exactly, in double precision.

The number of directions follows the number of vectors, so that a filter keeps few members whatever the size of the table.
The threshold is the largest on a grid at which all but a few pairs (SAMPLE_MISSES of SAMPLE_PAIRS) of a fixed random
sample at the wanted cosine share a filter. It depends on the dimension and the code only.

Equal vectors are one class with a number of copies, so pairs are pairs of classes. A filter with many members is split into
blocks; a task compares two blocks by one matrix product, and reports sums of links and a spanning forest but no pairs. A
pair that shares several filters counts where the least of them is handled.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing, as do rows without vec_id and
vectors of different lengths; rows that repeat a vec_id are vectors of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import materialise
from foliowire.llm.components import components, least_reachable

COSINE = 0.9
#: Product codes; the codewords of a block follow the square root of the number of vectors, within limits.
CODES = 8
CODEWORDS_PER_ROOT, LEAST_CODEWORDS, MOST_CODEWORDS = 4, 64, 1 << 16
#: Members of a filter that one task compares with as many others.
BLOCK = 512
#: Rows that one comparing task should hold.
TASK_ROWS = 20_000
#: Pairs on which the threshold is set, and those of them that may share no filter.
SAMPLE_PAIRS, SAMPLE_MISSES = 500, 1
SEED = 11


@lru_cache(maxsize=16)
def product_codes(dimension: int, codewords: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Rotations, and the codes of their blocks scaled so that every combination of codewords is a unit vector."""
    rng = np.random.default_rng([SEED, dimension, codewords])
    blocks = 2 if dimension >= 16 else 1
    out = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
        words = [rng.standard_normal((codewords, len(p))) for p in np.array_split(np.arange(dimension), blocks)]
        out.append((rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks) for w in words]))
    return out


def exceeded(units: np.ndarray, threshold: float, codewords: int) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all directions whose inner product reaches the threshold."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in units]
    for number, (rotation, codes) in enumerate(product_codes(units.shape[1], codewords)):
        turned = units @ rotation
        cut = codes[0].shape[1]
        left = turned[:, :cut] @ codes[0].T
        right = turned[:, cut:] @ codes[1].T if len(codes) > 1 else np.zeros((len(units), 1))
        some_left = left >= (threshold - right.max(axis=1))[:, None]
        some_right = right >= (threshold - left.max(axis=1))[:, None]
        base = number * codewords * right.shape[1]
        for i in np.flatnonzero(some_left.any(axis=1)):
            at_left, at_right = np.flatnonzero(some_left[i]), np.flatnonzero(some_right[i])
            a, b = np.nonzero(left[i, at_left][:, None] + right[i, at_right][None, :] >= threshold)
            found[i].append(base + at_left[a] * right.shape[1] + at_right[b])
    return [np.sort(np.concatenate(f)) for f in found]


@lru_cache(maxsize=16)
def threshold_for(dimension: int, codewords: int, cosine: float = COSINE) -> float:
    rng = np.random.default_rng([SEED, dimension, 1])
    a, b = rng.standard_normal((2, SAMPLE_PAIRS, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(b, axis=1, keepdims=True)
    b = np.where(size > 1e-9, cosine * a + np.sqrt(1 - cosine**2) * b / np.maximum(size, 1e-9), a)
    step = 0.04 / np.sqrt(max(dimension, 16))
    threshold = 1.0 if dimension < 16 else 4.8 / np.sqrt(dimension)
    while sum(not len(np.intersect1d(x, y)) for x, y in zip(exceeded(a, threshold, codewords), exceeded(b, threshold, codewords))) > SAMPLE_MISSES:
        threshold -= step
    return threshold


def codewords_for(vectors: int) -> int:
    """Codewords per block for a table of so many vectors, a power of two."""
    wanted = max(LEAST_CODEWORDS, CODEWORDS_PER_ROOT * int(vectors**0.5))
    return min(MOST_CODEWORDS, 1 << (wanted - 1).bit_length())


def _number_type(codewords: int) -> str:
    """The type in which filter numbers are kept."""
    return "<i4" if CODES * codewords**2 < 2**31 else "<i8"


def _filtered(batches: Iterator[pd.DataFrame], thresholds: dict[int, float], codewords: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = batch["embedding"].map(len)
        for n, own in batch.groupby(lengths):
            for s in range(0, len(own), 1000):
                part = own.iloc[s:s + 1000]
                x = np.array(part["embedding"].tolist(), np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"node": part["node"], "copies": part["copies"], "dimension": n, "unit": [u.tobytes() for u in x],
                                    "filters": [f.astype(_number_type(codewords)).tobytes() for f in exceeded(x, thresholds[n], codewords)]})


def _unpacked(batches: Iterator[pd.DataFrame], codewords: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        filters = [np.frombuffer(f, _number_type(codewords)) for f in batch["filters"]]
        sizes = [len(f) for f in filters]
        yield pd.DataFrame({"dimension": np.repeat(batch["dimension"].to_numpy(), sizes), "node": np.repeat(batch["node"].to_numpy(), sizes),
                            "filter": np.concatenate([*filters, np.zeros(0, np.int64)]).astype(np.int64)})


def _compared(part: pd.DataFrame, codewords: int) -> pd.DataFrame:
    """Links within the block pairs of one task: (node, links) sums and (node, root) edges."""
    part = part.sort_values(["dimension", "filter", "low", "high", "node"], kind="stable")
    keys = part[["dimension", "filter", "low", "high"]].to_numpy()
    borders = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    node, block, copies = (part[c].to_numpy() for c in ("node", "block", "copies"))
    units, filters = part["unit"].tolist(), part["filters"].tolist()
    nodes, sums, roots = [], [], []
    for s, e in zip(borders, [*borders[1:], len(part)]):
        if e - s < 2:
            continue
        x = np.frombuffer(b"".join(units[s:e])).reshape(e - s, -1)
        links = x @ x.T >= COSINE
        np.fill_diagonal(links, False)
        if keys[s, 2] != keys[s, 3]:
            links &= block[s:e, None] != block[None, s:e]
        linked = np.flatnonzero(links.any(axis=1))
        if not len(linked):
            continue
        # a pair with a lesser common filter counts there
        own = [np.frombuffer(filters[s + i], _number_type(codewords)) for i in linked]
        lesser = [f[f < keys[s, 1]] for f in own]
        values, where = np.unique(np.concatenate(lesser), return_inverse=True)
        table = np.zeros((len(linked), len(values)), np.float32)
        table[np.repeat(np.arange(len(linked)), [len(f) for f in lesser]), where] = 1
        some = links[np.ix_(linked, linked)] & (table @ table.T == 0)
        root = least_reachable(some)
        at = np.flatnonzero(some.any(axis=1))
        nodes.append(node[s + linked[at]])
        sums.append((some[at] * copies[s + linked][None, :]).sum(axis=1))
        roots.append(node[s + linked[root[at]]])
    join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    return pd.DataFrame({"node": join(nodes), "links": join(sums), "root": join(roots)})


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    good = rows.where(F.coalesce(usable, F.lit(False)))
    # 0.0 and -0.0 are the same component
    good = good.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    classes = materialise(good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
                          .withColumn("node", F.monotonically_increasing_id()), "cap-classes")
    lengths = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    codewords = codewords_for(classes.count())
    thresholds = {n: threshold_for(n, codewords) for n in lengths}
    filtered = materialise(classes.select("node", "copies", "embedding").mapInPandas(
        lambda b: _filtered(b, thresholds, codewords), "node long, copies long, dimension int, unit binary, filters binary"), "cap-filters")
    members = filtered.select("dimension", "node", "filters").mapInPandas(lambda b: _unpacked(b, codewords), "dimension int, node long, filter long")
    crowds = members.groupBy("dimension", "filter").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (members.join(crowds, ["dimension", "filter"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("dimension", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node"))
    dealt = materialise(dealt, "cap-members")
    tasks = dealt.count() // TASK_ROWS + 1
    compared = (dealt.join(filtered.drop("dimension"), "node")
                .withColumn("task", F.pmod(F.xxhash64("dimension", "filter", "low", "high"), F.lit(tasks)))
                .groupBy("task").applyInPandas(lambda part: _compared(part, codewords), "node long, links long, root long"))
    compared = materialise(compared, "cap-links")
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(compared.select("node", "root"))
    named = found.join(classes.select(F.col("node").alias("id"), "first"), "id")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = (classes.join(counts, "node", "left").join(found.withColumnRenamed("id", "node"), "node", "left").join(least, "component", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    linked = good.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

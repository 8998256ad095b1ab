"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Every passage of the whole text is encoded: measured, then sent through a small layer. Gated attention
weighs the encoded passages, and the weighted sum is scored by a logistic layer. Encoder, attention and score
are learned together from document labels.

Learning is bounded: it takes the measures of at most SAMPLE_DOCS labelled documents, those with the least hashes, to the driver.
Scoring is one pass over all documents without a shuffle, with nothing but the text as input.

Defined results: a null or empty text is a bag of one empty passage; labels other than 0 and 1 and those of documents held out are not
learned from; of several labels of a doc_id the least counts; without labels of both kinds every score is the share of label 1, or
0.5; a null doc_id is held out; rows that repeat a doc_id are scored each on their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import map_frames

PASSAGE_WORDS = 64
SAMPLE_DOCS = 4000
CUT = 0.3
HIDDEN, GATE = 16, 8
EPOCHS, BAGS_PER_STEP, RATE, DECAY = 30, 64, 0.01, 1e-4
MEASURES = 13

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:?'\"()-", "!", "\n")
_KIND = np.zeros((len(_GROUPS) + 2, 256), np.float32)
for _k, _chars in enumerate(_GROUPS):
    _KIND[_k, list(_chars.encode())] = 1
_KIND[-2, 128:] = 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_KIND[-1] = ~_BLANK
_POWERS = (np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(64, dtype=np.uint64) + np.uint64(1))) | np.uint64(1)


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(True))


def passage_measures(text: str | None) -> np.ndarray:
    """One row of measures per passage of the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    solid = ~_BLANK[raw]
    starts = np.flatnonzero(solid & np.r_[True, ~solid[:-1]]) if len(raw) else np.zeros(0, np.int64)
    n = len(starts)
    if not n:
        out = np.zeros((1, MEASURES), np.float32)
        out[0, -1] = 1
        return out
    begins = starts[::PASSAGE_WORDS]
    # bytes before the first word are blank
    kinds = np.stack([np.add.reduceat(row[raw], begins) for row in _KIND], axis=1)
    solid_bytes = np.maximum(kinds[:, -1:], 1)
    lengths = np.add.reduceat(solid.astype(np.int64), starts)
    word = np.cumsum(_marks(len(raw), starts)) - 1
    place = np.arange(len(raw)) - starts[np.maximum(word, 0)]
    hashes = np.add.reduceat(np.where(solid, (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0)), starts)
    triples = hashes.copy()
    triples[:-1] = triples[:-1] * np.uint64(31) + hashes[1:]
    triples[:-2] = triples[:-2] * np.uint64(1_000_003) + hashes[2:]
    counts = np.minimum(PASSAGE_WORDS, n - np.arange(len(begins)) * PASSAGE_WORDS)
    sums, squares = (np.add.reduceat(v, np.arange(0, n, PASSAGE_WORDS)) for v in (lengths, lengths**2))
    mean = sums / counts
    return np.column_stack([
        kinds[:, :-1] / solid_bytes, mean / 10, np.sqrt(np.maximum(squares / counts - mean**2, 0)) / 10,
        _distinct(hashes, counts) / counts, _distinct(triples, counts) / counts, np.log1p(counts) / 4, np.zeros(len(begins))]).astype(np.float32)


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    marks = np.zeros(n, np.int64)
    marks[at] = 1
    return marks


def _distinct(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values per passage."""
    passage = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, passage))
    v, p = values[order], passage[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (p[1:] != p[:-1])]
    return np.bincount(p[new], minlength=len(counts))


class BagModel:
    """Gated attention over encoded passages; weights are a dictionary of arrays."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.w = {"enc": draw(MEASURES, HIDDEN), "enc_b": np.zeros(HIDDEN), "att": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE),
                  "sum": draw(GATE), "out": draw(HIDDEN), "out_b": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(MEASURES), np.ones(MEASURES), None

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        """``x``: passages of all bags one after the other."""
        w, at = self.w, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bag = np.repeat(np.arange(len(sizes)), sizes)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(h @ w["att"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        raw = (v * u) @ w["sum"]
        e = np.exp(raw - np.maximum.reduceat(raw, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        logit = z @ w["out"] + w["out_b"][0]
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "at": at, "bag": bag, "p": 1 / (1 + np.exp(-logit))}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self.forward(x, sizes)
        d_logit = (f["p"] - y) / len(y)
        d_z = d_logit[:, None] * w["out"][None, :]
        spread = d_z[f["bag"]]
        d_a = (spread * f["h"]).sum(axis=1)
        d_raw = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, f["at"])[f["bag"]])
        d_vu = d_raw[:, None] * w["sum"][None, :]
        d_v, d_u = d_vu * f["u"] * (1 - f["v"] ** 2), d_vu * f["v"] * f["u"] * (1 - f["u"])
        d_h = f["a"][:, None] * spread + d_v @ w["att"].T + d_u @ w["gate"].T
        d_e = d_h * (1 - f["h"] ** 2)
        return {"enc": f["x"].T @ d_e, "enc_b": d_e.sum(axis=0), "att": f["h"].T @ d_v, "gate": f["h"].T @ d_u,
                "sum": ((f["v"] * f["u"]) * d_raw[:, None]).sum(axis=0), "out": f["z"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> BagModel:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(3)
        everything = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), BAGS_PER_STEP):
                own = [bags[i] for i in order[s:s + BAGS_PER_STEP]]
                grads = self.gradients(np.concatenate(own).astype(np.float64), np.array([len(b) for b in own]), labels[order[s:s + BAGS_PER_STEP]])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant if bags else 0.0)
        return self.forward(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]))["p"]


def learned(docs: DataFrame, labels: DataFrame) -> BagModel:
    """A model from at most SAMPLE_DOCS labelled documents that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), 0))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bag": [passage_measures(t).tobytes() for t in batch["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bags = texts.join(F.broadcast(sample), "doc_id").mapInPandas(measured, "doc_id long, quality int, bag binary")
    rows = bags.groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")).toPandas().sort_values("doc_id")  # one of the rows that repeat an id
    bags = [np.frombuffer(b, np.float32).reshape(-1, MEASURES) for b in rows["bag"]]
    return BagModel().fit(bags, rows["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: BagModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.iloc[s:s + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.scores([passage_measures(t) for t in part["text"]])})

    doc_id = F.col("doc_id").cast("long")
    slim = docs.select(doc_id.alias("doc_id"), held_out(doc_id, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = map_frames(slim, run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

"""Spelling variants: words one edit apart, found by blocked Gram matrices, lead to their more frequent form.

Words are cut into blocks by length and by how many of their letters fall into each of a few letter classes. One edit
moves a word to the block of the same length and classes, of one letter moved between two classes, or of one letter more or
less, so only such blocks meet. Two blocks are compared by the product of their letter-count matrices: squared distances of
letter counts are |a|^2 + |b|^2 - 2ab, and words one edit apart have at most 2. The pairs that pass are verified on their
code points. Blocks are dealt into parts of bounded size, and a task answers with counts and the best near word per word,
never with pairs.

Defined results: a null or empty text has no words; a null identifier counts as an empty identifier; repeated rows count
each; words of any length take part, one to a part if need be; ties of the largest count go to the smallest word in code-point
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import lower_ascii, materialise

#: The letters of a word once A-Z are in lower case.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile(f"[{LETTERS}]+")
#: Distinct words a counting task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Letter classes; a letter belongs to the class of its place among the letters.
CLASSES = 6
#: Words, and code points, of one part of a block.
PART_WORDS = 2048
PART_CHARS = 2_000_000
#: Cells of one Gram matrix, and code points compared at once.
CELLS = 4_000_000

NEAR = "word string, n_near long, best_n long, best string"


def garbled(prefix: int, run: str, modulus: int) -> str:
    """The run, without one code point if the checksum of identifier and run is a multiple of the modulus."""
    check = zlib.crc32(run.encode(), prefix)
    if check % modulus:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, modulus: int | None = None, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``least_length`` code points that occur ``least_count`` times.

    With a ``modulus``, runs whose checksum it divides lose one code point, always the same one in a document.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter(RUN.findall(lower_ascii(text.as_py() or "")))
                if modulus:
                    prefix, plain, own = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode()), own, Counter()
                    for run, n in plain.items():
                        own[garbled(prefix, run, modulus)] += n
                for word, n in own.items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    runs = docs.select("doc_id", "text").where("text is not null").mapInArrow(counted, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _class_counts(word: Column) -> Column:
    """How many letters of the word fall into each class."""
    return F.array(*(F.length(word) - F.length(F.translate(word, LETTERS[k::CLASSES], "")) for k in range(CLASSES)))


def _steps() -> list[list[int]]:
    """What one edit adds to the class counts, each pair of blocks once: nothing, one letter, or one moved to a later class."""
    unit = np.eye(CLASSES, dtype=int)
    moved = [unit[j] - unit[i] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return [s.tolist() for s in [unit[0] * 0, *unit, *moved]]


def _meetings(words: DataFrame) -> DataFrame:
    """Words dealt to the groups that compare one part of a block with parts of it and its neighbours.

    A group (block, part, other) holds the words of that part (``own``), and of the parts numbered ``other`` of the block
    itself and of all its later neighbours.
    """
    placed = words.withColumn("block", _class_counts(F.col("word"))).withColumn("length", F.length("word"))
    parts = F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(F.lit(PART_CHARS) / F.max("length")))))
    blocks = materialise(placed.groupBy("block").agg(parts.cast("int").alias("parts")), "letter-blocks")
    step = F.explode(F.array(*(F.array(*(F.lit(int(x)) for x in s)) for s in _steps())))
    # each block as a right side: which left sides it meets
    left = blocks.select(F.col("block").alias("left"), F.col("parts").alias("left_parts"), step.alias("step")).select(
        "left", "left_parts", F.zip_with("left", "step", lambda a, b: a + b).alias("block"))
    met = left.join(blocks, "block")
    rights = met.groupBy("block").agg(F.collect_list(F.struct("left", "left_parts")).alias("lefts"), F.max("parts").alias("parts"))
    widths = met.groupBy(F.col("left").alias("block")).agg(F.max("parts").alias("others"))
    plan = materialise(rights.join(widths, "block"), "letter-meetings")
    dealt = placed.join(plan, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    own = dealt.select("block", "part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(True).alias("own"),
                       F.lit(True).alias("same"), "word", "n")
    met_by = dealt.select(F.explode("lefts").alias("at"), F.col("part").alias("other"), "word", "n", "block").select(
        F.col("at.left").alias("left"), F.explode(F.sequence(F.lit(0), F.col("at.left_parts") - 1)).alias("part"), "other", F.lit(False).alias("own"),
        (F.col("at.left") == F.col("block")).alias("same"), "word", "n")
    return own.unionByName(met_by.withColumnRenamed("left", "block"))


_PLACE = np.full(0x100, -1)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


class _Words:
    """Words of one length as code points and letter counts."""

    def __init__(self, words: list[str], at: np.ndarray):
        self.at, self.length = at, len(words[0])
        self.codes = np.array(words, dtype=f"U{self.length}").view(np.uint32).reshape(len(words), self.length)
        # products of counts are whole numbers, exact in single precision for all but very long words
        self.counts = np.zeros((len(words), len(LETTERS)), dtype=np.float32 if self.length < 4096 else np.float64)
        rows = np.arange(len(words))
        for column in _PLACE[self.codes].T:
            self.counts[rows, column] += 1
        self.norms = (self.counts**2).sum(axis=1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two code matrices differ by one replaced code point, or by one more in b."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    width = a.shape[1]
    ahead = np.cumprod(a == b[:, :width], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= width


def _near_pairs(left: _Words, right: _Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs one edit apart, some at a time."""
    wide = max(1, CELLS // max(1, len(left.at)))
    once = max(1, CELLS // right.length)
    for start in range(0, len(right.at), wide):
        counts, norms = right.counts[start:start + wide], right.norms[start:start + wide]
        gram = left.counts.astype(counts.dtype, copy=False) @ counts.T
        gram *= -2
        gram += norms
        gram += left.norms[:, None]
        a, b = np.nonzero(gram <= 2)
        for k in range(0, len(a), once):
            x, y = a[k:k + once], b[k:k + once] + start
            sure = one_edit(left.codes[x], right.codes[y])
            yield left.at[x[sure]], right.at[y[sure]]


def _compared(table: pa.Table) -> pa.Table:
    """One group: for each word how many near words it meets here, and the most frequent of them."""
    words, n = table.column("word").to_pylist(), np.asarray(table.column("n"))
    own, same = (np.asarray(table.column(c)) for c in ("own", "same"))
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    left_at = np.flatnonzero(own)
    near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words))
    if len(left_at):
        left = _Words([words[i] for i in left_at], left_at)
        lengths = np.array([len(w) for w in words])
        for length in (left.length, left.length + 1):
            right_at = np.flatnonzero(~own & (lengths == length))
            if not len(right_at):
                continue
            for a, b in _near_pairs(left, _Words([words[i] for i in right_at], right_at)):
                once = [not same[j] or words[i] < words[j] for i, j in zip(a, b, strict=True)]  # a block meets itself from both sides
                a, b = a[once], b[once]
                for x, y in ((a, b), (b, a)):
                    near += np.bincount(x, minlength=len(words))
                    np.minimum.at(best, x, rank[y])
    found = np.flatnonzero(near)
    first = order[best[found]]
    return pa.table({"word": pa.array([words[i] for i in found], pa.string()), "n_near": pa.array(near[found], pa.int64()),
                     "best_n": pa.array(n[first], pa.int64()), "best": pa.array([words[i] for i in first], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) that has a word one edit away; words are distinct."""
    met = _meetings(words).groupBy("block", "part", "other").applyInArrow(_compared, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of (word, form): the last word reached by following forms. Forms have no cycles."""
    current = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # twice the distance a round
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                            "spelling-roots")
        current = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return current


def spelling_forms(docs: DataFrame, modulus: int | None = None, factor: int = 5, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """Every word with its count, near words, more frequent form (at least ``factor`` times as frequent) and last form."""
    words = materialise(word_counts(docs, modulus, least_length, least_count), "spelling-words")
    formed = words.join(near_words(words), "word", "left")
    leads = F.col("best_n") >= factor * F.col("n")
    formed = materialise(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best")).alias("form"),
                                       F.when(leads, F.col("best_n")).alias("form_n")), "spelling-forms")
    rooted = formed.join(roots(formed.where("form is not null").select("word", "form")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

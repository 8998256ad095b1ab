"""Document log-likelihood under a gated recurrent language model with class-factored output.

Counting. Words of all training documents are counted in Spark; the table grows with the corpus and is never gathered. The head, a bounded
number of most frequent words, and a bounded dictionary of further frequent words with their counts go to every task.

Model. The recurrent model predicts symbols: the head words, the end of a text, and one symbol for each shape of the
remaining words (ending, letters, length). A symbol's probability is that of its class times that within the class; classes hold
about equal shares of the text. A word that is not in the head has the probability of its shape symbol times its smoothed share among the words of that
shape, where unseen words share the place of one. So the model is a proper distribution over words.

Training. Every training text is cut into consecutive windows of several segments, each of which is trained on; gradients stop at segment borders while the state is
carried through the window. The windows are dealt by row to tasks that train from common weights; the mean of their weights, weighed by windows, starts the
next round. Small corpora make more passes, up to a fixed number of segments.

Scoring. Texts are encoded once, for training and scoring. Tasks run many documents in step, segment by segment, the state carried to the end of each. Words outside the dictionary meet
the count table in a join on the word; they are rare, so no key is hot among counted words, and the planner splits unseen ones.

Defined results: a null text is empty and has its end token only; a null doc_id is held out; rows that repeat a doc_id
are scored each on their own; without training documents all counts are 0 and the model is its smoothed start; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliowire.llm.bagclassifier import held_out
from foliowire.llm.common import lower_ascii, map_frames, materialise, split_words

#: Words predicted one by one; frequent words whose counts every task knows; classes of the output.
HEAD, DICTIONARY, CLASSES = 1024, 1 << 17, 32
HIDDEN = 24
#: Tokens of a segment, and segments of a training window.
SEGMENT, SEGMENTS = 32, 16
ROUNDS, BATCH, RATE = 2, 256, 0.008
#: Windows that one task trains on in a round, and segments a training makes at least by repetition.
TASK_WINDOWS, LEAST_SEGMENTS = 8192, 32768
#: Distinct words a counting task holds, tokens a scoring task runs together.
HELD_WORDS, HELD_TOKENS = 400_000, 6_000_000
#: Bytes of text, and one text more, that a task counts or encodes together.
COUNTED_BYTES, ENCODED_BYTES = 1 << 25, 1 << 23
#: Documents that a scoring task runs side by side.
LEAST_LANES, MOST_LANES = 64, 512
#: Predictions computed together.
BLOCK = 8192
#: Weights that one row carries when weights are averaged.
CHUNK = 8192
END = ""  # no word is empty
#: Symbols as they are stored.
SYMBOL = np.dtype("<i2")


def shape_of(word: str) -> int:
    """The shape symbol of a word: ending, kind of letters, length."""
    if word.isalnum():
        return (0 if word.isascii() else 3) + (0 if len(word) <= 5 else 1 if len(word) <= 9 else 2)
    last = word[-1]
    ending = 0 if last.isalnum() else {".": 1, ",": 2, "!": 3}.get(last, 4)
    kind = 0 if word.isascii() else 1
    marked = 2 if any(c in "#*$%&|<>@=/_" for c in word) else 0
    length = 0 if len(word) <= 5 else 1 if len(word) <= 9 else 2
    return (ending * 4 + kind + marked) * 3 + length


SHAPES = 60
#: Of each byte: whether it marks a word (1) or is not ASCII (2); and the ending of a word whose last byte it is.
_BYTES = np.array([(chr(k) in "#*$%&|<>@=/_") + 2 * (k > 127) for k in range(256)], np.uint8)
_ENDINGS = np.array([0 if chr(k).isalnum() else {".": 1, ",": 2, "!": 3}.get(chr(k), 4) for k in range(256)])


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape_of`` for all words at once; words beyond ASCII one by one."""
    if not len(words):
        return np.zeros(0, np.int64)
    flat = words.cast(pa.large_binary())
    borders = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    letters = np.frombuffer(flat.buffers()[2], np.uint8)
    found = np.bitwise_or.reduceat(_BYTES[letters[:borders[-1]]], borders[:-1])
    lengths = np.diff(borders)
    out = (_ENDINGS[letters[borders[1:] - 1]] * 4 + 2 * (found & 1)) * 3 + (lengths > 5) + (lengths > 9)
    other = found > 1
    if other.any():
        out[other] = list(map(shape_of, words.filter(pa.array(other)).to_pylist()))
    return out


def words_of(text: str | None) -> list[str]:
    return split_words(lower_ascii(text)) if text else []


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` for all texts, one behind the other, and the borders between texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    borders = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():  # nothing stands before a leading or behind a closing blank
        words, borders = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[borders]
    return words, borders


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about ``most`` bytes of text; what is made of a text's words takes several times its memory."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = 1 + int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0)))
            yield batch.slice(begin, end - begin)
            begin = end


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The sums between neighbouring borders, 0 where nothing lies between them."""
    out, some = np.zeros(len(borders) - 1, values.dtype), np.flatnonzero(np.diff(borders))
    if len(some):
        out[some] = np.add.reduceat(values, borders[some])
    return out


def word_counts(training: DataFrame) -> DataFrame:
    """(word, shape, c) of all training tokens, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def merged() -> pa.Table:
            table = pa.concat_tables(held)
            return table.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]) if len(held) > 1 else table

        def flushed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [batch["word"].cast(pa.string()), pa.array(shapes_of(batch["word"]), pa.int32()), batch["n"]], ["word", "shape", "n"])

        for batch in _pieces(batches, COUNTED_BYTES):
            words, counts = pc.value_counts(words_in(batch.column("text"))[0]).flatten()
            held.append(pa.table({"word": words, "n": counts}))
            size, texts = size + len(words), texts + batch.num_rows
            if size > HELD_WORDS:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD_WORDS:
                    yield from flushed(held[0])
                    held, size = [], 0
        if held:
            yield from flushed(merged())
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([texts], pa.int64())], ["word", "shape", "n"])

    partial = training.select("text").mapInArrow(run, "word string, shape int, n long")
    return partial.groupBy("word", "shape").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Symbols, their classes, and log10 constants of words; bounded by DICTIONARY."""

    def __init__(self, frequent: pd.DataFrame, shapes: pd.DataFrame, tokens: int, distinct: int):
        """``frequent``: the most frequent words with shape and c, in order; ``shapes``: shape, words n and tokens c over all words but the end."""
        self.tokens, self.distinct = tokens, distinct
        self.log_all = float(np.log10(tokens + 0.5 * (distinct + 1)))
        head = frequent[frequent["word"] != END].head(HEAD)
        ends = int(frequent.loc[frequent["word"] == END, "c"].sum())
        tail_words, tail_tokens = np.zeros(SHAPES), np.zeros(SHAPES)
        tail_words[shapes["shape"]] = shapes["n"]
        tail_tokens[shapes["shape"]] = shapes["c"]
        np.subtract.at(tail_words, head["shape"].to_numpy(int), 1)
        np.subtract.at(tail_tokens, head["shape"].to_numpy(int), head["c"].to_numpy(float))
        #: log10 of what divides c + 0.5 of a tail word of a shape.
        self.log_shape = np.log10(tail_tokens + 0.5 * (tail_words + 1))
        # symbol 0 is the end, then the shapes, then the head
        self.symbols = 1 + SHAPES + len(head)
        self.frequency = np.concatenate([[ends], tail_tokens, head["c"].to_numpy(float)]) + 0.5
        symbol = {w: 1 + SHAPES + k for k, w in enumerate(head["word"])}
        # of the dictionary's words: symbol, log10(c + 0.5), log10 of the share within the symbol
        self.number = {w: k for k, w in enumerate(frequent["word"])}
        shape, self.log_count = frequent["shape"].to_numpy(int), np.log10(frequent["c"].to_numpy(float) + 0.5)
        own = np.array([0 if w == END else symbol.get(w, -1) for w in frequent["word"]], np.int64)
        self.symbol = np.where(own < 0, 1 + shape, own)
        self.log_share = np.where(own < 0, self.log_count - self.log_shape[shape], 0.0)
        order = np.argsort(-self.frequency, kind="stable")
        share = np.cumsum(self.frequency[order]) / self.frequency.sum()
        by_rank = np.minimum(((share - self.frequency[order] / self.frequency.sum() / 2) * CLASSES).astype(int), CLASSES - 1)
        self.class_of = np.empty(self.symbols, np.int64)
        self.class_of[order] = np.unique(by_rank, return_inverse=True)[1]
        self.members = [np.flatnonzero(self.class_of == c) for c in range(self.class_of.max() + 1)]
        self.within = np.empty(self.symbols, np.int64)
        for m in self.members:
            self.within[m] = np.arange(len(m))


def _softmax(x: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The softmax of each column, in place, and the logarithm of its value at the target.

    Values stand in columns because reductions and broadcasts then run along the long side.
    """
    x -= x.max(axis=0)
    own = x[targets, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return x, own - np.log(total)


def _by_gate(x: np.ndarray) -> np.ndarray:
    """The columns of the three gates one behind the other, so that work on a gate runs over one piece of memory."""
    return np.stack(np.split(x, 3, axis=1))


class Network:
    """Gated recurrent units; the input table holds what each symbol adds to the three gates."""

    def __init__(self, vocabulary: Vocabulary):
        rng = np.random.default_rng(17)
        self.v = vocabulary
        h, f = HIDDEN, vocabulary.frequency
        in_class = np.array([f[m].sum() for m in vocabulary.members])
        self.w = {
            "input": 0.1 * rng.standard_normal((vocabulary.symbols, 3 * h)), "state": rng.standard_normal((h, 3 * h)) / np.sqrt(h),
            "bias": np.zeros(3 * h), "class": 0.1 * rng.standard_normal((h, len(in_class))), "class_b": np.log(in_class / in_class.sum()),
            "word": 0.1 * rng.standard_normal((vocabulary.symbols, h)), "word_b": np.log(f)}
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}
        self.room: dict[str, np.ndarray] = {}
        #: What ``scaled`` gives, while the weights stay as they are and no gradient is asked for.
        self.fixed: tuple[np.ndarray, np.ndarray] | None = None

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write into; its memory is used again, as fresh pages cost more than the work on them."""
        kind, size = self.w["state"].dtype, int(np.prod(shape))
        if name not in self.room or self.room[name].size < size or self.room[name].dtype != kind:
            self.room[name] = np.empty(size, kind)
        return self.room[name][:size].reshape(shape)

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.w.items():
            self.w[k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """By gate, the input table with the bias and the state's weights; halved for the first two, as a sigmoid is a tanh of half its input."""
        table, weights = self._room("table", 3, self.v.symbols, HIDDEN), _by_gate(self.w["state"])
        for gate, added, bias in zip(table, np.split(self.w["input"], 3, axis=1), np.split(self.w["bias"], 3)):
            np.add(added, bias, out=gate)
        table[:2] *= 0.5
        weights[:2] *= 0.5
        return table, weights

    @staticmethod
    def advance(added: np.ndarray, s: np.ndarray, h: np.ndarray, gates: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """One step from states ``h`` into ``gates``, ``c`` and ``out``; by gate, ``added`` is what the symbols add and ``s`` what the states do."""
        np.add(added[:2], s[:2], out=gates)
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[1], s[2], out=c)
        c += added[2]
        np.tanh(c, out=c)
        np.subtract(h, c, out=out)
        out *= gates[0]
        out += c

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """The next state after symbols ``x``, with what the gradient needs."""
        table, weights = self.scaled()
        s, gates, c, out = np.matmul(h, weights), np.empty((2, *h.shape), h.dtype), np.empty_like(h), np.empty_like(h)
        self.advance(table[:, x], s, h, gates, c, out)
        return out, (h, *gates, c, s[2])

    def run(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before and after every step over symbols ``x`` (steps by lanes), and what the gradient needs; in memory that is used again.

        With fixed weights only the last step's part of what the gradient needs is kept.
        """
        n, (steps, width), (table, weights) = HIDDEN, x.shape, self.fixed or self.scaled()
        inputs = np.take(table, x, axis=1, out=self._room("inputs", 3, steps, width, n), mode="clip")
        states, s = self._room("states", steps + 1, width, n), self._room("s", 3, width, n)
        kept = self._room("kept", 4, 1 if self.fixed else steps, width, n)
        states[0] = h
        for t in range(steps):
            k = 0 if self.fixed else t
            np.matmul(states[t], weights, out=s)
            if not self.fixed:
                kept[3, t] = s[2]
            self.advance(inputs[:, t], s, states[t], kept[:2, k], kept[2, k], states[t + 1])
        return states, kept

    def _by_class(self, h: np.ndarray, y: np.ndarray) -> tuple:
        """Rows in the order of their classes: the order, states, classes, places within classes, and (class, members, rows) of classes of several words."""
        classes = self.v.class_of[y]
        order = np.argsort(classes.astype(SYMBOL), kind="stable")
        y, classes = y[order], classes[order]
        borders = np.searchsorted(classes, np.arange(len(self.v.members) + 1))
        parts = [(c, m, slice(borders[c], borders[c + 1])) for c, m in enumerate(self.v.members) if borders[c] < borders[c + 1] and len(m) > 1]
        return order, np.take(h, order, axis=0, out=self._room("sorted", *h.shape), mode="clip"), classes, self.v.within[y], parts

    def _values(self, name: str, weights: np.ndarray, states: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """What is put into a softmax, in columns, in memory that is used again."""
        x = np.matmul(weights, states.T, out=self._room(name, len(weights), len(states)))
        x += bias[:, None]
        return x

    def log_probabilities(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of symbols ``y`` in states ``h``."""
        out = np.empty(len(y), h.dtype)
        for s in range(0, len(y), BLOCK):
            order, states, classes, within, parts = self._by_class(h[s:s + BLOCK], y[s:s + BLOCK])
            logs = _softmax(self._values("p", self.w["class"].T, states, self.w["class_b"]), classes)[1]
            for _, m, at in parts:
                logs[at] += _softmax(self._values("q", self.w["word"][m], states[at], self.w["word_b"][m]), within[at])[1]
            out[s + order] = logs
        return out

    def segment_gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over one segment (arrays of steps by documents) and the state after it."""
        n, (steps, width) = HIDDEN, x.shape
        kind = self.w["state"].dtype
        states, (z, r, c, sn) = self.run(x, h)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        order, flat, classes, within, parts = self._by_class(states[1:].reshape(-1, n), y.ravel())
        weight = (valid.ravel()[order] / max(valid.sum(), 1)).astype(kind)
        p = _softmax(self._values("p", self.w["class"].T, flat, self.w["class_b"]), classes)[0]
        p[classes, np.arange(len(classes))] -= 1
        p *= weight
        g["class"], g["class_b"] = flat.T @ p.T, p.sum(axis=1)
        by_class = np.matmul(p.T, self.w["class"].T, out=self._room("by_class", *flat.shape))
        for _, m, at in parts:
            words, own = self.w["word"][m], within[at]
            q = _softmax(self._values("q", words, flat[at], self.w["word_b"][m]), own)[0]
            q[own, np.arange(len(own))] -= 1
            q *= weight[at]
            g["word"][m], g["word_b"][m] = q @ flat[at], q.sum(axis=1)
            by_class[at] += q.T @ words
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        d = np.take(by_class, back, axis=0, out=self._room("d", steps * width, n), mode="clip").reshape(steps, width, n)
        # what a change of the state is worth for the three gates, seen from the state before
        before, ds, factors = states[:-1], self._room("inputs", 3, steps, width, n), self._room("factors", 3, steps, width, n)  # the inputs are not needed any more
        part, to_c, left = self._room("s", 3, width, n), self._room("to_c", steps, width, n), self._room("left", steps, width, n)
        np.subtract(1, z, out=left)
        np.subtract(before, c, out=factors[0])
        factors[0] *= z
        factors[0] *= left
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= left
        np.multiply(to_c, r, out=factors[2])
        np.subtract(1, r, out=left)
        np.multiply(factors[2], sn, out=factors[1])
        factors[1] *= left
        back = np.ascontiguousarray(_by_gate(self.w["state"]).transpose(0, 2, 1))
        for t in reversed(range(steps)):
            np.multiply(d[t], factors[:, t], out=ds[:, t])
            if t:
                np.matmul(ds[:, t], back, out=part)
                earlier = d[t] * z[t]
                for gate in part:
                    earlier += gate
                d[t - 1] += earlier
        g["state"] = np.concatenate([before.reshape(-1, n).T @ gate.reshape(-1, n) for gate in ds], axis=1)
        np.multiply(d, to_c, out=ds[2])
        order = np.argsort(x.ravel().astype(SYMBOL), kind="stable")  # short numbers are sorted by radix
        symbols = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        added = self._room("factors", 3, len(order), n)  # nor are the factors
        for own, gate in zip(added, ds):
            np.take(gate.reshape(-1, n), order, axis=0, out=own, mode="clip")
        added = np.concatenate(list(np.add.reduceat(added, first, axis=1)), axis=1)
        g["input"][symbols[first]], g["bias"] = added, added.sum(axis=0)
        return g, states[-1].copy()

    def train(self, windows: list[np.ndarray], passes: int) -> None:
        """``windows``: symbols of consecutive tokens, the first of which is only read.

        Windows run side by side in BATCH lanes; where one ends, the next begins with an empty state, also from one pass
        to the next, so that lanes stay full.
        """
        rng = np.random.default_rng(23)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        segments, begins, counts, opens = _segments(windows)
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])
        h = np.zeros((BATCH, HIDDEN), np.float32)
        for at in _lanes(order, begins, counts, BATCH):
            h = np.where(opens[at, None], np.float32(0), h[:len(at)])
            rows = segments[at].T.astype(np.int64)
            x, y = rows[:-1], rows[1:]
            g, h = self.segment_gradients(np.maximum(x, 0), np.maximum(y, 0), y >= 0, h)
            step += 1
            size = float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))
            shorter, rate = min(1.0, 1.0 / (size + 1e-9)), RATE / (1 - 0.9**step)
            for k, v in g.items():
                v *= 0.1 * shorter
                first[k] *= 0.9
                first[k] += v
                np.multiply(v, v, out=v)
                second[k] *= 0.99
                second[k] += v  # (0.1 v)^2 is 0.01 v^2
                np.divide(second[k], 1 - 0.99**step, out=v)
                np.sqrt(v, out=v)
                v += 1e-8
                np.divide(first[k], v, out=v)
                v *= rate
                self.w[k] -= v


def _segments(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SEGMENT + 1 symbols, -1 beyond the end of a sequence, neighbours sharing a symbol; where each begins, its number of rows, and which rows are first."""
    lengths = np.array([len(w) for w in sequences])
    counts = -(-(lengths - 1) // SEGMENT)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(sequences)), counts)
    before = (np.arange(len(owner)) - (ends - counts)[owner]) * SEGMENT  # symbols of the sequence before the row
    symbols = np.concatenate([*sequences, np.zeros(SEGMENT, sequences[0].dtype)])
    segments = np.lib.stride_tricks.sliding_window_view(symbols, SEGMENT + 1)[(np.cumsum(lengths) - lengths)[owner] + before]
    segments[np.arange(SEGMENT + 1) >= (lengths[owner] - before)[:, None]] = -1
    opens = np.zeros(len(segments), bool)
    opens[(ends - counts)[counts > 0]] = True
    return segments, ends - counts, counts, opens


def _lanes(order: np.ndarray, begins: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The segments that are read together, step by step: sequences are laid into ``width`` lanes, the longest lanes stand first."""
    lanes, heap = [[] for _ in range(width)], [(0, k) for k in range(width)]
    for i in order:
        n, k = heap[0]
        heapq.heapreplace(heap, (n + int(counts[i]), k))
        lanes[k].append(np.arange(begins[i], begins[i] + counts[i]))
    full = sorted((np.concatenate(lane) for lane in lanes if lane), key=len, reverse=True)
    lengths = np.array([len(lane) for lane in full])
    table = np.zeros((len(full), lengths[0]), np.int64)
    for row, lane in zip(table, full):
        row[:len(lane)] = lane
    for t in range(lengths[0]):
        yield table[:np.searchsorted(-lengths, -t, side="left"), t]


def _windows(encoded: DataFrame) -> DataFrame:
    """All training windows: texts cut into pieces of SEGMENTS segments that follow each other, each with the symbol before it."""
    width = SEGMENT * SEGMENTS
    last = F.floor((F.col("n_tokens") - 1) / width).cast("int")
    pieces = encoded.where(~F.col("held_out")).select("row", "symbols", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    begin = F.col("piece") * (width * SYMBOL.itemsize) + 1
    return pieces.select("row", "piece", F.substring("symbols", begin, F.lit((width + 1) * SYMBOL.itemsize)).alias("window"))


def _dealt(windows: DataFrame, tasks: int) -> DataFrame:
    """The windows with their turn, given by the place of the window and not by its text: copies are spread evenly."""
    turn = F.pmod(F.xxhash64("row", "piece"), F.lit(ROUNDS * tasks)).cast("int")
    return windows.select("window", turn.alias("turn"))


def _training_from(start: np.ndarray, vocabulary: Vocabulary, passes: int):
    """The work of one task in a round: train from the common weights, return them in chunks."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = Network(vocabulary).unpack(start)
        own.train([np.frombuffer(w, SYMBOL) for w in sorted(part["window"])], passes)
        flat = own.packed()
        return pd.DataFrame([(c, len(part), flat[s:s + CHUNK].tobytes()) for c, s in enumerate(range(0, len(flat), CHUNK))],
                            columns=["chunk", "n", "part"])

    return run


def trained(encoded: DataFrame, vocabulary: Vocabulary) -> Network:
    """Weights averaged over tasks after each round."""
    network = Network(vocabulary)
    windows = _windows(encoded)
    size = SEGMENT * SYMBOL.itemsize
    n, segments = windows.agg(F.count("*"), F.sum(F.ceil((F.length("window") - SYMBOL.itemsize) / size))).first()
    if not n:
        return network
    tasks = max(1, round(n / ROUNDS / TASK_WINDOWS))
    passes = max(1, round(LEAST_SEGMENTS / segments))
    dealt = _dealt(windows, tasks)

    def mean(parts: pd.DataFrame) -> pd.DataFrame:
        stacked = np.array([np.frombuffer(p, np.float32) for p in parts["part"]], np.float64)
        return pd.DataFrame({"chunk": parts["chunk"][:1], "part": [np.average(stacked, axis=0, weights=parts["n"]).astype(np.float32).tobytes()]})

    for k in range(ROUNDS):
        run = _training_from(network.packed(), vocabulary, passes)
        models = dealt.where(F.col("turn") % ROUNDS == k).groupBy("turn").applyInPandas(run, "chunk int, n long, part binary")
        averaged = models.groupBy("chunk").applyInPandas(mean, "chunk int, part binary").toPandas().sort_values("chunk")
        if len(averaged):
            network.unpack(np.frombuffer(b"".join(averaged["part"]), np.float32))
    return network


def run_documents(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of symbols; the state is carried through the whole sequence.

    Sequences run one behind the other in lanes, as many as keep all lanes busy beside the longest sequence.
    """
    total = np.zeros(len(documents))
    if not sum(map(len, documents)):
        return total
    segments, begins, counts, opens = _segments([np.concatenate([np.zeros(1, d.dtype), d]) for d in documents])  # every text follows an end
    owner = np.repeat(np.arange(len(documents)), counts)
    lanes = int(np.clip(-(-len(segments) // counts.max()), LEAST_LANES, MOST_LANES))
    h = np.zeros((lanes, HIDDEN), np.float32)
    network.fixed = network.scaled()
    for at in _lanes(np.argsort(-counts, kind="stable"), begins, counts, lanes):
        h = np.where(opens[at, None], np.float32(0), h[:len(at)])
        rows = segments[at].T.astype(np.int64)
        states = network.run(np.maximum(rows[:-1], 0), h)[0]
        h, y = states[-1], rows[1:]
        logs = network.log_probabilities(states[1:].reshape(-1, HIDDEN), np.maximum(y, 0).ravel())
        total[owner[at]] += np.where(y >= 0, logs.reshape(y.shape), 0).sum(axis=0)
    network.fixed = None
    return total / np.log(10)


def _encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document its symbols behind an end, counts, log10 sums without the network, and the words outside the dictionary."""
    schema = StructType.fromDDL(
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, rare array<string>, symbols binary")
    written = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, end = pa.array(list(vocabulary.number), pa.string()), vocabulary.number.get(END)
        # an end whose count is unknown although no text was counted
        end_base, end_inner = (np.log10(0.5), 0.0) if end is None else (vocabulary.log_count[end], vocabulary.log_share[end])
        for batch in _pieces(batches, ENCODED_BYTES):
            words, borders = words_in(batch.column("text"))
            at = pc.fill_null(pc.index_in(words, dictionary.cast(words.type)), -1).to_numpy(zero_copy_only=False)
            known = at >= 0
            unknown, at = pa.array(~known), at[known]
            rare = words.filter(unknown)
            shapes = shapes_of(rare)
            symbol, base, inner = np.empty(len(words), SYMBOL), np.zeros(len(words)), np.empty(len(words))
            symbol[known], symbol[~known] = vocabulary.symbol[at], 1 + shapes
            base[known] = vocabulary.log_count[at]
            inner[known], inner[~known] = vocabulary.log_share[at], -vocabulary.log_shape[shapes]
            # every text follows an end and has its own
            n, places = np.diff(borders) + 1, 2 * np.arange(batch.num_rows + 1)
            symbols = np.zeros(len(words) + places[-1], SYMBOL)
            symbols[np.arange(len(words)) + np.repeat(places[:-1] + 1, n - 1)] = symbol
            rare_borders = np.concatenate([[0], np.cumsum(~known)])[borders]
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(_sums(known.astype(np.int64), borders) + (end is not None)),
                pa.array(_sums(base, borders) + end_base - n * vocabulary.log_all), pa.array(_sums(inner, borders) + end_inner),
                pa.ListArray.from_arrays(pa.array(rare_borders, pa.int32()), rare),
                pa.BinaryArray.from_buffers(
                    pa.binary(), batch.num_rows, [None, pa.py_buffer(((borders + places) * SYMBOL.itemsize).astype(np.int32)), pa.py_buffer(symbols)])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, written)], schema=written)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _scored(encoded: DataFrame, network: Network) -> DataFrame:
    """The encoded documents without symbols and words, and what the network gives."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "row"]

    def run(batches):
        held, symbols, size = [], [], 0

        def flushed():
            scored = pd.concat(held).assign(score=run_documents(network, symbols))
            return scored.assign(score=scored["score"] + scored["inner"]).drop(columns="inner")

        for batch in batches:
            # rows are dealt out so that no more than HELD_TOKENS and one text run together
            begin = 0
            for k, own in enumerate(batch["symbols"]):
                symbols.append(np.frombuffer(own, SYMBOL)[1:])
                size += len(symbols[-1])
                if size >= HELD_TOKENS:
                    held.append(batch[columns][begin:k + 1])
                    yield flushed()
                    held, symbols, size, begin = [], [], 0, k + 1
            held.append(batch[columns][begin:])
        if symbols:
            yield flushed()

    return map_frames(
        encoded.select(*columns, "symbols"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, row long, score double")


def _frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most DICTIONARY, and the end.

    A histogram of counts over a logarithmic grid of a few hundred cells gives the least count that is taken, so no
    task sorts or gathers the word table.
    """
    cell = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(((r["cell"], r["n"]) for r in counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in histogram:
        if taken + n > DICTIONARY:
            break
        taken, least = taken + n, at
    chosen = F.lit(False) if least is None else cell >= least
    return counts.where(chosen | (F.col("word") == END))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``."""
    doc_id = F.col("doc_id").cast("long")
    slim = docs.select(doc_id.alias("doc_id"), held_out(doc_id, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = slim.where(~F.col("held_out"))
    counts = materialise(word_counts(training), "recurrent-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = _frequent(counts).toPandas().sort_values(["c", "word"], ascending=[False, True])
    shapes = counts.where(F.col("word") != END).groupBy("shape").agg(F.count("*").alias("n"), F.sum("c").alias("c")).toPandas()
    vocabulary = Vocabulary(frequent, shapes, int(totals[0]), int(totals[1]))
    encoded = materialise(_encoded(slim, vocabulary), "recurrent-symbols")
    return _with_rare(_scored(encoded, trained(encoded, vocabulary)), encoded, counts, vocabulary)


def _with_rare(scored: DataFrame, encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add the words outside the dictionary by a join with the count table."""
    words = encoded.select("row", F.explode("rare").alias("word"))
    found = words.join(counts.select("word", "c"), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("c").alias("counted"))
    logs, counted = F.coalesce("logs", F.lit(0.0)), F.coalesce("counted", F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + counted).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))

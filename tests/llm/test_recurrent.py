import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose

from foliowire.llm import recurrent


def corpus():
    rows = [(k, f"{prose(k, 40 + k % 60, 60)} The END. Ünd\x0bso!") for k in range(120)]
    # a pattern that only a model with memory can use
    rows += [(500 + k, " ".join(["red", "green", "blue"] * 40)) for k in range(40)]
    return rows + [(900, None), (901, ""), (902, prose(7, 3000, 60)), (903, "never seen words " + "x" * 2000), (904, "a"), (904, "a"), (None, "no id")]


def test_counts_and_base_scores(spark, documents):
    rows = corpus()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(w for d, t in rows if not held(d) for w in [*recurrent.words_of(t), ""])
    total, distinct = sum(count.values()), len(count)
    got = recurrent.scores(documents(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        words = [*recurrent.words_of(text[r.doc_id]), ""]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words), total)
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words))
        assert np.isfinite(r.score) and r.score < 0
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    memory = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 540]
    assert sum(r.score for r in memory) > 0.6 * sum(r.base_score for r in memory)


def vocabulary(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(recurrent, "HEAD", 12)
    monkeypatch.setattr(recurrent, "CLASSES", 4)
    words = ["", *(f"w{k}" for k in range(20)), "end.", "a,"]
    counts = pd.DataFrame({"word": words, "shape": [recurrent.shape_of(w) if w else -1 for w in words], "c": [9, *range(40, 20, -1), 3, 2]})
    shapes = counts[counts.word != ""].groupby("shape").agg(n=("c", "size"), c=("c", "sum")).reset_index()
    return recurrent.Vocabulary(counts.sort_values("c", ascending=False), shapes, int(counts.c.sum()), len(counts)), counts


def test_probabilities_sum_to_one(monkeypatch):
    v, counts = vocabulary(monkeypatch)
    network = recurrent.Network(v)
    h = np.random.default_rng(0).standard_normal((3, recurrent.HIDDEN)).astype(np.float32)
    p = np.array([np.exp(network.log_probabilities(h, np.full(3, y))) for y in range(v.symbols)])
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    for shape in {recurrent.shape_of(w) for w in counts.word if w}:
        tail = [10 ** v.log_share[v.number[w]] for w in counts.word if w and v.symbol[v.number[w]] == 1 + shape]
        assert np.isclose(sum(tail) + 0.5 * 10 ** -v.log_shape[shape], 1)


def test_gradients_equal_differences(monkeypatch):
    v, _ = vocabulary(monkeypatch)
    network = recurrent.Network(v)
    network.w = {k: x.astype(np.float64) for k, x in network.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, v.symbols, (2, 5, 3))
    valid = np.ones_like(y, bool)
    valid[3:, 0] = False

    def loss():
        h, total = np.zeros((3, recurrent.HIDDEN)), 0
        for t in range(5):
            h = network.step(x[t], h)[0]
            total -= network.log_probabilities(h, y[t])[valid[t]].sum()
        return total / valid.sum()

    grads, _ = network.segment_gradients(x, y, valid, np.zeros((3, recurrent.HIDDEN)))
    for k, w in network.w.items():
        at = (x[0, 0], 3) if k == "input" else (y[0, 1], 2) if k == "word" else tuple(s // 2 for s in w.shape)
        before, values = w[at], []
        for d in (1e-5, -1e-5):
            w[at] = before + d
            values.append(loss())
        w[at] = before
        assert np.isclose((values[0] - values[1]) / 2e-5, grads[k][at], atol=1e-6), k


def test_state_is_carried_across_segments(monkeypatch):
    v, _ = vocabulary(monkeypatch)
    network = recurrent.Network(v)
    docs = [np.random.default_rng(k).integers(0, v.symbols, n).astype(np.int16) for k, n in enumerate([1, 100, 33, 32, 64, 7])]
    expected = []
    for d in docs:
        h, before, total = np.zeros((1, recurrent.HIDDEN), np.float32), np.array([0]), 0.0
        for s in d:
            h = network.step(before, h)[0]
            total += network.log_probabilities(h, np.array([s]))[0]
            before = np.array([s])
        expected.append(total / np.log(10))
    assert np.allclose(recurrent.run_documents(network, docs), expected, rtol=1e-4)


def test_no_training_documents_and_empty_table(spark, documents):
    assert recurrent.scores(documents([])).count() == 0
    got = recurrent.scores(documents([(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)] and all(np.isfinite(r.score) for r in got)


def test_training_windows_hold_every_token_of_every_training_text(spark, documents):
    import pandas as pd

    rows = [(k, t) for k, t in corpus() if k is not None and not zlib.crc32(str(k).encode()) % 5 == 1]
    rows += [(k, prose(k, 1500, 60)) for k in range(2000, 2012) if not zlib.crc32(str(k).encode()) % 5 == 1]
    count = Counter(w for _, t in rows for w in [*recurrent.words_of(t), ""])
    counts = pd.DataFrame([(w, recurrent.shape_of(w) if w else -1, c) for w, c in count.items()], columns=["word", "shape", "c"]).sort_values(["c", "word"], ascending=[False, True])
    shapes = counts[counts.word != ""].groupby("shape").agg(n=("c", "size"), c=("c", "sum")).reset_index()
    v = recurrent.Vocabulary(counts, shapes, int(counts.c.sum()), len(counts))
    docs = documents(rows).selectExpr("doc_id", "false as held_out", "text")
    windows = [np.frombuffer(w.window, recurrent.SYMBOL) for w in recurrent._windows(recurrent._encoded(docs, v)).collect()]
    assert all(1 < len(w) <= recurrent.SEGMENT * recurrent.SEGMENTS + 1 for w in windows)
    targets = Counter(int(s) for w in windows for s in w[1:])
    assert targets == Counter({int(s): int(counts.c[v.symbol == s].sum()) for s in np.unique(v.symbol)})
    assert sum(targets.values()) == sum(count.values()) > 15_000


def test_training_carries_the_state_through_a_window(monkeypatch):
    v, _ = vocabulary(monkeypatch)
    network, rng = recurrent.Network(v), np.random.default_rng(5)
    windows = [rng.integers(0, v.symbols, n).astype(recurrent.SYMBOL) for n in [2, 33, 34, 65, 513, 513, 300] * 30]
    seen, expected, fresh = Counter(), Counter(tuple(int(s) for s in w[a:a + 33]) for w in windows for a in range(0, len(w) - 1, 32)), 0

    def segment_gradients(self, x, y, valid, h):
        nonlocal fresh
        for k in range(x.shape[1]):
            n = int(valid[:, k].sum())
            seen[(int(x[0, k]), *map(int, y[:n, k]))] += 1
        fresh += int((h == 0).all(axis=1).sum())
        return {k: np.zeros_like(w) for k, w in self.w.items()}, h + 1

    monkeypatch.setattr(recurrent.Network, "segment_gradients", segment_gradients)
    network.train(windows, 1)
    assert seen == expected and fresh == len(windows)


def test_copies_are_dealt_over_all_turns(spark, documents):
    import pandas as pd

    rows = [(k, None if k % 2 else "the same text") for k in range(4000)]
    counts = pd.DataFrame([("", -1, 4000)] + [(w, recurrent.shape_of(w), 2000) for w in ("the", "same", "text")], columns=["word", "shape", "c"])
    shapes = counts[counts.word != ""].groupby("shape").agg(n=("c", "size"), c=("c", "sum")).reset_index()
    v = recurrent.Vocabulary(counts, shapes, 10_000, 4)
    docs = documents(rows).selectExpr("doc_id", "false as held_out", "text")
    dealt = recurrent._dealt(recurrent._windows(recurrent._encoded(docs, v)), 10)
    sizes = [r["count"] for r in dealt.groupBy("turn").count().collect()]
    assert len(sizes) == 10 * recurrent.ROUNDS and sum(sizes) == 4000 and max(sizes) < 2 * min(sizes)


def test_documents_run_in_a_bounded_number_of_lanes(monkeypatch):
    """All documents ran side by side, each step in fresh memory; lanes are bounded, stay full, and their memory is used again."""
    v, _ = vocabulary(monkeypatch)
    network, rng = recurrent.Network(v), np.random.default_rng(9)
    monkeypatch.setattr(recurrent, "LEAST_LANES", 2)
    monkeypatch.setattr(recurrent, "MOST_LANES", 8)
    docs = [rng.integers(0, v.symbols, n).astype(np.int16) for n in [700, *rng.integers(1, 90, 200)]]
    alone = [recurrent.run_documents(network, [d])[0] for d in docs]
    widths, rooms, run = [], set(), recurrent.Network.run

    def watched(self, x, h):
        widths.append(x.shape[1])
        states, kept = run(self, x, h)
        rooms.add(states.__array_interface__["data"][0])
        return states, kept

    monkeypatch.setattr(recurrent.Network, "run", watched)
    network.room.clear()
    assert np.allclose(recurrent.run_documents(network, docs), alone, rtol=1e-4)
    segments = sum(-(-len(d) // recurrent.SEGMENT) for d in docs)
    assert sum(widths) == segments and max(widths) == 8 and len(widths) <= 1.2 * segments / 8 and len(rooms) == 1
    assert recurrent.run_documents(network, [docs[0][:0]]).tolist() == [0.0] and len(recurrent.run_documents(network, [])) == 0


def test_shapes_of_words():
    expected = {"ab": 0, "abcdef": 1, "abcdefghij": 2, "été": 3, "a7": 0, "end.": 12, "a,": 24, "no!": 36, "x)": 48, "a#b": 6, "é=x": 9, "étés-abcdefg": 5}
    assert {w: recurrent.shape_of(w) for w in expected} == expected


def test_words_are_split_and_shaped_together():
    """Texts were split, and words shaped, one by one."""
    import pyarrow as pa

    texts = [None, "", " \t", "A b", "  ÀÉ\x1cX\x85y end.\n", "x\xa0Y a#b é=x NO! (7) étés-abcdefg", "\x0b\x0c\r\tfive5 sixsix ninenine9 tententen0   \x1f,", None, "last"]
    for given in (pa.array(texts), pa.array(["cut", *texts]).slice(1), pa.array(texts, pa.large_string())):
        words, borders = recurrent.words_in(given)
        plain = words.to_pylist()
        assert [plain[a:b] for a, b in zip(borders, borders[1:])] == [recurrent.words_of(t) for t in texts]
        assert recurrent.shapes_of(words).tolist() == [recurrent.shape_of(w) for w in plain]
        assert recurrent.shapes_of(words.slice(3, 4)).tolist() == [recurrent.shape_of(w) for w in plain[3:7]]
    words, borders = recurrent.words_in(pa.array([], pa.string()))
    assert len(words) == len(recurrent.shapes_of(words)) == 0 and borders.tolist() == [0]
    assert recurrent._sums(np.array([1.0, 2, 4]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 4, 0]


def test_pieces_hold_every_row_once_and_are_bounded():
    import pyarrow as pa

    batch = pa.record_batch({"text": ["a" * n if n else None for n in [0, 5, 0, 30, 4, 4, 4, 0, 9, 0]], "row": list(range(10))})
    pieces = list(recurrent._pieces(iter([batch, batch.slice(0, 0), batch.slice(4)]), 10))
    assert [r for p in pieces for r in p["row"].to_pylist()] == [*range(10), *range(4, 10)]
    assert all(sum(len(t or "") for t in p["text"].to_pylist()[:-1]) <= 10 for p in pieces)


def test_counts_and_symbols_do_not_depend_on_pieces(spark, documents, monkeypatch):
    rows = corpus()
    whole = {(r.word, r["shape"], r.c) for r in recurrent.word_counts(documents(rows)).collect()}
    expected = Counter(w for _, t in rows for w in [*recurrent.words_of(t), ""])
    assert whole == {(w, recurrent.shape_of(w) if w else -1, c) for w, c in expected.items()}
    # in this process, where pieces and held words can be made small
    import pyarrow as pa

    parts = []

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            parts.extend(run(iter([pa.record_batch({"text": pa.array([t for _, t in rows[k:k + 50]], pa.string())}) for k in range(0, len(rows), 50)])))
            return spark.createDataFrame([("", 0, 0)], "word string, shape int, n long")

    monkeypatch.setattr(recurrent, "COUNTED_BYTES", 500)
    monkeypatch.setattr(recurrent, "HELD_WORDS", 60)
    recurrent.word_counts(Frame())
    found = Counter()
    for p in parts:
        for w, shape, n in zip(*(p[c].to_pylist() for c in ("word", "shape", "n"))):
            assert shape == (recurrent.shape_of(w) if w else -1)
            found[w] += n
    assert found == expected and len(parts) > 2


def test_scoring_makes_the_input_table_once_and_keeps_one_step(monkeypatch):
    """The table of inputs was made again in every step, and all steps kept what only a gradient needs."""
    v, _ = vocabulary(monkeypatch)
    network, made, kept, scaled, run = recurrent.Network(v), [], set(), recurrent.Network.scaled, recurrent.Network.run
    monkeypatch.setattr(recurrent.Network, "scaled", lambda self: made.append(1) or scaled(self))

    def watched(self, x, h):
        states, rest = run(self, x, h)
        kept.add(rest.shape[1])
        return states, rest

    monkeypatch.setattr(recurrent.Network, "run", watched)
    documents = [np.random.default_rng(k).integers(0, v.symbols, 700).astype(np.int16) for k in range(5)]
    before = recurrent.run_documents(network, documents)
    assert len(made) == 1 and kept == {1}
    network.w["input"] += 0.5  # weights that changed since are seen
    assert not np.allclose(recurrent.run_documents(network, documents), before) and len(made) == 2

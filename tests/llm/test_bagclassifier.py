import random
import zlib

import numpy as np
from conftest_llm import prose

from foliowire.llm import bagclassifier
from foliowire.llm.common import WORD


def labelled(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        text, good = prose(k, rng.randrange(20, 400)), k % 4 != 0
        if not good:
            words = text.split()
            at = rng.randrange(max(1, len(words) - 15))
            words[at:at + 60] = [w.upper() + "###" for w in words[at:at + 60]]
            text = " ".join(words)
        docs.append((k, text))
        labels.append((k, int(good), 0))
    return docs, labels


def test_measures_count_passages_and_bytes():
    text = "  AB 12 #x!\n" + " ".join(["word"] * 130)
    m = bagclassifier.passage_measures(text)
    words = WORD.findall(text)
    first = "".join(words[:64]).encode()
    assert len(m) == -(-len(words) // 64)
    assert np.allclose(m[0, :4] * len(first), [2, 2, 1, 0]) and np.isclose(m[0, 7], sum(map(len, words[:64])) / 64 / 10)
    assert np.isclose(m[1, 9], 1 / 64) and m[:, -1].sum() == 0
    assert bagclassifier.passage_measures(None).tolist() == bagclassifier.passage_measures(" \t").tolist() == [[0] * 12 + [1]]
    assert np.isfinite(bagclassifier.passage_measures("🙂é" * 5000)).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model, x, sizes, y = bagclassifier.BagModel(), rng.standard_normal((9, bagclassifier.MEASURES)), np.array([4, 1, 4]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(model.forward(x, sizes)["p"]) + (1 - y) * np.log(1 - model.forward(x, sizes)["p"]))
    grads = model.gradients(x, sizes, y)
    for k, w in model.w.items():
        at = tuple(s // 2 for s in w.shape)
        before, values = w[at], []
        for d in (1e-5, -1e-5):
            w[at] = before + d
            values.append(loss())
        w[at] = before
        assert np.isclose((values[0] - values[1]) / 2e-5, grads[k][at], atol=1e-6)


def test_held_out_documents_are_told_apart(spark, documents):
    docs, labels = labelled()
    table = spark.createDataFrame(labels + [(3, 0, 0), (7, None, 0), (8, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = documents(docs + [(None, None), (5000, ""), (5000, "")])
    model = bagclassifier.learned(frame, table)
    got = {}
    for r in bagclassifier.scored(frame, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        got[r.doc_id] = r
    tested = [(got[d].predicted, q) for d, q, _ in labels if got[d].held_out]
    assert len(tested) > 80 and np.mean([p == q for p, q in tested]) > 0.95
    assert model.w["enc"].tolist() == bagclassifier.learned(frame.repartition(5), table).w["enc"].tolist()


def test_one_kind_of_label_or_none(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    for labels, score in (([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0)):
        model = bagclassifier.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r.score for r in bagclassifier.scored(docs, model).collect()} == {score}
    assert bagclassifier.scored(documents([]), model).count() == 0

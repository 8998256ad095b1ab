import numpy as np
import pytest

from foliowire.llm import capfilters

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    good = [(i, v) for i, (vec_id, v) in enumerate(rows) if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in good}
    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y):
                x32, y32 = (np.asarray(v, np.float32).astype(np.float64) for v in (x, y))
                if x32 @ y32 / np.sqrt((x32 @ x32) * (y32 @ y32)) >= 0.9:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links.get(k, ())
        least = vec_id if len(seen) == 1 else min(rows[k][0] for k in seen)
        out.append((vec_id, len(links.get(i, ())), least, vec_id is None or vec_id == least))
    return sorted(out, key=str)


def vectors(dimension, n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dimension))
    rows = [(k, (centres[k % 6] + 0.3 * rng.standard_normal(dimension)).tolist()) for k in range(n)]
    rows += [(n + k, rows[k % 9][1]) for k in range(40)] + [(n + 50, (2.5 * np.array(rows[3][1])).tolist())]
    rows += [(n + 60 + k, rng.standard_normal(dimension).tolist()) for k in range(40)]
    return rows


ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] * 4), (9005, [float("nan")] * 8), (9006, [float("inf")] + [1.0] * 7), (None, [1.0] * 8),
       (9007, [1.0] * 8), (9007, [1.0] * 8), (9007, [-1.0] + [1.0] * 7), (9008, [1.0] * 9), (9009, [0.0, -0.0, 1.0]), (9010, [-0.0, 0.0, 1.0]), (9011, [3.0]), (9012, [-1.0]), (9013, [1e-30] * 8)]


@pytest.mark.parametrize("dimension", [64, 20])
def test_links_equal_brute_force(spark, monkeypatch, dimension):
    monkeypatch.setattr(capfilters, "BLOCK", 16)
    rows = vectors(dimension, 150) + ODD
    got = capfilters.linked_vectors(spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("codewords", [64, 512, 1024])
def test_recall_on_pairs_at_the_cosine(codewords):
    rng = np.random.default_rng(9)
    threshold = capfilters.threshold_for(64, codewords)
    a, b = rng.standard_normal((2, 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    found = [len(np.intersect1d(x, y)) > 0 for x, y in zip(capfilters.exceeded(a, threshold, codewords), capfilters.exceeded(b, threshold, codewords))]
    assert np.mean(found) > 0.98


def test_list_decoding_finds_all_directions():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1, 16))
    v /= np.linalg.norm(v)
    expected = []
    for number, (rotation, codes) in enumerate(capfilters.product_codes(16, 1024)):
        left, right = (c @ part for c, part in zip(codes, np.split(v[0] @ rotation, [codes[0].shape[1]])))
        expected += (np.flatnonzero((left[:, None] + right[None, :]).ravel() >= 0.75) + number * 1024**2).tolist()
    assert len(expected) > 3 and capfilters.exceeded(v, 0.75, 1024)[0].tolist() == expected


def test_empty_table(spark):
    assert capfilters.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0

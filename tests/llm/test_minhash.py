import random

from conftest_llm import prose

from foliowire.llm import components, minhash


def brute(rows):
    """Component per doc_id by all pairs of full shingle sets."""
    sets = []
    for doc_id, text in rows:
        w = minhash.words_of(text)
        sets.append((doc_id, {tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def corpus():
    rng = random.Random(3)
    base = [prose(s, 120, 5000).split() for s in range(4)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "One  TWO\n"), (6, "a b c d"), (7, "one")]
    for k in range(90):
        words = list(base[k % 4])
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
        rows.append((100 + k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    rows += [(300 + k, " ".join(base[0])) for k in range(30)] + [(400, prose(77, 30_000, 3000))]
    # a chain: each text is near its neighbours only
    chain = prose(50, 200, 9000).split()
    for k in range(12):
        chain[k * 12:k * 12 + 4] = [f"step{k}x{j}" for j in range(4)]
        rows.append((500 + k, " ".join(chain)))
    return rows


def test_components_equal_brute_force(spark, documents, monkeypatch):
    rows = corpus()
    expected = brute(rows)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "CHUNK", 5)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == expected


def test_blocks_connect_what_stars_leave_apart():
    import numpy as np
    import pandas as pd

    a, b = (np.arange(150, dtype=np.uint8) + k for k in (0, 90))
    part = pd.DataFrame({"bucket": 1, "low": 0, "high": 0, "block": 0, "node": [1, 2, 3, 4], "component": [1, 1, 3, 4],
                         "short": [a.tobytes(), a.tobytes(), a.tobytes(), b.tobytes()]})
    assert {tuple(x) for x in minhash._possible(part).to_numpy()} == {(1, 1), (2, 1), (3, 1)}
    split = part.assign(high=1, block=[0, 0, 1, 1])
    assert {tuple(x) for x in minhash._possible(split).to_numpy()} == {(1, 1), (2, 1), (3, 1)}
    sets = [np.arange(s, s + 100, dtype="<u8").tobytes() for s in (0, 11, 12, 22)]
    crowd = part.rename(columns={"bucket": "crowd"}).assign(component=[1, 2, 3, 4], members=sets)
    # 89 of 111 in common is a link, 88 of 112 is none
    assert {tuple(x) for x in minhash._linked(crowd).to_numpy()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {tuple(x) for x in minhash._linked(crowd.iloc[[0, 2]]).to_numpy()} == set()


def test_ids_that_repeat_or_are_missing(spark, documents):
    text = prose(1, 50)
    rows = [(9, text), (9, text), (9, prose(2, 50)), (4, prose(2, 50)), (None, text), (11, text)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(documents(rows)).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == sorted([(9, 4, False)] * 3 + [(4, 4, True), (11, 4, False), (None, None, True)], key=lambda r: str((r[0],)))
    kept = minhash.keep_one(documents(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None"] and kept.columns == documents(rows).columns


def test_empty_table(spark, documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_stars_connect_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (60, 55)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[1000 + k] == 1000 for k in range(50)) and got[60] == got[55] == 55

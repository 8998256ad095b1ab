import numpy as np
import pytest
from conftest_llm import prose

from foliowire.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at three times the size, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return full
        rest = total - sum(full.values())
        goal = {s: weight[s] * rest / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if goal[s] > 3 * sizes[s]]
        if not over:
            return full | goal
        full |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_permutations(size):
    for seed in (1, 99):
        assert sorted(mixing.permuted(np.arange(size), size, seed)) == list(range(size))


def corpus():
    rows = [(k, prose(k, 20 + k * 7 % 150), "en", ["a", "b", "Ä", "z", None][k % 5]) for k in range(200)]
    rows += [(900, prose(900, 30), "en", "tiny"), (901, None, "en", "empty"), (902, " \n", "en", "b"), (903, prose(903, 4000), "en", "b"),
             (5, prose(5, 55), "en", "a"), (5, prose(5, 55), "en", "a"), (None, prose(8, 40), "en", "a"), (904, "one", "en", "single")]
    return rows


def test_targets_and_taken_words(spark, documents):
    rows = corpus()
    got = mixing.taken(documents(rows)).collect()
    size = lambda t: len(mixing.WORD.findall(t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    goals = brute_targets(sizes)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    by_source = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source]) and 0 <= r.taken <= 3 * r.size
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    assert all(abs(by_source[s] - goals[s]) <= 2 * mixing.BLOCK_WORDS for s in goals)
    again = mixing.taken(documents(rows).repartition(7)).collect()
    count = lambda x: sorted(map(str, x))
    assert count(got) == count(again)


def test_shards_draw_every_source_near_its_share(spark, documents):
    sizes = mixing.sized(documents([(k, prose(k, 300), "en", "ab"[k % 2]) for k in range(400)]))
    goals, filled = mixing.mix(sizes)
    slots = filled.select("slot", "shard").distinct()
    assert slots.count() == slots.agg({"slot": "max"}).first()[0] + 1
    assert slots.groupBy("shard").count().where(f"count > {mixing.SHARD_SLOTS}").count() == 0


def test_mixed_documents_hold_the_taken_words(spark, documents):
    rows = corpus()
    docs = documents(rows)
    mixed = mixing.mixed_documents(docs)
    out = mixed.collect()
    assert mixed.columns == docs.columns
    assert sum(len(mixing.WORD.findall(r.text)) for r in out) == sum(r.taken for r in mixing.taken(docs).collect())
    source = {}
    for r in rows:
        source.setdefault(r[0], []).append(r[1] or "")
    for r in out:
        assert r.n_chars == len(r.text)
        assert any(all(line in t for line in r.text.split("\n")) for t in source[r.doc_id])


def test_empty_table(spark, documents):
    assert mixing.taken(documents([])).count() == 0 == mixing.mixed_documents(documents([])).count()
    assert [r.taken for r in mixing.taken(documents([(1, None)])).collect()] == [0]

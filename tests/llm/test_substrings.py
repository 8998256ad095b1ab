import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest_llm import prose

from foliowire.llm import substrings
from foliowire.llm.common import WORD


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[j:j + 35]) for w in words for j in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j:j + 35])] > 1:
                gone[j:j + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    passage, other = prose(1, 60, 9000), prose(2, 35, 9000)
    return [(0, None), (1, ""), (2, "\n \t"), (3, "short text"), (4, prose(3, 35)), (5, prose(3, 34)),
            (6, f"{prose(4, 50)}\n{passage} {prose(5, 20)}"), (7, f"{passage}\x0b{prose(6, 90)} {passage}"), (8, prose(7, 80) + " " + passage[:200]),
            (9, f"{other} {prose(8, 9)} {other}"), (10, " ".join(["ha"] * 36)), (11, " ".join(["ho"] * 35)), (12, " ".join(["hu"] * 300)),
            (13, prose(9, 20_000, 20_000)), (14, " ".join(prose(9, 20_000, 20_000).split()[300:700])), (15, other.upper()), (16, "é" + other),
            (17, prose(10, 70)), (17, prose(10, 70)), (18, prose(11, 70)), (18, prose(12, 70) + " " + other), (None, passage), (19, " ".join(passage.split()[10:45]))]


@pytest.mark.parametrize("report", [1 << 20, 50])
def test_removals_equal_brute_force(spark, documents, monkeypatch, report):
    monkeypatch.setattr(substrings, "REPORT", report)
    monkeypatch.setattr(substrings, "SHARD_CHARS", 2000 if report == 50 else 4_000_000)
    got = sorted((tuple(r) for r in substrings.removals(documents(corpus()).repartition(3)).collect()), key=str)
    assert got == brute(corpus())


def test_texts_lose_the_removed_words_only(spark, documents):
    rows = corpus()
    docs = documents(rows)
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == sorted(((b[0], b[3]) for b in brute(rows)), key=str)
    unchanged = {r.doc_id: r.text for r in out.collect() if r.doc_id in (0, 1, 2, 3, 13, 17)}
    assert unchanged[0] is None and unchanged[1] == "" and unchanged[2] == "\n \t" and unchanged[3] == "short text"
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())


def test_empty_table(spark, documents):
    assert substrings.removals(documents([])).count() == 0 == substrings.without_repeats(documents([])).count()


def test_found_places_of_a_hot_hash_are_dealt_by_document():
    n, parts = 20_000, 10
    reporter = substrings.Reporter(parts)
    ids, crcs = np.arange(n, dtype=np.int64), np.full(n, 7, np.uint32)
    hot = np.full(n, 12345, np.uint64)
    assert not list(reporter.add(ids, crcs, hot, hot, np.zeros(n, np.uint32), np.arange(n) % 50))
    reports = reporter.report()
    known = reports[reports["kind"] == substrings.KNOWN]
    sizes = known["ids"].map(len) // 8
    assert known["part"].nunique() == parts and sizes.sum() == n and sizes.max() < 2 * n // parts
    told = reports[reports["kind"] == substrings.TOLD]
    assert len(told) == 1 and len(told["hashes"].iloc[0]) == 8
    found = pd.concat([substrings._counted(r) for _, r in reports.groupby("part")])
    assert sorted(found["id"]) == list(range(n))
    assert all(np.frombuffer(p, "<u4").tolist() == [i % 50, 1] for i, p in zip(found["id"], found["places"]))

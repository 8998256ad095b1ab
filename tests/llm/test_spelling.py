import random
import re
import zlib
from collections import Counter

import numpy as np

from foliowire.llm import spelling

LETTERS = "[a-zÀ-ÿ]+"


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, modulus=None, factor=5, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(LETTERS, lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if modulus and h % modulus == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def noisy_rows(seed, words=60, docs=40):
    """Texts of words and of their misspellings, with letters beyond ASCII."""
    rng = random.Random(seed)
    alphabet = "abcdeimnorstéß×"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 10))) for _ in range(words)]
    rows = []
    for d in range(docs):
        text = []
        for _ in range(120):
            w = rng.choice(base[:1 + rng.randrange(words)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + rng.choice("aé") + w[k + 1:], w[:k] + "e" + w[k:]))
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d * 7, rng.choice((" ", ", ", "-1-")).join(text)))
    return rows


def test_equals_brute_force(documents):
    rows = noisy_rows(1)
    got = result(spelling.spelling_forms(documents(rows)))
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_parts_of_blocks_and_dropped_code_points(documents, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 3)  # blocks in many parts
    rows = noisy_rows(2)
    assert result(spelling.spelling_forms(documents(rows), modulus=7, least_count=2)) == brute(rows, modulus=7, least_count=2)


def test_nulls_repeats_and_long_words(documents):
    long = "ab" * 3000
    rows = [(None, "Wörter wörter WöRTER"), (1, None), (2, ""), (2**60 + 1, "wörter words words"), (2**60 + 1, "wörter words words"), (3, "worter " * 40),
            (4, f"{long} {long}x {long[:-1]}c " * 6), (4, f"{long} " * 60)]
    assert result(spelling.spelling_forms(documents(rows), modulus=3, least_length=5)) == brute(rows, modulus=3, least_length=5)
    assert any(len(w[0]) > 5999 and w[4] for w in result(spelling.spelling_forms(documents(rows))))


def test_chains_lead_to_the_last_form_and_ties_to_the_least(documents):
    rows = [(0, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaabbb " * 625 + "zzzzza " * 30 + "zzzzzb " * 30 + "zzzzzc " * 6)]
    got = {r[0]: r for r in result(spelling.spelling_forms(documents(rows)))}
    assert got["aaaaaa"][:3] == ("aaaaaa", "aaaaab", "aaabbb")
    assert got["zzzzzc"][1] == "zzzzza"


def test_empty_table(documents):
    assert spelling.spelling_forms(documents([])).collect() == []
    assert spelling.spelling_forms(documents([(1, "short")])).collect() == []


def test_blocks_that_meet_cover_every_edit():
    rng = random.Random(3)
    steps = {tuple(s) for s in spelling._steps()}
    classes = np.array([i % spelling.CLASSES for i in range(len(spelling.LETTERS))])

    def key(w):
        return np.bincount([classes[spelling.LETTERS.index(c)] for c in w], minlength=spelling.CLASSES)

    for _ in range(300):
        w = "".join(rng.choices(spelling.LETTERS, k=8))
        k = rng.randrange(8)
        for x in (w[:k] + w[k + 1:], w[:k] + rng.choice(spelling.LETTERS) + w[k + 1:]):
            there, back = tuple(key(x) - key(w)), tuple(key(w) - key(x))
            assert there in steps or back in steps
            assert there == back or not (there in steps and back in steps)

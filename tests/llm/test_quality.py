from conftest_llm import prose

from foliowire.llm import quality


def brute(text):
    words = quality.WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if quality.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


CASES = [None, "", " \n\t ", "a", "a b c a b c", "x x x x x", "é ü\x0bß\n\n#$ |<>|", "l one\nl one\n \nl one \nother", prose(1, 300, 5), "    z", "long " * 5000]


def test_measures_equal_brute_force():
    for text in CASES:
        assert quality.measure(text)[:5] == brute(text), repr(text)[:60]


def test_rejects_what_lies_outside_its_group(spark, documents):
    rows = [(i, prose(i, 80), "en", "ab"[i % 2]) for i in range(240)]
    rows += [(1000, "# ".join(prose(5, 80).split()), "en", "a"), (1001, prose(6, 80).upper(), "en", "b"), (1002, None, None, None),
             (1003, "short text", "fr", "z"), (1004, prose(7, 90), "xx", "rare"), (1004, "|| ".join(prose(8, 90).split()), None, None), (None, prose(9, 60))]
    docs = documents(rows)
    got = {}
    for r in quality.verdicts(docs).collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert all(got[i] == [(False, True)] for i in range(240))
    assert got[1000] == got[1001] == [(False, False)]
    assert got[1002] == got[1003] == [(True, False)]
    assert sorted(got[1004]) == [(False, False), (False, True)] and got[None] == [(False, True)]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 242 and {r.kept for r in kept.select("kept").distinct().collect()} == {"x"}


def test_sketches_merge_in_any_order(spark, documents):
    docs = documents([(i, prose(i, 60 + i), "en", "abc"[i % 3]) for i in range(90)], extra=False)
    both = quality.sketches(quality.measures(docs))
    halves = [quality.sketches(quality.measures(docs.where(f"doc_id % 2 = {k}"))) for k in (0, 1)]
    add = halves[1].union(halves[0]).groupBy("lang", "source", "measure", "cell").sum("n")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, add.collect()))


def test_empty_table(spark, documents):
    assert quality.verdicts(documents([])).count() == 0 == quality.keep_good(documents([])).count()


def brute_limits(rows, name):
    """Fences of one measure from (lang, source, cell) lists, weights written out."""
    def quantile(weights, percent):
        total, seen = sum(weights.values()), 0
        for cell in sorted(weights):
            seen += weights[cell]
            if 100 * seen >= percent * total:
                return cell

    def counted(cells, lent=(), size=1):
        weights = {}
        for c in cells:
            weights[c] = weights.get(c, 0) + quality.UNIT
        for c, w in dict(lent).items():
            weights[c] = weights.get(c, 0) + quality.PRIOR * w // size
        return weights

    corpus = counted([c for *_, c in rows])
    limits = {}
    for lang, source in {r[:2] for r in rows}:
        same_lang = [c for x, _, c in rows if x == lang]
        lent = counted(same_lang, corpus, len(rows))
        weights = counted([c for x, y, c in rows if (x, y) == (lang, source)], lent, len(same_lang) + quality.PRIOR)
        low, middle, high = (quantile(weights, p) for p in (100 - quality.TAIL, 50, quality.TAIL))
        step = lambda d: quality.REACH * max(d, quality.LEAST_STEP)
        limits[lang, source] = (low - step(middle - low) if quality.MEASURES[name][-1] else None, high + step(high - middle))
    return limits


def spaced(seed, n, letters):
    """n words whose mean length in letters varies with the seed."""
    return " ".join("abcdefghijklmnop"[k % 16] * (letters + (seed * 7 + k * k) % 3) + str(k) for k in range(n))


def test_fences_equal_brute_force(spark, documents):
    rows = [(i, spaced(i, 60 + i % 7, 3 + i % 4), ("en", "fr", None)[i % 3], ("a", None)[i % 2]) for i in range(60)]
    rows += [(100 + i, spaced(i, 70, 9), "en", "b") for i in range(150)] + [(300, "short", "en", "a")]
    fences = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.measures(documents(rows))).collect()}
    assert len(fences) == 7
    for name in ("word_length", "upper_rate", "repeat_rate"):
        part, whole, scale, top, _, _ = quality.MEASURES[name]
        cells = []
        for _, text, lang, source in rows[:-1]:
            counts = dict(zip(quality.COUNTS, quality.measure(text)))
            cells.append((lang, source, min(top, scale * counts[part] // max(counts[whole], 1))))
        for group, (low, high) in brute_limits(cells, name).items():
            assert fences[group][f"max_{name}"] == high, (group, name)
            if low is not None:
                assert fences[group][f"min_{name}"] == low, (group, name)


def test_the_same_text_is_judged_by_its_group(spark, documents):
    wide = [(i, spaced(i, 60, 3 + i % 9), "en", "wide") for i in range(400)]
    narrow = [(1000 + i, spaced(i, 60, 4), "en", "narrow") for i in range(400)]
    long_words = spaced(1, 60, 13)
    docs = documents(wide + narrow + [(5000, long_words, "en", "wide"), (5001, long_words, "en", "narrow")])
    measured = quality.measures(docs)
    judged = {r.doc_id: r for r in quality.judged(measured, quality.thresholds(measured)).collect()}
    assert judged[5000].kept and not judged[5001].kept and judged[5001].outside == ["word_length"]
    assert all(r.kept for i, r in judged.items() if i < 5000)


def test_a_few_occurrences_never_condemn_a_short_text(spark, documents):
    rows = [(i, prose(i, 80), "en", "a") for i in range(200)]
    twice = "a line of words\n" + prose(1, 60) + "\na line of words"
    rows += [(500, twice), (501, prose(3, 60) + " # # #"), (502, "\n".join(["a line of words"] * 6 + [prose(2, 80)])), (503, prose(4, 60) + " #" * 40)]
    kept = {r.doc_id: r.kept for r in quality.verdicts(documents(rows)).collect()}
    assert kept[500] and kept[501] and not kept[502] and not kept[503] and sum(kept.values()) == 202

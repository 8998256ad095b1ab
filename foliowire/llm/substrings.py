"""Removal of passages that recur in the corpus, to the word.

A window is a fixed number of consecutive words. Every word covered by a window whose word sequence starts elsewhere too goes.

1. Each window selects its least short phrase (winnowing), so equal windows select equal phrases. The selected phrases are
   few; only those that recur can lie in a recurring window.
2. The windows around recurring phrases are confirmed by counting the hashes of their whole word sequences.
3. Runs of confirmed windows are passages. Documents are dealt into shards by key; each shard compiles an Aho-Corasick automaton of the
   passages known for its documents, streams the documents through it, and every occurrence found is removed.

Counting works on packed arrays. A task reports a hash at most once, however often it occurs there, so a passage that
stands in a third of all documents reaches the counting task once per reporting task. Its places need no counting then and are
dealt by document, not by hash. Hashes are dealt over parts
whose number follows the size of the corpus, so a part fits into memory. Phrases are identified by 64-bit hashes, which
can only add candidates, and windows by 96 bits.

Defined results: null, empty and short texts have no window; rows that repeat a doc_id are documents of their own, and
rows that repeat id and text recur in each other; a null doc_id is kept; an empty table gives an empty result; other
columns are ignored by ``removals`` and kept by ``without_repeats``, which returns texts without the removed words and
n_chars to match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import WORD, map_frames, materialise, split_words, unused
from foliowire.llm.minhash import WordHashes, _spread

WINDOW = 35
#: Words of the short phrases by which windows are first compared.
PHRASE = 8
#: Hashes a task gathers before it reports them.
REPORT = 1 << 20
#: Hashes that one counting task should hold.
PART_HASHES = 500_000
#: Words that a task hashes together.
TOGETHER = 200_000
#: Characters of the documents that share an automaton.
SHARD_CHARS = 4_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).min

REPORTS = "part int, kind int, hashes binary, more binary, ids binary, crcs binary, places binary"
FOUND = "id long, crc long, places binary"
#: Kinds of report rows: hashes that occur once in a task, hashes known to recur, and the places of the latter.
ONCE, TOLD, KNOWN = 0, 1, 2


class Texts:
    """Documents whose words are hashed together, one after the other."""

    def __init__(self):
        self.hashes = WordHashes()
        self.clear()

    def clear(self) -> None:
        self.rows, self.words, self.ends = [], [], []

    def add(self, row: tuple, words: list[str]) -> None:
        self.rows.append(row)
        self.words += words
        self.ends.append(len(self.words))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all phrases, and of every window within a document its start, its selected phrase and its document."""
        hashes, ends = self.hashes.of(self.words), np.array(self.ends, np.int64)
        phrases = phrase_hashes(hashes)
        chosen = selected_phrases(phrases)
        starts = np.arange(len(chosen))
        document = np.searchsorted(ends, starts, side="right")
        inside = starts + WINDOW <= ends[document] if len(chosen) else np.zeros(0, bool)
        return phrases, starts[inside], chosen[inside], document[inside]


def phrase_hashes(word_hashes: np.ndarray) -> np.ndarray:
    n = len(word_hashes) - PHRASE + 1
    total = np.full(max(n, 0), PHRASE, np.uint64)
    for j in range(PHRASE if n > 0 else 0):
        total = (total ^ word_hashes[j:j + n]) * _GOLDEN
        total ^= total >> np.uint64(29)
    return _spread(total)


def selected_phrases(phrases: np.ndarray) -> np.ndarray:
    """For every window the place of its least phrase, the first if several are equal."""
    width = WINDOW - PHRASE + 1
    if len(phrases) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(phrases, width)
    return view.argmin(axis=1) + np.arange(len(view))


def window_hashes(phrases: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows at ``starts``, from phrases that together cover them."""
    first = np.full(len(starts), 3, np.uint64)
    second = np.full(len(starts), 5, np.uint64)
    for at in (*range(0, WINDOW - PHRASE, PHRASE), WINDOW - PHRASE):
        own = phrases[starts + at]
        first = _spread(first * _GOLDEN + own)
        second = _spread((second ^ own) * np.uint64(0xD6E8FEB86659FD93))
    return first, (second >> np.uint64(32)).astype(np.uint32)


class Reporter:
    """Gathers the hashes of a task's documents and turns them into report rows.

    A hash that occurs more than once here is known to recur: its places are reported as found, and one bare entry
    tells the counting task about it. Found places are dealt by document, so those of a hot hash spread. Places follow each other within a document, so only their differences are written.
    """

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, ids, crcs, deal, hashes, more, places) -> Iterator[pd.DataFrame]:
        """Entries in the order of documents and places; equal hashes have equal ``deal``, which chooses the part."""
        part = (deal % np.uint64(self.parts)).astype(np.int32)
        self.held.append((part, hashes, more, ids, crcs, places.astype(np.uint32)))
        self.size += len(hashes)
        if self.size >= REPORT:
            yield self.report()

    def report(self) -> pd.DataFrame:
        columns = ["part", "kind", "hashes", "more", "ids", "crcs", "places"]
        if not self.size:
            return pd.DataFrame(columns=columns)
        part, hashes, more, ids, crcs, places = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        twice, first = _repeated(hashes, more)
        document = (_spread((ids.astype(np.uint64) ^ crcs) * _GOLDEN) % np.uint64(self.parts)).astype(np.int32)
        rows = []
        for kind, mine, part in ((ONCE, ~twice, part), (TOLD, twice & first, part), (KNOWN, twice, document)):
            at = np.flatnonzero(mine)
            at = at[np.argsort(part[at], kind="stable")]
            borders = np.flatnonzero(np.diff(part[at], prepend=-1))
            for s, e in zip(borders, [*borders[1:], len(at)]):
                own = at[s:e]
                what = (hashes[own].tobytes(), more[own].tobytes()) if kind != KNOWN else (b"", b"")
                where = (ids[own].tobytes(), crcs[own].tobytes(), np.diff(places[own], prepend=np.uint32(0)).tobytes()) if kind != TOLD else (b"",) * 3
                rows.append((int(part[own[0]]), kind, *what, *where))
        return pd.DataFrame(rows, columns=columns)


def _repeated(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one, and which are the first of their value."""
    order = np.lexsort((more, hashes))
    h, m = hashes[order], more[order]
    same = (h[1:] == h[:-1]) & (m[1:] == m[:-1])
    twice, first = np.zeros(len(h), bool), np.ones(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    first[order[1:]] = ~same
    return twice, first


def _runs_of(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """Per document its runs of consecutive places, packed as pairs of first place and length."""
    order = np.lexsort((places, crcs, ids))
    ids, crcs, places = ids[order], crcs[order], places[order].astype(np.int64)
    new_doc = np.r_[True, (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])] if len(ids) else np.zeros(0, bool)
    # rows that repeat id and text report the same places
    begins = np.flatnonzero(new_doc | np.r_[True, np.diff(places) > 1][:len(ids)])
    lasts = places[np.r_[begins[1:] - 1, len(places) - 1][:len(begins)]]
    runs = np.column_stack([places[begins], lasts - places[begins] + 1]).astype("<u4")
    docs = np.flatnonzero(new_doc)
    cuts = np.searchsorted(begins, np.r_[docs, len(ids)])
    return pd.DataFrame({"id": ids[docs], "crc": crcs[docs].astype(np.int64), "places": [runs[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]})


def _counted(reports: pd.DataFrame) -> pd.DataFrame:
    """The places, by document, of the hashes of one part that recur, and the found places of the documents of that part."""
    kinds = reports["kind"].to_numpy()
    join = lambda column, dtype, kind: np.frombuffer(b"".join(reports.loc[kinds == kind, column]), dtype)

    def places(kind):
        parts = [np.cumsum(np.frombuffer(p, "<u4"), dtype=np.uint32) for p in reports.loc[kinds == kind, "places"]]
        return np.concatenate([*parts, np.zeros(0, np.uint32)])

    once = join("hashes", "<u8", ONCE)
    good = _repeated(*(np.concatenate([join(c, d, ONCE), join(c, d, TOLD)]) for c, d in (("hashes", "<u8"), ("more", "<u4"))))[0][:len(once)]
    return _runs_of(np.concatenate([join("ids", "<i8", ONCE)[good], join("ids", "<i8", KNOWN)]),
                    np.concatenate([join("crcs", "<u4", ONCE)[good], join("crcs", "<u4", KNOWN)]),
                    np.concatenate([places(ONCE)[good], places(KNOWN)]))


def _expanded(runs) -> np.ndarray:
    """All places of packed runs."""
    pairs = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
    total = int(pairs[:, 1].sum())
    offset = np.repeat(np.cumsum(pairs[:, 1]) - pairs[:, 1], pairs[:, 1])
    return np.repeat(pairs[:, 0], pairs[:, 1]) + np.arange(total) - offset


def _by_document(reports: DataFrame, name: str) -> DataFrame:
    """(id, crc, places: array of packed runs) of every document with a recurring hash."""
    found = reports.groupBy("part").applyInPandas(_counted, FOUND)
    return materialise(found.groupBy("id", "crc").agg(F.collect_list("places").alias("places")), name)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), text.alias("text"))


def _document_arrays(texts: Texts, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, crc and first word of the document of each entry."""
    ids, crcs = np.array([r[0] for r in texts.rows], np.int64), np.array([r[1] for r in texts.rows], np.uint32)
    begins = np.r_[0, texts.ends[:-1]].astype(np.int64)
    return ids[document], crcs[document], begins[document]


def _phrase_reports(keyed: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        texts, reporter = Texts(), Reporter(parts)

        def reported():
            phrases, _, chosen, document = texts.phrases()
            at, where = np.unique(chosen, return_index=True)
            ids, crcs, begins = _document_arrays(texts, document[where])
            texts.clear()
            yield from reporter.add(ids, crcs, phrases[at], phrases[at], np.zeros(len(at), np.uint32), at - begins)

        for batch in batches:
            for doc_id, crc, text in zip(batch["id"], batch["crc"], batch["text"]):
                if text and len(text) >= 2 * WINDOW - 1:
                    texts.add((doc_id, crc), split_words(text))
                    if len(texts.words) >= TOGETHER:
                        yield from reported()
        if texts.rows:
            yield from reported()
        yield reporter.report()

    return keyed.mapInPandas(run, REPORTS)


def _window_reports(candidates: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        texts, reporter = Texts(), Reporter(parts)

        def reported():
            phrases, starts, chosen, document = texts.phrases()
            recurs = np.zeros(len(phrases) + 1, bool)
            for (_, _, places), begin in zip(texts.rows, [0, *texts.ends]):
                recurs[_expanded(places) + begin] = True
            own = recurs[chosen]
            starts, chosen, document = starts[own], chosen[own], document[own]
            ids, crcs, begins = _document_arrays(texts, document)
            texts.clear()
            yield from reporter.add(ids, crcs, phrases[chosen], *window_hashes(phrases, starts), starts - begins)

        for batch in batches:
            for doc_id, crc, text, places in zip(batch["id"], batch["crc"], batch["text"], batch["places"]):
                texts.add((doc_id, crc, places), split_words(text))
                if len(texts.words) >= TOGETHER:
                    yield from reported()
        if texts.rows:
            yield from reported()
        yield reporter.report()

    return candidates.mapInPandas(run, REPORTS)


def _passages(runs) -> list[tuple[int, int]]:
    """Maximal stretches (first word, end) covered by the windows that start in packed runs."""
    starts = np.unique(_expanded(runs))
    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(s[0]), int(s[-1]) + WINDOW) for s in np.split(starts, breaks)]


class Shard:
    """Documents that share one automaton: passages are added with their document, then all documents are searched."""

    def __init__(self):
        self.documents, self.chars, self.phrases = [], 0, set()

    def add(self, row, text: str | None, places) -> None:
        words = split_words(text)
        if places is not None and len(places):
            for begin, end in _passages(places):
                # a passage is the union of windows laid end to end, the last one flush with its end
                for s in (*range(begin, end - WINDOW, WINDOW), end - WINDOW):
                    self.phrases.add(f" {' '.join(words[s:s + WINDOW])} ")
        self.documents.append((row, text, " ".join(words), len(words)))
        self.chars += len(text or "") + 100

    def located(self) -> Iterator[tuple]:
        """(row, text, words joined by blanks, their number, mask of removed words or None) of every document."""
        automaton = ahocorasick.Automaton()
        for phrase in self.phrases:
            automaton.add_word(phrase, len(phrase))
        if self.phrases:
            automaton.make_automaton()
        for row, text, joined, n in self.documents:
            found = list(automaton.iter(f" {joined} ")) if self.phrases and n >= WINDOW else ()
            gone = None
            if found:
                # where each word begins in the joined words behind a leading blank
                begins = np.flatnonzero(np.frombuffer(f" {joined}".encode("utf-32-le", "surrogatepass"), "<u4") == 32) + 1
                last, length = np.array(found, np.int64).T
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.searchsorted(begins, last - length + 2), 1)
                np.add.at(change, np.searchsorted(begins, last + 1), -1)
                gone = np.cumsum(change)[:-1] > 0
            yield row, text, joined, n, gone


def _sharded(rows: Iterator[tuple]) -> Iterator[Iterator[tuple]]:
    shard = Shard()
    for row, text, places in rows:
        shard.add(row, text, places)
        if shard.chars >= SHARD_CHARS:
            yield shard.located()
            shard = Shard()
    yield shard.located()


def passages(docs: DataFrame) -> DataFrame:
    """(id, crc, places) of every document with a recurring window: the starts of its recurring windows, as packed runs."""
    keyed = _keyed(docs)
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = lambda entries: int(max(64, entries // PART_HASHES))
    phrases = _by_document(_phrase_reports(keyed, parts(chars // 80)), "recurring-phrases")
    # a run takes eight bytes; a phrase stands for up to 28 windows, for half as many as a rule
    size = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    entries = 2 * (phrases.agg(F.sum(size)).first()[0] or 0)
    candidates = keyed.join(phrases, ["id", "crc"])
    return _by_document(_window_reports(candidates, parts(int(entries))), "recurring-windows")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    joined = _keyed(docs).join(passages(docs), ["id", "crc"], "left").select("id", "text", "places")

    def run(batches):
        rows = (r for batch in batches for r in zip(batch["id"], batch["text"], batch["places"]))
        for shard in _sharded(rows):
            out = []
            for doc_id, _, kept, n, gone in shard:
                if gone is not None:
                    kept = " ".join(w for w, g in zip(kept.split(" "), gone) if not g)
                out.append((None if doc_id == _NO_ID else doc_id, n, 0 if gone is None else int(gone.sum()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"], dtype=object)

    return map_frames(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(text: str, gone: np.ndarray) -> str:
    """``text`` without the removed words and the blanks before them."""
    parts, at, spans = [], 0, [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    for s, e in zip(edges[::2], edges[1::2]):
        parts.append(text[at:spans[s - 1][1] if s else spans[0][0]])
        at = spans[e - 1][1]
    return "".join([*parts, text[at:]]).strip(" ")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, the removed words cut out of the texts."""
    key, crc, places = (unused(c, docs.columns) for c in ("passage_id", "passage_crc", "passage_places"))
    found = passages(docs).select(F.col("id").alias(key), F.col("crc").alias(crc), F.col("places").alias(places))
    beside = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), crc: F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    joined, columns = beside.join(found, [key, crc], "left").drop(key, crc), docs.columns

    def run(batches):
        for batch in batches:
            rows = zip(range(len(batch)), batch["text"], batch[places])
            texts = [text if gone is None else _cut(text, gone) for shard in _sharded(rows) for _, text, _, _, gone in shard]
            yield batch.assign(text=texts)[columns]

    out = map_frames(joined, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

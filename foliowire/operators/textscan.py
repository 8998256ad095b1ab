"""Many terms searched in every whole text, in one pass over the texts and without a shuffle of them.

The terms of a task are compiled into dictionaries of words and Aho-Corasick automata. Only (text, term) pairs leave the task. The terms reach the tasks through the driver if they are at most ``TERM_LIMIT``; a larger table
is searched by joins instead (see ``matching``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from foliowire.functions.text import accent_table

#: How a term is searched: as whole words of the comparable text, anywhere in the lower-case text, or there between word boundaries.
WORDS, INSIDE, BOUNDED = 0, 1, 2
#: Terms that are compiled in every task, some 100 bytes for each of their characters.
TERM_LIMIT = 100_000
#: Patterns that are looked up one by one in a text, and the length of substrings so treated; more are searched in one pass.
FEW, SHORT = 200, 3

_WORD = re.compile(r"\w+")


class _Fold(dict):
    """Character codes to what they become without accents; filled as characters occur."""

    def __init__(self):
        super().__init__({ord(c): bare for c, bare in accent_table().items()})

    def __missing__(self, code: int):
        char = chr(code)
        self[code] = "" if unicodedata.category(char) in ("Mn", "Me") else char
        return self[code]


def comparable(lowered: str, fold: _Fold) -> str:
    """The words of ``functions.text.match_text`` in one string with a blank on either side."""
    return f" {' '.join(_WORD.findall(lowered if lowered.isascii() else lowered.translate(fold)))} "


def _joins(text: str, at: int) -> bool:
    """Whether no word begins or ends between the characters before and at a place."""
    def word(k):
        return 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")

    return word(at - 1) == word(at)


class Searcher:
    """Finds the numbers of the terms that occur in a text. ``terms`` are (how, term).

    Terms that are one word are looked up in the set of a text's words, and terms of several words only where all their words are in
    it. Short substrings, which occur often, are looked up one by one; the others are searched together in one pass.
    """

    def __init__(self, terms: list[tuple[int, str]]):
        self.fold, self.words, self.inside, self.bounded = _Fold(), ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton()
        #: the numbers of each pattern of the automata, and its length
        self.patterns: list[tuple[int, list[int]]] = []
        #: terms that are one word of the comparable text, and those that are one of the lower-case text
        self.single: dict[str, list[int]] = {}
        self.whole: dict[str, list[int]] = {}
        #: patterns of several words by the word that fewest of them share, with all their words
        self.rarest: dict[str, list[tuple[int, str, frozenset[str]]]] = {}
        short = {t for how, t in terms if how == INSIDE and t.strip() and len(t) <= SHORT}
        self.short: dict[str, list[int]] = {t: [] for t in short} if len(short) <= FEW else {}
        places: dict[tuple[int, str], int] = {}
        for number, (how, term) in enumerate(terms):
            if not term.strip():
                continue
            one = {WORDS: self.single, BOUNDED: self.whole}.get(how) if _WORD.fullmatch(term) else None
            if one is not None:
                one.setdefault(term, []).append(number)
            elif how == INSIDE and term in self.short:
                self.short[term].append(number)
            else:
                place = places.setdefault((how, f" {term} " if how == WORDS else term), len(self.patterns))
                if place == len(self.patterns):
                    self.patterns.append((len(term), []))
                self.patterns[place][1].append(number)
        for (how, pattern), place in places.items():
            {WORDS: self.words, INSIDE: self.inside, BOUNDED: self.bounded}[how].add_word(pattern, place)
        for automaton in (self.words, self.inside, self.bounded):
            if len(automaton):
                automaton.make_automaton()
        several = [(pattern, place) for (how, pattern), place in places.items() if how == WORDS]
        shared = Counter(word for pattern, _ in several for word in set(pattern.split()))
        for pattern, place in several:
            held = frozenset(pattern.split())
            self.rarest.setdefault(min(held, key=lambda w: (shared[w], w)), []).append((place, pattern, held))

    def _in_words(self, lowered: str, lower_words: list[str]) -> list[int]:
        """The terms searched as whole words of the comparable text."""
        if lowered.isascii():
            words = lower_words
        else:
            words = _WORD.findall(" ".join([t if t.isascii() else t.translate(self.fold) for t in lowered.split()]))
        held = set(words)
        hits = [n for word in self.single.keys() & held for n in self.single[word]]
        likely = [(place, pattern) for word in self.rarest.keys() & held for place, pattern, needed in self.rarest[word] if needed <= held]
        if likely:
            text = f" {' '.join(words)} "
            met = {place for _, place in self.words.iter(text)} if len(likely) > FEW else [place for place, pattern in likely if pattern in text]
            hits += [n for place in met for n in self.patterns[place][1]]
        return hits

    def _between_boundaries(self, lowered: str) -> list[int]:
        """The terms, other than single words, that stand between word boundaries."""
        met = set()
        for end, place in self.bounded.iter(lowered):
            if place not in met and not _joins(lowered, end + 1 - self.patterns[place][0]) and not _joins(lowered, end + 1):
                met.add(place)
        return [n for place in met for n in self.patterns[place][1]]

    def found(self, text: str | None) -> list[int]:
        lowered = (text or "").lower()
        if not lowered:
            return []
        words = _WORD.findall(lowered)
        hits = self._in_words(lowered, words) if self.single or self.rarest else []
        if self.whole:
            hits += [n for word in self.whole.keys() & set(words) for n in self.whole[word]]
        for term, numbers in self.short.items():
            if term in lowered:
                hits += numbers
        if len(self.inside):
            hits += [n for place in {place for _, place in self.inside.iter(lowered)} for n in self.patterns[place][1]]
        if len(self.bounded):
            hits += self._between_boundaries(lowered)
        return sorted(hits)


def small_terms(terms: DataFrame) -> list[tuple[int, int, str]] | None:
    """(kind, how, term) rows of a table of at most TERM_LIMIT rows; None if there are more."""
    rows = terms.select("kind", "how", "term").limit(TERM_LIMIT + 1).collect()
    return None if len(rows) > TERM_LIMIT else sorted(map(tuple, rows))


def scan(docs: DataFrame, terms: list[tuple[int, int, str]], id_col: str, text_col: str) -> DataFrame:
    """(id, kind, term): which of the (kind, how, term) occur in which text, each once a text."""
    schema = StructType([docs.schema[id_col], StructField("kind", IntegerType()), StructField("term", StringType())])
    written = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher([(how, term) for _, how, term in terms])
        for batch in batches:
            rows, numbers = [], []
            for k, text in enumerate(batch.column(1)):
                own = searcher.found(text.as_py())
                rows += [k] * len(own)
                numbers += own
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), [terms[n][0] for n in numbers], [terms[n][2] for n in numbers]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, written)], schema=written)

    return docs.select(id_col, text_col).mapInArrow(run, schema)

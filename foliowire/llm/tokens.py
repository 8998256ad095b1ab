"""Token ids of a public byte-level vocabulary, and their packing into fixed-length rows.

Best-fit decreasing: the pieces of a batch are sorted by length and each goes into the open row with the least
remaining room that holds it, found by descending a segment tree over capacities. Texts longer than a row are split
losslessly. A packed row carries the matrix row of ids, the cumulative segment lengths and the position ids, which
restart at every segment.

Everything happens in one pass without a shuffle: a task streams its documents and packs whenever a fixed number of
tokens has gathered, so memory does not depend on the partition and a lost task is repeated alone.

Defined results: a null text is empty and yields its end token only; rows that repeat a doc_id are packed each on their
own; an empty table gives no row; other columns are ignored. Row numbers depend on the partitions of the input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliowire.llm.common import map_frames

ROW_TOKENS = 2048
#: Tokens a task gathers before it packs.
BATCH_TOKENS = 4 << 20
END_OF_TEXT = 50256

#: The pattern that splits a text before the merges of the byte-level vocabulary (a fixed value of the vocabulary).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Scripts on which every splitting engine agrees: ASCII without control characters but line feed and tab, Latin, Greek, Cyrillic.
_PLAIN = re.compile("[\t\n -~¡-¬®-ſΑ-ΡΣ-ωА-я]*")
_LONG_RUN = re.compile(r"[^ \n\t]{500}")


class Encoder:
    """Ids of the tokenizer file at ``path``.

    Plain texts go through a faster encoder built from the same vocabulary; texts with other characters, very long
    unbroken runs or the string of a special token go through the tokenizer itself. Both give the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, added = content["model"]["vocab"], content.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special) and not _LONG_RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


class RoomTree:
    """Open rows by remaining room; finds the least room that is enough in logarithmic time."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``length``."""
        node = length + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indexes into ``lengths``; no length exceeds the capacity."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        room, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


_SEGMENT = "struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>"
PACKED = f"row_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, segments array<{_SEGMENT}>"


def _packed_rows(pieces: list, first_row: int, capacity: int, pad: int) -> pd.DataFrame:
    out = []
    for k, row in enumerate(best_fit_decreasing([len(p[3]) for p in pieces], capacity)):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0] + [len(p[3]) for p in own])
        ids = np.full(capacity, pad, "<u4")
        ids[:ends[-1]] = np.concatenate([p[3] for p in own])
        positions = np.zeros(capacity, "<u4")
        for p, at in zip(own, ends):
            positions[at:at + len(p[3])] = np.arange(len(p[3]))
        out.append((first_row + k, ids.tobytes(), int(ends[-1]), ends.tolist(), positions.tobytes(),
                    [{"doc_id": p[0], "start": p[1], "length": len(p[3]), "doc_tokens": p[2]} for p in own]))
    return pd.DataFrame(out, columns=["row_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "segments"], dtype=object)


def pack_rows(docs: DataFrame, tokenizer: str, row_tokens: int = ROW_TOKENS, end: int = END_OF_TEXT, pad: int = END_OF_TEXT,
              batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Rows of exactly ``row_tokens`` ids: row_id, ids and position_ids (little-endian unsigned 32-bit), n_tokens
    without padding, cu_seqlens from 0, and the segments (doc_id, start, length, doc_tokens) in row order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row, pieces, gathered = encoder(tokenizer), TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode.ids(text), np.uint32(end))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                pieces += [(doc_id, s, len(ids), ids[s:s + row_tokens]) for s in range(0, len(ids), row_tokens)]
                gathered += len(ids)
                if gathered >= batch_tokens:
                    packed = _packed_rows(pieces, row, row_tokens, pad)
                    row, pieces, gathered = row + len(packed), [], 0
                    yield packed
        if pieces:
            yield _packed_rows(pieces, row, row_tokens, pad)

    return map_frames(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``ids`` of consecutive rows form the id matrix."""
    packed.write.parquet(path)

"""Hierarchical packing into sequences of several lengths.

Documents are routed by token count to context tiers (256, 512, 1024, 2048). Whole windows of the longest tier are cut off long
documents first. Each tier then fills windows of its own length, longest tier first: a window opens with the longest piece of its tier,
takes the best fitting pieces of the shorter tiers, and what room is left is plugged with the head of a shorter piece,
whose tail goes back to its tier. Windows of the longest tier may keep a few tokens of padding instead of a cut; shorter windows are always
exactly full, so they need none. Pieces that cannot fill a window wait for the next batch, and at a task's end they are
packed into windows of the longest tier.

Sequences of a tier leave in step groups of equal token count; within each batch the sequences are dealt so that the
groups also carry similar attention work (sum of squared piece lengths).

One pass without a shuffle: a task streams its documents, holds a bounded number of tokens, and is repeated alone when
an executor is lost.

Defined results: a null text is empty and yields its end token; rows that repeat a doc_id are packed each on their own;
an empty table gives no row; other columns are ignored. Sequence numbers depend on the partitions of the input.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliowire.llm.common import map_frames
from foliowire.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
#: Padding a window of the longest tier may keep instead of cutting a document.
SLACK = 16
#: Tokens a task gathers before it packs.
BATCH_TOKENS = 1 << 20
#: Windows of the longest tier that make a step.
STEP_WINDOWS = 64
END = 1

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, "
          "tier int, step_group long, ids binary")


class TierPacker:
    """Packs pieces (length, serial number) of one task; pieces and windows are lists of (serial number, start, length)."""

    def __init__(self, tiers=TIERS, slack: int = SLACK):
        self.tiers, self.slack = tiers, slack
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), sorted

    def add(self, document: int, length: int) -> list[tuple[int, list]]:
        """Queue a document; returns the full windows cut off it."""
        longest = self.tiers[-1]
        whole = length // longest
        if rest := length - whole * longest:
            insort(self.waiting, (rest, document, whole * longest))
        return [(longest, [(document, k * longest, longest)]) for k in range(whole)]

    def _fill(self, window: int) -> list | None:
        """One window opened by the longest waiting piece of its tier; None if the rest cannot fill it."""
        waiting = self.waiting
        length, document, start = waiting.pop()
        pieces, room = [(document, start, length)], window - length
        while room and waiting:
            k = bisect_right(waiting, (room, float("inf"), 0)) - 1
            if k < 0:
                break
            length, document, start = waiting.pop(k)
            pieces.append((document, start, length))
            room -= length
        if room > (self.slack if window == self.tiers[-1] else 0):
            if not waiting:
                for document, start, length in pieces:
                    insort(waiting, (length, document, start))
                return None
            length, document, start = waiting.pop(0)  # the shortest; every waiting piece is longer than the room
            pieces.append((document, start, room))
            insort(waiting, (length - room, document, start + room))
        return pieces

    def pack(self) -> list[tuple[int, list]]:
        """Windows (tier, pieces) from what waits; what cannot fill a window goes on waiting."""
        out = []
        for window, shorter in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
            while self.waiting and self.waiting[-1][0] > shorter:
                pieces = self._fill(window)
                if pieces is None:
                    return out
                out.append((window, pieces))
        return out

    def rest(self) -> list[tuple[int, list]]:
        """The remaining pieces in windows of the longest tier, the last of which is padded."""
        out = self.pack()
        room, pieces = self.tiers[-1], []
        while self.waiting:
            length, document, start = self.waiting.pop()
            fits = min(length, room)
            pieces.append((document, start, fits))
            room -= fits
            if length > fits:
                insort(self.waiting, (length - fits, document, start + fits))
            if not room:
                out.append((self.tiers[-1], pieces))
                room, pieces = self.tiers[-1], []
        return out + [(self.tiers[-1], pieces)] * bool(pieces)


def step_groups(windows: list[list], size: int) -> list[list[list]]:
    """Deal windows into full groups of ``size`` with similar attention work, in turn forth and back."""
    groups: list[list[list]] = [[] for _ in range(len(windows) // size)]
    if groups:
        for k, window in enumerate(sorted(windows, key=lambda w: -sum(p[2] ** 2 for p in w))):
            lap, at = divmod(k, len(groups))
            groups[-1 - at if lap % 2 else at].append(window)
    return groups


def pack_tiers(docs: DataFrame, tokenizer: str, tiers: tuple = TIERS, end: int = END, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian unsigned 32-bit).

    sequence_length is the padded length: the longest tier, or a power of two where the sequence is exactly as long.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 33
        encode, packer, held = encoder(tokenizer), TierPacker(tiers), {}
        ready: dict[int, list] = {t: [] for t in tiers}
        left: dict[int, int] = {}  # tokens of each held document that are not in a sequence yet
        serial = sequences = groups = gathered = 0

        def emitted(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal sequences, groups
            rows = []
            for tier in tiers:
                size = STEP_WINDOWS * tiers[-1] // tier
                windows = ready[tier]
                full = len(windows) // size * size
                dealt = step_groups(windows[:full], size) + ([windows[full:]] if last and windows[full:] else [])
                ready[tier] = [] if last else windows[full:]
                for group in dealt:
                    for window in group:
                        total, offset = sum(p[2] for p in window), 0
                        padded = total if total & (total - 1) == 0 else tiers[-1]
                        for document, start, length in window:
                            doc_id, ids = held[document]
                            rows.append((doc_id, start, length, len(ids), task + sequences, offset, padded, tier, task + groups,
                                         ids[start:start + length].tobytes()))
                            offset += length
                            left[document] -= length
                            if not left[document]:
                                del held[document], left[document]
                        sequences += 1
                    groups += 1
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")], dtype=object)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode.ids(text), np.uint32(end)).astype("<u4")
                held[serial], left[serial] = (None if pd.isna(doc_id) else int(doc_id), ids), len(ids)
                for tier, window in packer.add(serial, len(ids)):
                    ready[tier].append(window)
                serial, gathered = serial + 1, gathered + len(ids)
                if gathered >= batch_tokens:
                    for tier, window in packer.pack():
                        ready[tier].append(window)
                    gathered = 0
                    yield from emitted(False)
        for tier, window in packer.rest():
            ready[tier].append(window)
        yield from emitted(True)

    return map_frames(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, PIECES)

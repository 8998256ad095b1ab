import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from conftest_llm import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliowire.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
TEXTS = ["", None, "a", " \n\t x  y", "It's they'LL 'd 12,345.67 # $$ <|endoftext|> end", "naïve façade Straße Ñandú ÀÉ", "Привет мир", "日本語 🙂👩‍👩‍👧 ﷽",
         "x\x1cy\x85z w v\r\n", "a" * 3000, "é" * 700, "ab " * 4000, "́̀a", prose(1, 3000), "\n\n\n   \n", "Ⅷ ² ½ ٣", "Ǆ ȺͿ ſ"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_those_of_the_tokenizer(text):
    assert tokens.encoder(PATH).ids(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


def test_ids_of_hard_texts():
    for text in TEXTS:
        assert tokens.encoder(PATH).ids(text).tolist() == EXACT.encode(text or "", add_special_tokens=False).ids


def test_best_fit_takes_the_least_room_that_is_enough():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    rooms, expected = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [r for r, room in enumerate(rooms) if room >= lengths[i]]
        least = min((rooms[r] for r in fits), default=None)
        if least is None:
            rooms.append(100 - lengths[i])
        else:
            # among rows of equal room any may be taken
            rooms[next(r for r in fits if rooms[r] == least)] -= lengths[i]
        expected = sorted(rooms)
    rows = tokens.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in r) for r in rows) == expected
    assert sorted(i for r in rows for i in r) == list(range(500))


def rows_of_docs():
    return [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")] + [(100 + k, prose(k, 10 + k * 13 % 700)) for k in range(150)]


def ids_by_doc(end):
    out = {}
    for doc_id, text in rows_of_docs():
        out.setdefault(doc_id, []).append([*EXACT.encode(text or "", add_special_tokens=False).ids, end])
    return out


def test_packed_rows_give_back_all_ids(spark, documents):
    packed = tokens.pack_rows(documents(rows_of_docs()), PATH, row_tokens=512, batch_tokens=20_000).collect()
    pieces = {}
    for r in packed:
        ids, positions = (np.frombuffer(b, "<u4") for b in (r.ids, r.position_ids))
        assert len(ids) == len(positions) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens:] == tokens.END_OF_TEXT).all()
        for seg, s, e in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[s:e].tolist() == list(range(e - s)) and seg.length == e - s
            pieces.setdefault((seg.doc_id, seg.doc_tokens), []).append((seg.start, ids[s:e].tolist()))
    for doc_id, texts in ids_by_doc(tokens.END_OF_TEXT).items():
        for n in {len(t) for t in texts}:
            same = [t for t in texts if len(t) == n]
            got = sorted(pieces[doc_id, n])
            if len(same) == 1:
                assert [i for _, p in got for i in p] == same[0]
            else:
                assert sorted(i for _, p in got for i in p) == sorted(i for t in same for i in t)
    assert sum(r.n_tokens for r in packed) > 0.9 * 512 * len(packed)


@pytest.mark.parametrize("batch_tokens", [1, 5_000, 1 << 20])
def test_sequences_hold_every_id_once(spark, documents, batch_tokens):
    rows = packing.pack_tiers(documents(rows_of_docs()), PATH, batch_tokens=batch_tokens).collect()
    expected = {d: sorted(map(tuple, t)) for d, t in ids_by_doc(packing.END).items()}
    sequences, texts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert len(r.ids) == 4 * r.length
    for (doc_id, n), pieces in texts.items():
        joined = [i for _, p in sorted(pieces) for i in p]
        same = [t for t in expected[doc_id] if len(t) == n]
        assert sorted(joined) == sorted(i for t in same for i in t)
        if len(same) == 1:
            assert tuple(joined) == same[0]
    assert sum(len(t) for ts in expected.values() for t in ts) == sum(r.length for r in rows)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and pieces[0].sequence_length == (at if at & (at - 1) == 0 else 2048)
    padded = sum(p[0].sequence_length for p in sequences.values())
    assert sum(r.length for r in rows) > 0.9 * padded or batch_tokens == 1
    assert zlib.crc32(rows[0].ids) >= 0


def test_short_tiers_are_full_and_steps_balanced():
    packer = packing.TierPacker()
    rng = random.Random(2)
    out = [w for k in range(3000) for w in packer.add(k, rng.randrange(1, 900))] + packer.pack()
    assert all(sum(p[2] for p in w) == t for t, w in out if t < 2048)
    assert all(sum(p[2] for p in w) >= 2048 - packing.SLACK for t, w in out if t == 2048)
    work = lambda ws: sum(p[2] ** 2 for w in ws for p in w)
    windows = [w for t, w in out if t == 1024]
    groups = packing.step_groups(windows[:len(windows) // 50 * 50], 50)
    assert len(groups) > 2 and max(map(work, groups)) < 1.05 * min(map(work, groups)) and {len(g) for g in groups} == {50}


def test_empty_table(spark, documents):
    assert tokens.pack_rows(documents([]), PATH).count() == 0 == packing.pack_tiers(documents([]), PATH).count()

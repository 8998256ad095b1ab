"""Identifiers and other whole numbers come back exactly beside nulls, through every operator and stage."""

from collections import Counter

import public_tokenizers
import pytest
from conftest_llm import prose

from foliowire.llm import bagclassifier, minhash, mixing, packing, quality, recurrent, substrings, tokens
from foliowire.llm.common import map_frames

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**60
IDS = [BIG + 1, None, BIG, 3, -BIG - 1, None]


@pytest.fixture(scope="module")
def docs(spark):
    """One batch with large identifiers beside nulls, other whole numbers likewise."""
    rows = [(i, prose(k, 90), "en", "a", None if k == 2 else BIG + 3 + k, None if k == 1 else BIG + 5 + k, [k, None]) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more long, list array<int>").coalesce(1)


def ids(df, column="doc_id"):
    return Counter(r[column] for r in df.select(column).collect())


def model():
    built = bagclassifier.BagModel()
    built.constant = 0.5
    return built


@pytest.mark.parametrize("run", [
    quality.verdicts, minhash.near_duplicates, substrings.removals, recurrent.scores, mixing.taken, lambda d: bagclassifier.scored(d, model()),
    quality.keep_good, minhash.keep_one, substrings.without_repeats], ids=lambda f: f.__name__)
def test_ids_are_exact(docs, run):
    assert ids(run(docs)) == Counter(IDS)


def test_ids_of_pieces_are_exact(docs):
    assert set(ids(packing.pack_tiers(docs, TOKENIZER))) == set(IDS)
    assert {s["doc_id"] for r in tokens.pack_rows(docs, TOKENIZER).collect() for s in r.segments} == set(IDS)
    assert set(ids(mixing.mixed_documents(docs))) == set(IDS)


@pytest.mark.parametrize("stage", [quality.keep_good, minhash.keep_one, substrings.without_repeats, mixing.mixed_documents], ids=lambda f: f.__name__)
def test_other_columns_are_exact(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {(r.doc_id, r.more, tuple(r.list)) for r in out.collect()}
    assert got == {(r.doc_id, r.more, tuple(r.list)) for r in docs.collect()}
    if stage in (quality.keep_good, minhash.keep_one):
        assert {r.n_chars for r in out.collect()} == {r.n_chars for r in docs.collect()}


def test_neighbouring_ids_are_different_nodes(spark):
    """Two documents whose identifiers meet in floating point stay two components."""
    rows = [(BIG + 1, prose(1, 80)), (BIG, prose(2, 80)), (None, prose(3, 80)), (BIG + 2, prose(2, 80))]
    docs = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string").coalesce(1)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(BIG + 1, BIG + 1, True), (BIG, BIG, True), (BIG + 2, BIG, False), (None, None, True)}


def test_many_kinds_of_columns_pass(spark):
    df = spark.sql("""select * from values
      (1Y, 2S, 3, 4L, 1.5F, 2.5D, cast(1.25 as decimal(10,2)), true, 'x', cast('y' as binary), date'2024-01-02', timestamp'2024-01-02 03:04:05',
       array(1L, null), named_struct('a', 1L, 'b', 'z'), map('k', 5L)),
      (null, null, null, null, null, null, null, null, null, null, null, null, null, null, null)""").coalesce(1)
    out = map_frames(df, lambda batches: batches, df.schema)
    assert Counter(map(str, out.collect())) == Counter(map(str, df.collect()))

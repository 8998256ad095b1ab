import os

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import prose
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from foliowire.llm import minhash, mixing, quality, substrings

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_take_effect_one_after_the_other(spark, documents, tmp_path):
    base = prose(1, 300, 9000)
    passage = prose(2, 60, 9000)
    rows = [(k, prose(100 + k, 120, 9000), "en", "ab"[k % 2]) for k in range(160)]
    rows += [(200 + k, f"{base} tail{k}", "en", "a") for k in range(5)] + [(300 + k, f"{prose(300 + k, 90, 9000)} {passage}", "en", "b") for k in range(4)]
    rows += [(400, "too short", "en", "a"), (401, prose(5, 90).upper() + " !!", "en", "a"), (402, None, None, None), (403, "", "en", "b")]
    docs, frames = documents(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frames[name] = docs = spark.read.parquet(str(tmp_path / name))
    ids = {name: {r.doc_id for r in f.select("doc_id").collect()} for name, f in frames.items()}
    columns = documents(rows).columns
    assert all(f.columns == columns for name, f in frames.items() if name != "packing")
    assert ids["quality rules"] == {r[0] for r in rows} - {400, 401, 402, 403}
    assert ids["near duplicates"] == ids["quality rules"] - {201, 202, 203, 204} == ids["repeated passages"]
    assert not any(passage[:100] in r.text for r in frames["repeated passages"].collect())
    mixed = frames["source mix"].collect()
    assert sum(len(mixing.WORD.findall(r.text)) for r in mixed) == pytest.approx(
        sum(len(mixing.WORD.findall(r.text)) for r in frames["repeated passages"].collect()), rel=0.02)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(i for r in mixed for i in [*exact.encode(r.text, add_special_tokens=False).ids, 1])
    assert sorted(int(i) for r in frames["packing"].collect() for i in np.frombuffer(r.ids, "<u4")) == expected


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rest = substrings.without_repeats(minhash.keep_one(quality.keep_good(docs)))
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sum(len(exact.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixing.mixed_documents(rest).collect())
    assert sum(r.length for r in out.select("length").collect()) == expected


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def through(spark, docs, path):
    """The rows after each stage, every stage over the written rows of the one before."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        yield name, docs


def test_empty_tables_pass_all_stages(spark, documents, tmp_path):
    assert all(out.count() == 0 for _, out in through(spark, documents([]), str(tmp_path / "none")))
    rejected = documents([(1, None), (None, ""), (2, "too short"), (3, "a " * 400)])
    assert all(out.count() == 0 for _, out in through(spark, rejected, str(tmp_path / "rejected")))
    assert minhash.keep_one(documents([])).count() == 0


def test_awkward_rows_pass_all_stages(spark, documents, tmp_path):
    long, text = prose(1, 120_000, 50_000), prose(2, 150, 9000)
    rows = [(2**60 + 1, long, None, None), (None, prose(3, 150, 9000), "en", None), (5, text, "en", "a"), (5, text, "en", "a"), (6, text, "en", "b"),
            (7, prose(4, 150, 9000), None, "a"), (8, None, "en", "a")]
    got = dict(through(spark, documents(rows), str(tmp_path / "some")))
    ids = {name: sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect()) for name, out in got.items()}
    assert ids["quality rules"] == sorted(map(str, [2**60 + 1, None, 5, 6, 7]))
    assert ids["near duplicates"] == sorted(map(str, [2**60 + 1, None, 5, 7]))  # the rows that repeat an id stay together
    assert got["near duplicates"].where("doc_id = 5").count() == 2
    left = {r.doc_id: len(r.text.split()) for r in got["repeated passages"].collect()}
    assert left[2**60 + 1] == 120_000 and left[None] == 150 and left.get(5, 0) == 0  # the two rows repeat each other
    pieces = got["packing"].where(f"doc_id = {2**60 + 1}").collect()
    assert sum(p.length for p in pieces) >= 120_000


"""Near-duplicate documents by MinHash.

A document is the set of its distinct word shingles. Universal hash functions give its signature of minima; bands of
consecutive minima put similar documents into common buckets. Pairs from buckets are first compared by their
signatures, those that may reach the similarity by their full shingle sets, and links form components.

Copies and crowds. Equal texts are one node. A bucket never emits its pairs: first every member is compared with the
least member of its bucket, then with a pseudorandom one, and members already in one component need no further comparison. Only for what
is still apart do tasks compare signatures inside a bucket, block by block where it is large. Documents that may be
linked form crowds, whose full sets are compared in blocks by matrix products. Both steps report a spanning forest, at most one
edge per document and task, instead of pairs. All links therefore take part in the components, and what is
shuffled grows with the number of documents.

With 24 bands of 4 minima a pair of similarity 0.8 shares no bucket with probability 3e-6; the signature check (96 minima,
at least 0.62 of them equal) misses it with probability 1e-5. Shingles and texts are identified by 64- and 128-bit hashes.

Defined results: documents without words or text are empty and linked with nothing; so are rows without doc_id; rows that
repeat a doc_id are one node, whatever their texts; an empty table gives an empty result; other columns are ignored
by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import lower_ascii, map_frames, materialise, split_words, unused
from foliowire.llm.components import components, least_reachable

SHINGLE_WORDS = 4
BANDS, ROWS = 24, 4
#: Similarity in percent.
PERCENT = 80
#: Share of equal minima below which a pair cannot reach the similarity, but for the probability above.
SIGNATURE_SHARE = 0.62
#: Members of a bucket that one task compares with each other.
BLOCK = 512
#: Pairs of one document that one task confirms.
CHUNK = 128


_FACTORS, _OFFSETS = np.random.default_rng(7).integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS |= np.uint32(1)


def words_of(text: str | None) -> list[str]:
    return split_words(lower_ascii(text)) if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of k consecutive words, sorted; of the whole sequence where it is shorter."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = _spread(total * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n])
    return np.unique(total)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function a * x + b modulo 2^32 over the set; pieces keep the work in cache."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(x), 512):
        values = _FACTORS * x[None, s:s + 512]
        values += _OFFSETS
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _text_digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest, set size and signature of every text."""
    hashes = WordHashes()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            if not (words := words_of(text)):
                out.append((doc_id, None, 0, None))
                continue
            s = shingles(hashes.of(words))
            out.append((doc_id, _text_digest(words), len(s), signature(s).astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "digest", "n_shingles", "signature"], dtype=object)


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document and band with the hash of the band's minima."""
    for batch in batches:
        if not len(batch):
            continue
        table = np.frombuffer(b"".join(batch["signature"]), "<u4").reshape(len(batch), BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, r])
        yield pd.DataFrame({"bucket": key.view(np.int64).ravel(), "node": np.repeat(batch["node"].to_numpy(), BANDS)})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(len(batch), -1) for c in ("sa", "sb"))
            yield batch.loc[(a == b).mean(axis=1) >= SIGNATURE_SHARE, ["u", "v"]]


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The low byte of every minimum: enough to compare many signatures quickly."""
    for batch in batches:
        if len(batch):
            low = np.frombuffer(b"".join(batch["signature"]), "<u4").reshape(len(batch), -1).astype(np.uint8)
            yield pd.DataFrame({"node": batch["node"], "short": [x.tobytes() for x in low]})


def _blocks_of(part: pd.DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """The block pairs that a task holds."""
    part = part.sort_values([key, "low", "high", "node"], kind="stable")
    keys = part[[key, "low", "high"]].to_numpy()
    borders = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    for s, e in zip(borders, [*borders[1:], len(part)]):
        if e - s > 1:
            yield part.iloc[s:e]


def _apart(rows: pd.DataFrame) -> np.ndarray:
    """Which pairs are to be compared here: of different components and, between two blocks, one from each."""
    comp, block = rows["component"].to_numpy(), rows["block"].to_numpy()
    apart = comp[:, None] != comp[None, :]
    return apart if rows["low"].iat[0] == rows["high"].iat[0] else apart & (block[:, None] != block[None, :])


def _roots(rows: pd.DataFrame, related: np.ndarray) -> pd.DataFrame:
    """Edges that connect what the symmetric relation connects, one per row at most."""
    at = np.flatnonzero(related.any(axis=1))
    node = rows["node"].to_numpy()[at]
    return pd.DataFrame({"u": node, "v": node[least_reachable(related[np.ix_(at, at)])]})


_NO_EDGE = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})


def _possible(part: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect documents of different components whose signatures agree often enough."""
    found = [_NO_EDGE]
    for rows in _blocks_of(part, "bucket"):
        related = _apart(rows)
        if related.any():
            short = np.frombuffer(b"".join(rows["short"]), np.uint8).reshape(len(rows), -1)
            for s in range(0, len(rows), 64):
                same = (short[s:s + 64, None, :] == short[None, :, :]).sum(axis=2)
                related[s:s + 64] &= same >= SIGNATURE_SHARE * short.shape[1]
            found.append(_roots(rows, related))
    return pd.concat(found)


def _linked(part: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect documents of different components whose full sets are similar enough."""
    found = [_NO_EDGE]
    for rows in _blocks_of(part, "crowd"):
        related = _apart(rows)
        if not related.any():
            continue
        sets = [np.frombuffer(m, "<u8") for m in rows["members"]]
        sizes = np.array([len(m) for m in sets])
        values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # only shingles of several documents count; they are numbered anew
        number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[where]
        owner = np.repeat(np.arange(len(sets)), sizes)[number >= 0]
        number = number[number >= 0]
        common = np.zeros((len(sets), len(sets)))
        for s in range(0, int(number.max(initial=-1)) + 1, 16384):
            own = (number >= s) & (number < s + 16384)
            table = np.zeros((len(sets), 16384), np.float32)
            table[owner[own], number[own] - s] = 1
            common += table @ table.T
        related &= 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
        if related.any():
            found.append(_roots(rows, related))
    return pd.concat(found)


def _dealt(rows: DataFrame, key: str, block: int, task_rows: int) -> DataFrame:
    """Rows with ``key`` and the size ``m`` of its group, dealt in pairs of blocks to tasks of bounded size."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    pairs = (rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("m")
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other"))
    tasks = pairs.count() // task_rows + 1
    return pairs.withColumn("task", F.pmod(F.xxhash64(key, "low", "high"), F.lit(tasks)))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "members": [shingles(hashes.of(words_of(t))).astype("<u8").tobytes() for t in batch["text"]]})


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = []
        for a, b in zip(batch["ma"], batch["mb"]):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * common >= PERCENT * (len(a) + len(b) - common))
        yield batch.loc[np.array(good, bool), ["u", "v"]]


def _links(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the candidate pairs (u, v) whose shingle sets are similar enough."""
    pairs = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, right = (signatures.select(F.col("node").alias(n), F.col("signature").alias(s)) for n, s in (("u", "sa"), ("v", "sb")))
    pairs = materialise(pairs.join(left, "u").join(right, "v").mapInPandas(_alike, "u long, v long"), "minhash-pairs")
    # the set of a document with very many partners is repeated once per chunk of them, not once per partner
    partners = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = pairs.join(partners, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk"))
    left = chunked.select("u", "chunk").distinct().join(sets.toDF("u", "ma"), "u")
    right = chunked.join(sets.toDF("v", "mb"), "v")
    return materialise(right.join(left, ["u", "chunk"]).select("u", "v", "ma", "mb").mapInPandas(_confirmed, "u long, v long"), "minhash-links")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select(F.col("id").alias("node"), "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = materialise(map_frames(slim, _sized, "doc_id long, digest binary, n_shingles long, signature binary"), "minhash-sized")
    known = sized.where("doc_id is not null and digest is not null")
    # equal texts become one node, named by their least doc_id; all share one signature
    nodes = materialise(known.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("a")).select(
        "digest", F.col("a.doc_id").alias("node"), F.col("a.signature").alias("signature")), "minhash-nodes")
    copies = known.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").where("doc_id != node").select("doc_id", "node")
    signatures = nodes.select("node", "signature")
    texts = slim.withColumnRenamed("doc_id", "node").where("node is not null and text is not null")
    banded = signatures.mapInPandas(_banded, "bucket long, node long").distinct()
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first"),
                                         F.max(F.struct(F.xxhash64("node"), "node")).alias("any"))
    crowded = materialise(banded.join(sizes.where("n > 1").select("bucket", "n", "first", F.col("any.node").alias("any")), "bucket"), "minhash-buckets")
    links = materialise(copies.toDF("u", "v"), "minhash-copies")
    stars = crowded.select(F.col("node").alias("u"), F.col("first").alias("v")).union(crowded.select("node", "any"))
    # the shingle sets of all documents that share a bucket with another; the texts are shuffled once, at any size alike
    sets = materialise(texts.join(crowded.select("node").distinct().hint("merge"), "node").mapInPandas(_sets, "node long, members binary"), "minhash-sets")
    links = links.union(_links(stars, signatures, sets))
    found = components(links)
    # buckets that still hold several components
    placed = materialise(_with_component(crowded.select("bucket", "n", "node"), found), "minhash-placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"),
                                         F.count("*").alias("m")).where("least != most").select("bucket", "m")
    short = signatures.mapInPandas(_short, "node long, short binary")
    apart = materialise(placed.select("bucket", "node", "component").join(mixed, "bucket"), "minhash-apart")
    possible = materialise(_dealt(apart, "bucket", BLOCK, 40_000).join(short, "node").groupBy("task").applyInPandas(
        _possible, "u long, v long"), "minhash-possible")
    # documents connected by possible links form crowds, within which full sets are compared
    crowds = materialise(components(possible).select(F.col("id").alias("node"), F.col("component").alias("crowd")), "minhash-crowds")
    sizes = crowds.groupBy("crowd").agg(F.count("*").alias("m"))
    members = materialise(_with_component(crowds, found).join(sizes, "crowd"), "minhash-members")
    more = materialise(_dealt(members, "crowd", BLOCK // 2, 4_000).join(sets, "node").groupBy("task").applyInPandas(
        _linked, "u long, v long"), "minhash-more-links")
    found = components(links.union(more))
    rows = sized.select(F.col("doc_id").alias("node"), "n_shingles")
    return _with_component(rows, found).select(
        F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("node") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component those of its least doc_id."""
    gone = unused("gone_id", docs.columns)
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    dropped = materialise(dropped, "minhash-dropped")
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")

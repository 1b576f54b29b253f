"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct five-word shingles, as 64-bit hashes.  512 minima are taken
per set; the low four bits of each are kept and packed into 256 bytes, and 192 of the whole
minima make 32 band keys of six.  Sets that agree are one class with one representative.
Representatives that share a band key are candidates; how often their packed signatures agree,
corrected for chance agreement (1/16), estimates their similarity, and only pairs within four
standard errors of the threshold are confirmed, on full sets.

Two sets at similarity 0.85 share no band with probability (1 - 0.85**6) ** 32 < 3e-7, and are
estimated four standard errors low with about 3e-5.

Nobody compares all pairs of a bucket first.  Two rounds match every document with the most
similar of its buckets' leaders (each bucket draws one by hash) and join what is confirmed.  Then
only pairs of *different* components are left to decide; buckets that still hold several are
compared in blocks of bounded size within a task, and a pair leaves the task at the first band it
shares, if its estimate passes.  So no link between different components is lost, and copies of
one text, however many, never leave their class.

Edge cases: texts without a word (or null) have an empty set and stand alone; with fewer than
five words the whole sequence is the one shingle; a null doc_id is linked with nothing, has a null
component and is kept; rows that repeat share a class; rows that share a doc_id and represent a
class each count as one node; an empty table gives an empty result; other columns are ignored
(kept by :func:`one_of_each`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import prepare, store, table
from nightledger.llm.components import components

WORDS_PER_SHINGLE = 5
HASHES, BITS = 512, 4
BANDS, ROWS = 32, 6
THRESHOLD = 85
STANDARD_ERRORS = 4.0
#: Members of a bucket compared at once; larger buckets are split into pairs of blocks.
BLOCK = 1_500
CHUNK = 1_024
CACHED_WORDS = 200_000

_draws = np.random.default_rng(20_240_817)
FACTORS = (_draws.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
SHIFTS = _draws.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
PLACES = _draws.integers(0, 1 << 63, WORDS_PER_SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_PLACES = _draws.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text, cache: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lowered, words split at ASCII space."""
    if not isinstance(text, str):
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS_PER_SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array([cache[w] for w in words], np.uint64)
    n = len(h) - WORDS_PER_SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS_PER_SHINGLE):
        total += h[i : i + n] * PLACES[i]
    return np.unique(_mixed(total))


def minima(found: np.ndarray) -> np.ndarray:
    x = _mixed(found).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), CHUNK):
        np.minimum(out, (FACTORS * x[at : at + CHUNK] + SHIFTS).min(axis=1), out=out)
    return out


def packed(low: np.ndarray) -> bytes:
    nibbles = (low & np.uint32(15)).astype(np.uint8)
    return (nibbles[::2] << 4 | nibbles[1::2]).tobytes()


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (arrays of uint64 words), by bit counts."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    d &= np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(d).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    """The estimate that a pair at the threshold misses with four standard errors."""
    chance = 1 / (1 << BITS)
    e = chance + (1 - chance) * threshold / 100
    return threshold / 100 - STANDARD_ERRORS * float(np.sqrt(e * (1 - e) / HASHES)) / (1 - chance)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordHashes()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingles(text, cache)
            if not len(found):
                rows.append((0, None, None, None))
                continue
            low = minima(found)
            bands = _mixed((low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * BAND_PLACES).sum(axis=1, dtype=np.uint64))
            rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), packed(low), bands.view(np.int64)))
        out = pd.DataFrame(rows, columns=["n", "cls", "sig", "bands"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, set size n, class, packed signature and band keys of every row, written once."""
    prepare(documents.sparkSession)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(plain.mapInPandas(_sign, "doc_id long, n long, cls binary, sig binary, bands array<long>"), "signed")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordHashes()
    for batch in batches:
        yield pd.DataFrame({"id": batch["doc_id"], "items": [shingles(t, cache).view(np.int64) for t in batch["text"]]})


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "estimate": agreement(x, y)})


def _compared(threshold: int, least: float):
    """Compares what arrives sorted by (bucket, p, q): pairs of different components, in blocks."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        rows = rows.drop_duplicates(["id", "sig"])
        ids, n, root, blk = (rows[c].to_numpy() for c in ("id", "n", "root", "blk"))
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(len(rows), -1)
        bands, band = np.array(rows["bands"].tolist(), np.int64), int(rows["band"].iloc[0])
        first = np.nonzero(blk == p)[0]
        second = first if p == q else np.nonzero(blk == q)[0]
        found_a, found_b = [], []
        for i in first:
            others = second[second > i] if p == q else second
            near = (root[others] != root[i]) & (100 * np.minimum(n[others], n[i]) >= threshold * np.maximum(n[others], n[i]))
            others = others[near]
            if not len(others):
                continue
            others = others[agreement(sig[others], sig[i]) >= least]
            if band and len(others):
                others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            found_a += [ids[i]] * len(others)
            found_b += ids[others].tolist()
        return pd.DataFrame({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            group = (held[["key", "p", "q"]] != held[["key", "p", "q"]].shift()).any(axis=1).cumsum().to_numpy()
            whole = group < group[-1]
            if whole.any():
                yield pd.concat([pairs(g) for _, g in held[whole].groupby(group[whole], sort=False)], ignore_index=True)
                held = held[~whole]
        if held is not None:
            yield pairs(held)

    return run


class Linker:
    """The state of one search: nodes, their crowded buckets, sets and links so far."""

    def __init__(self, documents: DataFrame, rows: DataFrame, threshold: int):
        self.threshold, self.least = threshold, least_estimate(threshold)
        own = rows.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = store(own.groupBy("cls").agg(F.min("doc_id").alias("id")), "classes")
        nodes = own.join(self.classes.withColumnRenamed("id", "doc_id"), ["cls", "doc_id"]).dropDuplicates(["doc_id", "cls"])
        self.nodes = store(nodes.select(F.col("doc_id").alias("id"), "n", "sig", "bands"), "nodes")
        banded = self.nodes.select("id", "n", F.posexplode("bands").alias("band", "value"))
        banded = banded.select("id", "n", "band", F.xxhash64("band", "value").alias("key"))
        turn = F.xxhash64("key", "id")
        crowds = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(turn).alias("lead")).where("c > 1")
        self.crowded = store(banded.join(crowds, "key").withColumn("lead", F.col("lead") == turn), "crowded")
        ids = self.crowded.select(F.col("id").alias("doc_id")).distinct()
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
        self.sets = store(texts.mapInPandas(_sets, "id long, items array<long>"), "sets")
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def stars(self) -> DataFrame:
        """Estimates of members with the leaders of their buckets: a (leader), b, estimate."""
        leaders = self.crowded.where("lead").select("key", F.col("id").alias("a"), F.col("n").alias("m"))
        pairs = leaders.join(self.crowded.select("key", F.col("id").alias("b"), "n"), "key")
        fits = 100 * F.least("n", "m") >= self.threshold * F.greatest("n", "m")
        pairs = pairs.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
        pairs = pairs.join(self.nodes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        pairs = pairs.join(self.nodes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return store(pairs.mapInPandas(_estimated, "a long, b long, estimate double").where(F.col("estimate") >= self.least), "stars")

    def rooted(self, pairs: DataFrame, *sides: str) -> DataFrame:
        """``pairs`` with the root of each side, ``root_<side>``."""
        for side in sides:
            if self.roots is None:
                pairs = pairs.withColumn(f"root_{side}", F.col(side))
            else:
                roots = self.roots.select(F.col("id").alias(side), F.col("root").alias("r"))
                pairs = pairs.join(roots, side, "left").withColumn(f"root_{side}", F.coalesce("r", side)).drop("r")
        return pairs

    def confirm(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b) on full sets, keep the links and join the components."""
        sets = self.sets
        pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        found = store(pairs.where(100 * common >= self.threshold * union).select("a", "b").distinct(), "links")
        self.links = found if self.links is None else self.links.union(found)
        self.roots = components(self.links)

    def best(self, stars: DataFrame) -> DataFrame:
        """For every member its most similar leader in another component."""
        apart = self.rooted(stars, "a", "b").where("root_a <> root_b")
        rank = F.struct("estimate", F.xxhash64("a", "b"))
        return apart.groupBy("b").agg(F.max_by("a", rank).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def rest(self) -> DataFrame:
        """Pairs of different components that share a bucket and pass the estimate."""
        members = self.rooted(self.crowded.select("key", "id", "n", "band", "c"), "id").withColumnRenamed("root_id", "root")
        mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = members.join(mixed, "key").join(self.nodes.select("id", "sig", "bands"), "id")
        blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
        members = members.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        members = members.select("key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "id", "n", "root", "band", "sig", "bands")
        ordered = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
        return ordered.mapInPandas(_compared(self.threshold, self.least), "a long, b long").distinct()


def linked(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = signed(documents)
    work = Linker(documents, rows, threshold)
    stars = work.stars()
    for _ in range(2):
        work.confirm(work.best(stars))
    work.confirm(store(work.rest(), "rest"))
    least = work.roots.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = work.rooted(work.classes, "id").join(least.withColumnRenamed("root", "root_id"), "root_id", "left")
    of_class = of_class.select("cls", F.coalesce("component_id", "id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their own columns; of rows with one doc_id, one."""
    keys = linked(documents, threshold).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = documents.join(keys, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*documents.columns)
    return named.unionByName(documents.where("doc_id IS NULL"))


def without_copies(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns.

    A row is told by its id or, where an id repeats or is missing, by id and text: different texts
    under one id are different documents, and copies without an id go like any others.  Texts
    without words are linked with nothing and stay, but rows equal in id and text count once.
    """
    many = documents.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 AND doc_id IS NOT NULL")
    marked = documents.join(many, "doc_id", "left")
    told = F.col("doc_id").isNotNull() & F.col("_rows").isNull()
    by_text = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    marked = marked.withColumn("_row", F.when(told, F.col("doc_id").cast("long")).otherwise(by_text))
    found = linked(marked.select(F.col("_row").alias("doc_id"), "text"), threshold)
    keys = found.where("kept").select(F.col("doc_id").alias("_row")).distinct()
    return marked.join(keys, "_row", "left_semi").dropDuplicates(["_row"]).select(*documents.columns)


def query(spark, folder):
    """Near-duplicates of all documents at similarity 0.85."""
    return linked(table(spark, folder, "documents"))


#: The same links by joining shingle lists; each round of ``reach`` follows one more link.
SQL = r"""
WITH RECURSIVE read_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS h1, md5_number_lower(s) AS h2 FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM read_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of c USING (doc_id)
"""

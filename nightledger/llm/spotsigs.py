"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

An anchor is one of the commonest words of a language; its signature is the anchor with the next
``CHAIN`` content words (common words skipped), hashed to 32 bits.  A fingerprint is the sorted
set of signatures, written as text (base64 of little-endian values), so two fingerprints can be
compared without their texts.  A text without anchors takes its word triples instead, one
without words its characters as a whole.

:func:`compared` sets every document against an edited form of itself and against the next
document in descending id.  Texts are shuffled once, compressed, into id ranges; a task walks
its range with the row before in hand, and the first and last row of each range are matched in a
second, small step: one row per task.

:func:`near_pairs` finds similar fingerprints: sets are partitioned by length, so that only sets
whose lengths allow the similarity meet, candidates share one of their rarest signatures, and the
Jaccard comparison is pruned by length first.

Edge cases: a null text is empty; the empty set is like another empty set (1) and unlike any
other (0); equal ids are ordered by a hash of their text; a null id comes last; a single document
is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightledger.llm.common import prepare, store, table

CHAIN = 3

# Anchors, and further common words that chains skip.
ANCHORS = frozenset(
    """
    a an the is are was were be been
    der die das den dem ein eine ist sind war
    le la les un une des est sont était
    el los las una es son era
    """.split()
)
COMMON = ANCHORS | frozenset(
    """
    and or of to in on at by for from with that this it as not he she they we you i but have has had
    und oder von zu mit auf für im nicht als auch sich er sie wir ich an aus bei nach
    et ou de du en dans par pour sur avec que qui pas au ce il elle nous vous je
    y o del por para con que se no lo al su como más en
    """.split()
)
WORDS = re.compile(r"[^\W_]+").findall


def signatures(text) -> np.ndarray:
    """The sorted set of 32-bit signatures of a text."""
    if not isinstance(text, str) or not text:
        return np.empty(0, "<u4")
    words = WORDS(text.lower())
    spots = [i for i, w in enumerate(words) if w in ANCHORS]
    chains = []
    if spots:
        content = [i for i, w in enumerate(words) if w not in COMMON]
        after = np.searchsorted(content, spots, side="right").tolist()
        for i, k in zip(spots, after):
            rest = content[k : k + CHAIN]
            if rest:
                chains.append(words[i] + " " + " ".join([words[j] for j in rest]))
    if not chains:
        chains = [" ".join(words[i : i + CHAIN]) for i in range(max(1, len(words) - CHAIN + 1))] if words else [text]
    hashed = [xxhash.xxh32_intdigest(c.encode("utf-8", "replace")) for c in set(chains)]
    return np.unique(np.array(hashed, "<u4"))


def written(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode("ascii")


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without comparing where the lengths rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


class Row:
    """A document on its way: text and signatures, taken once."""

    __slots__ = ("doc", "text", "found")

    def __init__(self, doc, text: str):
        self.doc, self.text, self.found = doc, text, signatures(text)

    def against(self, following: Row) -> tuple:
        """The result row of this document with the next one."""
        n = len(self.text)
        k = n // 3
        edited = self.text[: n - k] + following.text[:k]
        changed = signatures(edited)
        return (
            self.doc, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(self.found), written(changed),
            likeness(self.found, changed), likeness(self.found, following.found),
        )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
EDGE = RESULT + ", part long, edge string, body binary"


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = out["doc_id"].astype("Int64")
    if "n_chars" in out:
        out["n_chars"] = out["n_chars"].astype("Int64")
    return out


def _squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "mark": [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts],
                "body": [pack(t) for t in texts],
            }
        )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
    part, last, rows = TaskContext.get().partitionId(), None, []
    blank = (None,) * (len(NAMES) - 1)
    for batch in batches:
        for doc, body in zip(batch["doc_id"], batch["body"]):
            row = Row(None if pd.isna(doc) else int(doc), unpack(body).decode("utf-8"))
            if last is None:
                rows.append((row.doc, *blank, part, "first", body))
            else:
                rows.append((*last.against(row), None, None, None))
            last = row
        yield _frame(rows, [*NAMES, "part", "edge", "body"]).astype({"part": "Int64"})
        rows = []
    if last is not None:
        rows = [(last.doc, *blank, part, "last", pack(last.text.encode("utf-8")))]
        yield _frame(rows, [*NAMES, "part", "edge", "body"]).astype({"part": "Int64"})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc, body, after in zip(batch["doc_id"], batch["body"], batch["after"]):
            one, two = (Row(None if pd.isna(doc) else int(doc), unpack(x).decode("utf-8")) for x in (body, after))
            rows.append(one.against(two))
        yield _frame(rows, NAMES)


def compared(documents: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and the likenesses."""
    prepare(documents.sparkSession)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.desc_nulls_last("doc_id"), F.asc("mark")]
    ranges = plain.mapInPandas(_squeeze, "doc_id long, mark long, body binary").repartitionByRange(*order)
    walked = store(ranges.sortWithinPartitions(*order).mapInPandas(_walk, EDGE), "spots")
    firsts, lasts = walked.where("edge = 'first'"), walked.where("edge = 'last'")
    # One number per task: the range after each, and the first after the last.
    turns = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("n"), F.min("part").over(Window.partitionBy()).alias("m"))
    turns = turns.select("part", F.coalesce("n", "m").alias("following"))
    heads = firsts.select(F.col("part").alias("following"), F.col("body").alias("after"))
    edges = lasts.select("doc_id", "part", "body").join(turns, "part").join(heads, "following").select("doc_id", "body", "after")
    return walked.where("edge IS NULL").select(*NAMES).unionByName(edges.mapInPandas(_meet, RESULT))


def near_pairs(fingerprints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of ``fingerprints`` (id, items: array<long>, sorted sets, one row per
    distinct set) at ``least`` or more.

    Lengths are cut into ranges that grow by ``1 / least``, so a set meets its own range and the
    next only.  With signatures ordered from rare to common, two such sets share one of the first
    ``n - ceil(least * n) + 1`` signatures of each; only those are joined.
    """
    kinds = fingerprints.where(F.size("items") > 0).select("id", "items", F.size("items").alias("n"))
    spread = kinds.select("id", "n", F.explode("items").alias("s"))
    counted = spread.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    rare = spread.join(counted, "s").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    reach = F.floor(F.log("n") / -F.log(F.lit(least)))
    rare = rare.where("df > 1").select("id", "n", "s", reach.alias("reach"))
    other = rare.select(F.col("id").alias("b"), F.col("n").alias("m"), "s", F.explode(F.array("reach", F.col("reach") + 1)).alias("reach"))
    met = rare.withColumnRenamed("id", "a").join(other, ["s", "reach"])
    fits = F.least("n", "m") >= least * F.greatest("n", "m")
    met = met.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = met.join(kinds.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    met = met.join(kinds.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    score = common / (F.size("x") + F.size("y") - common)
    return met.select("a", "b", score.alias("likeness")).where(F.col("likeness") >= least)


def query(spark, folder):
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return compared(table(spark, folder, "documents"))

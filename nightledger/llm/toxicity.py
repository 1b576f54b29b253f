"""Toxicity by weak supervision.

Voters look for words and patterns: word lists and word beginnings learned from labelled rows
(split by hash into several voters each), a fixed list of insults, insults addressed to the
reader, and shouted insults.  A voter hits a document or does not.  A generative label model
explains the hit patterns of all documents by a hidden class: per class every voter has its own
hit rate (accuracy), and a dependence tree over the voters (strongest mutual information) carries
their correlations.  EM fits it to the pattern counts, of which there are at most
2 ** voters, with the labelled rows as anchors.  A linear classifier over the learned words and
beginnings is then trained on the posterior labels and scores every document.

Bounds: the word lists come from about ``LABELLED`` labelled rows per class, the linear
classifier from about ``TRAINED`` documents, both drawn by hash; lists hold ``LIST`` entries.
The votes and their counts cover all documents.

Edge cases: null or empty texts have no hits and get the score of that; without labels the fixed
voters alone decide; rows with a null id are scored but not learned from; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored (kept by
:func:`keep`).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import fold, one_label, prepare, store, table

LABELLED, TRAINED, LIST = 20_000, 10_000, 400
#: Lengths of the word beginnings looked at.
STEMS = (4, 5, 6)
WORD_VOTERS, STEM_VOTERS = 6, 3
VOTERS = WORD_VOTERS + STEM_VOTERS + 3
ROUNDS, STEPS, RATE, SHRINK = 30, 300, 0.1, 1e-4
THRESHOLD = 0.5
#: A learned entry is this much likelier in one class (log-odds), by this much evidence (G-test).
LEAST_ODDS, LEAST_EVIDENCE = 3.0, 22.0

# Insults by language.
INSULTS = frozenset(
    """
    arsehole asshole bastard bitch clown coward cretin crook degenerate disgusting dumbass fool
    freak garbage idiot idiotic imbecile jerk liar loser lowlife moron moronic nazi parasite
    pathetic pervert pig scum scumbag shit slut stupid thug trash vermin whore worthless
    abschaum arschloch blödmann depp dreckskerl drecksau dummkopf feigling hurensohn idiotin
    lügner missgeburt schlampe schwachkopf schwein trottel versager wichser widerlich
    abruti connard connasse crétin débile enculé idiote imbécile lâche menteur merde minable
    ordure pourriture putain salaud salope
    asqueroso basura cabrón cobarde escoria estúpido gilipollas imbécil inútil mentiroso mierda
    pendejo perdedor puta tonto
    """.split()
)
YOU = frozenset("you your youre ur du ihr dein tu toi vous ton eres tú usted ustedes".split())
SHOUTED = re.compile(r"[^\W\d_]+[!*]{2,}|\b[^\W\d_a-zà-ÿ]{4,}\b")
WORDS = re.compile(r"[^\W\d_]+").findall


def tokens(text) -> set[str]:
    """Words in lower case and, marked by a star, the beginnings of longer words."""
    if not isinstance(text, str):
        return set()
    words = set(WORDS(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def fixed_votes(text, found: set[str]) -> int:
    """Bits of the three voters that need no training; ``found``: insults in the text."""
    if not found:
        return 0
    words = WORDS(text.lower())
    near = any(w in found and not YOU.isdisjoint(words[max(0, i - 4) : i]) for i, w in enumerate(words))
    loud = any(w in found for m in SHOUTED.findall(text) for w in WORDS(m.lower()))
    return 1 | near << 1 | loud << 2


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch["text"], batch["label"]):
            counts[label].update(tokens(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"token": names, "clean": [counts[0][w] for w in names], "toxic": [counts[1][w] for w in names]})


@dataclass
class Lists:
    """Learned entries with their number; entries up to ``toxic`` speak for toxicity."""

    index: dict[str, int]
    toxic: int

    def hits(self, text) -> tuple[list[int], int]:
        """Numbers of the entries in the text, and the bits of the voters that hit."""
        present = tokens(text)
        hits, mask = [], 0
        for w in present & self.index.keys():
            k = self.index[w]
            hits.append(k)
            if k < self.toxic:
                h = zlib.crc32(w.encode("utf-8", "replace"))
                mask |= 1 << (WORD_VOTERS + h % STEM_VOTERS if w.endswith("*") else h % WORD_VOTERS)
        return sorted(hits), mask | fixed_votes(text, present & INSULTS) << (WORD_VOTERS + STEM_VOTERS)


def learned(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Lists:
    """Lists from about ``labelled`` rows per class; only their ids are broadcast."""
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    size = F.when(F.col("label") == 1, float(sizes.get(1, 0))).otherwise(float(sizes.get(0, 0)))
    ids = labels.where(F.col("label").isin(0, 1) & (draw * size < float(labelled)))
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")
    counts = rows.mapInPandas(_tally, "token string, clean long, toxic long").groupBy("token")
    counts = counts.agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    totals = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, zero = float(totals.get(1, 0)), float(totals.get(0, 0))
    odds = F.log((F.col("a") + 0.5) / (one + 1)) - F.log((F.col("b") + 0.5) / (zero + 1))
    seen = F.col("a") + F.col("b")
    cells = ((F.col("a"), one, seen), (F.col("b"), zero, seen), (one - F.col("a"), one, one + zero - seen), (zero - F.col("b"), zero, one + zero - seen))
    evidence = sum((F.when(o > 0, 2 * o * F.log(o * (one + zero) / (F.lit(c) * r))).otherwise(0.0) for o, c, r in cells), F.lit(0.0))
    scored = counts.select("token", odds.alias("odds"), evidence.alias("g")).where(F.col("g") >= LEAST_EVIDENCE)
    for_it = scored.where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("g"), "token").limit(LIST)
    against = scored.where(F.col("odds") <= -LEAST_ODDS).orderBy(F.desc("g"), "token").limit(LIST // 4)
    bad, good = [r["token"] for r in for_it.collect()], [r["token"] for r in against.collect()]
    extra = sorted(INSULTS - set(bad) - set(good))
    return Lists({w: i for i, w in enumerate(bad + extra + good)}, len(bad))


def voted(documents: DataFrame, lists: Lists) -> DataFrame:
    """doc_id, hits and mask of every row, written once."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(lists)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.hits(t) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            out["hits"], out["mask"] = [x[0] for x in found], [x[1] for x in found]
            yield out

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(plain.mapInPandas(run, "doc_id long, hits array<int>, mask long"), "toxicity")


class LabelModel:
    """Two hidden classes; per class a dependence tree over binary voters."""

    def __init__(self, voters: int = VOTERS):
        self.voters = voters

    def fit(self, masks: np.ndarray, counts: np.ndarray, anchors: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """``counts``: documents per mask; ``anchors``: labelled ones per mask and class."""
        bits = (masks[:, None] >> np.arange(self.voters) & 1).astype(int)
        q = np.clip(np.where(bits.any(1), 0.6 + 0.1 * bits.sum(1), 0.02), 0, 0.98)
        known = anchors.sum(1)
        some = known > 0
        q[some] = (anchors[some, 1] + q[some]) / (known[some] + 1)
        for _ in range(rounds):
            free = np.maximum(counts - known, 0)
            weight = np.stack([free * (1 - q) + anchors[:, 0], free * q + anchors[:, 1]])
            self.prior = (weight.sum(1) + 1) / (weight.sum() + 2)
            self.trees = [self._tree(bits, w) for w in weight]
            q = self.posterior(masks)
        return self

    def _tree(self, bits: np.ndarray, weight: np.ndarray):
        """Parents by Chow and Liu, and smoothed hit rates given the parent's bit."""
        m, total = self.voters, weight.sum() + 1e-9
        both = (bits * weight[:, None]).T @ bits
        one = np.diag(both).copy()
        joint = np.zeros((m, m, 2, 2))
        joint[..., 1, 1], joint[..., 1, 0] = both, one[:, None] - both
        joint[..., 0, 1] = one[None, :] - both
        joint[..., 0, 0] = total - one[:, None] - one[None, :] + both
        joint = np.maximum(joint, 0) + 0.25
        share = joint / joint.sum((2, 3), keepdims=True)
        row, column = share.sum(3, keepdims=True), share.sum(2, keepdims=True)
        gain = (share * np.log(share / (row * column))).sum((2, 3))
        parent, inside = {0: None}, [0]
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in parent), key=lambda e: (gain[e], -e[0], -e[1]))
            parent[j] = i
            inside.append(j)
        rates = []
        for j in range(m):
            if parent[j] is None:
                r = (one[j] + 0.5) / (total + 1)
                rates.append((r, r))
            else:
                p = joint[parent[j], j]
                rates.append((p[0, 1] / p[0].sum(), p[1, 1] / p[1].sum()))
        return parent, np.array(rates)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each mask."""
        bits = masks[:, None] >> np.arange(self.voters) & 1
        logs = []
        for prior, (parent, rates) in zip(self.prior, self.trees):
            out = np.full(len(masks), np.log(prior))
            for j in range(self.voters):
                r = rates[j, bits[:, parent[j]] if parent[j] is not None else 0]
                out += np.log(np.where(bits[:, j] == 1, r, 1 - r))
            logs.append(out)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def label_model(votes: DataFrame, labels: DataFrame) -> tuple[LabelModel, np.ndarray]:
    counts = {r["mask"]: r["n"] for r in votes.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = votes.select("doc_id", "mask").join(labels, "doc_id").groupBy("mask", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    masks = np.array(sorted(counts), dtype=np.int64)
    place = {m: i for i, m in enumerate(masks)}
    anchors = np.zeros((len(masks), 2))
    for r in known:
        anchors[place[r["mask"]], int(r["label"] == 1)] += r["n"]
    return LabelModel().fit(masks, np.array([counts[m] for m in masks], dtype=float), anchors), masks


def linear(hits: list, target: np.ndarray, width: int) -> np.ndarray:
    """Weights (the last is the constant) of logistic regression on soft labels."""
    x = np.zeros((len(hits), width + 1), np.float32)
    x[:, -1] = 1
    for i, h in enumerate(hits):
        x[i, h] = 1
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - target) / len(x) + SHRINK * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Model:
    lists: Lists
    weights: np.ndarray

    def score(self, hits: Column) -> Column:
        """The score as a Spark expression over the numbers of the entries found."""
        table_ = F.array(*[F.lit(float(x)) for x in self.weights])
        g = F.aggregate(hits, F.lit(float(self.weights[-1])), lambda acc, k: acc + F.element_at(table_, k + 1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-g))


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> tuple[Model, DataFrame]:
    """The model and the votes of all rows; ``labels`` (doc_id, label) are those to learn from."""
    prepare(documents.sparkSession)
    lists = learned(documents, labels, labelled)
    votes = voted(documents, lists)
    model, masks = label_model(votes, labels)
    if not len(masks):
        return Model(lists, np.zeros(len(lists.index) + 1)), votes
    # Hit and unhit documents are drawn at rates of their own and weigh alike, or hits would be rare.
    draw = F.pmod(F.xxhash64("doc_id", "hits"), F.lit(1 << 30)) / float(1 << 30)
    split = {r["hit"]: r["n"] for r in votes.groupBy((F.col("mask") != 0).alias("hit")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = F.when(F.col("mask") != 0, float(split.get(True, 0))).otherwise(float(split.get(False, 0)))
    rows = votes.where(draw * size < trained / 2).select("hits", "mask").toPandas()
    target = model.posterior(rows["mask"].to_numpy(np.int64))
    return Model(lists, linear([list(h) for h in rows["hits"]], target, len(lists.index))), votes


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of every row; labels of the held-out fifth are not looked at."""
    own = one_label(labels, "toxic").where(fold(F.col("doc_id"), 5) != 0)
    model, votes = fit(documents, own)
    return votes.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), model.score(F.col("hits")).alias("score"))


def keep(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns; texts are not shuffled."""
    model, _ = fit(documents, one_label(labels, "toxic").where(fold(F.col("doc_id"), 5) != 0))
    shared = documents.sparkSession.sparkContext.broadcast(model.lists)

    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.hits(t)[0] for t in texts], index=texts.index, dtype=object)

    found = F.pandas_udf(hits, "array<int>")
    return documents.where(model.score(found(F.col("text"))) < threshold)


def query(spark, folder):
    """Toxicity of every document; flagged from 0.5 on."""
    scored = score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

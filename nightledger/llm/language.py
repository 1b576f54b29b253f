"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to three bytes long with the counts of the bytes
that followed.  A byte costs ``-log2 p`` bits, where p comes from the longest context the tree
keeps: method C gives a byte seen there n / (T + D), and the escape D / (T + D) is dealt to the
others by the next shorter context, with the bytes already seen excluded; below the empty context
all 256 bytes are equally likely.  The statistics are frozen after training, so these code
lengths are exact and can be tabulated: one lookup per byte and language.  The language with the
shortest code for the whole text wins; the score is its share of 2 ** -bits.

Training: texts are drawn in pieces of up to ``PIECE`` bytes, each by a hash of document and place,
at the rate that brings a language to ``sample_bytes`` bytes on average (all of it where there is
less), so a language of few long documents is drawn from as one of many short ones.  Copies of a row
are drawn together; a language of which that draws nothing gives its piece of smallest hash, so
every language with a byte is learned.  Byte quadruples are counted in Spark, within pieces and
with the three bytes before them; the driver gets the counts, of which there are fewer than the
sample has bytes.  The table is bounded by ``model_bytes``: contexts of three bytes are kept by
count until it is full.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is everything
where nothing can be learned.  Equal code lengths go to the first language in code point order.
Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import fold, prepare, table

ORDER = 3
SAMPLE_BYTES = 2_000_000
MODEL_BYTES = 24 << 20
#: Bytes with a column of their own; rarer ones are coded as escapes down to the uniform level.
SYMBOLS = 191
#: Bytes scored at once, so that a very long text takes bounded memory.
STRIDE = 1 << 20
#: Bytes of a text that enter training, or do not, as one.
PIECE = 4_096


def stream(text: str) -> np.ndarray:
    """The bytes that are modelled: the text in lower case."""
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of byte quadruples by language, in the pieces that are named or else whole texts."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            codes = []
            for text, last, pieces in zip(rows["text"], rows.get("last", [0] * len(rows)), rows.get("pieces", [[0]] * len(rows))):
                b = np.concatenate([np.zeros(ORDER, np.uint8), stream(text)])
                for piece in pieces:
                    # Lower case may have another length; the last piece goes to the end.
                    end = len(b) if piece == last else (piece + 1) * PIECE + ORDER
                    c = b[piece * PIECE : end].astype(np.uint32)
                    codes.append(c[:-3] << 24 | c[1:-2] << 16 | c[2:-1] << 8 | c[3:])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n.astype(np.int64)})


@dataclass
class Trees:
    """Frozen statistics: ``state`` of a context triple, ``bits`` by language, state and byte."""

    langs: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of the bytes under each language."""
        total, width = np.zeros(len(self.langs)), self.bits.shape[2]
        flat = self.bits.reshape(len(self.langs), -1)
        s = self.symbol[np.concatenate([np.zeros(ORDER, np.uint8), data])].astype(np.int32)
        for at in range(0, len(data), STRIDE):
            t = s[at : at + STRIDE + ORDER]
            cell = self.state[(t[:-3] * width + t[1:-2]) * width + t[2:-1]] * width + t[3:]
            total += flat[:, cell].sum(axis=1, dtype=np.float64)
        return total

    def predict(self, text) -> tuple[str, float]:
        if not self.langs or not isinstance(text, str) or not any(c.isalpha() for c in text):
            return "und", 0.0
        bits = self.lengths(stream(text))
        best = int(bits.argmin())
        return self.langs[best], float(1.0 / np.exp2(np.minimum(0, bits[best] - bits)).sum())


#: What empty training text gives.
NOTHING = Trees([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((0, 1, 1), np.float32))


def grow(counts: pd.DataFrame, model_bytes: int = MODEL_BYTES, symbols: int = SYMBOLS) -> Trees:
    """Trees from counts of byte quadruples: lang, code, n."""
    langs = sorted(counts["lang"].unique())
    lang = counts["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(np.int64)
    code, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    seen = np.bincount(code & 255, weights=n, minlength=256)
    seen[0] = np.inf  # what stands before a text
    own = np.sort(np.argsort(-seen, kind="stable")[: min(symbols, int((seen > 0).sum()))])
    novel, width = len(own), len(own) + 1
    symbol = np.full(256, novel, np.int32)
    symbol[own] = np.arange(novel)
    a, b, c, d = (symbol[code >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0))

    rows = max(width + 1, model_bytes // (4 * width * max(1, len(langs))))
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    keys = [np.zeros_like(c), c, b * width + c, (a * width + b) * width + c]
    known = (d < novel)
    whole = [known, known & (c < novel), known & (b < novel) & (c < novel), known & (a < novel) & (b < novel) & (c < novel)]
    room = rows - 1
    for k in (1, 2, 3):
        found, where = np.unique(keys[k][whole[k]], return_inverse=True)
        weight = np.bincount(where, weights=n[whole[k]], minlength=len(found))
        keep = np.argsort(-weight, kind="stable")[:room]
        keep = keep[weight[keep] >= (1, 1, 2, 4)[k]]
        contexts.append(np.sort(found[keep]))
        room -= len(keep)

    first = np.cumsum([0] + [len(x) for x in contexts])
    state = np.zeros((width, width, width), np.int32)
    for k in (1, 2, 3):
        x = contexts[k]
        at = np.arange(first[k], first[k + 1], dtype=np.int32)
        if k == 1:
            state[:, :, x] = at
        elif k == 2:
            state[:, x // width, x % width] = at
        else:
            state[x // width**2, x // width % width, x % width] = at
    short = state.copy()  # the state of each context's suffix, before longer contexts were set
    if len(contexts[3]):
        x = contexts[3]
        short[x // width**2, x // width % width, x % width] = state[novel, x // width % width, x % width]

    bits = np.empty((len(langs), first[-1], width), np.float32)
    for i in range(len(langs)):
        p = np.full((first[-1], width), 1 / 256)
        for k in (0, 1, 2, 3):
            x, mine = contexts[k], (lang == i) & whole[k]
            if not len(x):
                continue
            at = np.searchsorted(x, keys[k][mine])
            hit = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == keys[k][mine])
            m = np.zeros((len(x), width))
            np.add.at(m, (at[hit], d[mine][hit]), n[mine][hit])
            if k == 0:
                below = np.full((1, width), 1 / 256)
            elif k == 1:
                below = np.repeat(p[:1], len(x), axis=0)
            elif k == 2:
                one = np.searchsorted(contexts[1], x % width)
                ok = (one < len(contexts[1])) & (contexts[1][np.minimum(one, len(contexts[1]) - 1)] == x % width)
                below = p[np.where(ok, first[1] + one, 0)]
            else:
                below = p[short[x // width**2, x // width % width, x % width]]
            total, kinds = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
            # What the shorter context leaves to bytes not seen here; the novel column stands for
            # each of the bytes without a column.
            many = np.ones(width)
            many[novel] = 256 - novel
            left = 1 - (below * (m > 0)).sum(1, keepdims=True)
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            p[first[k] : first[k + 1]] = np.where(
                m > 0, m / np.maximum(total + kinds, 1), escape * below / np.maximum(left, 1e-12)
            )
        bits[i] = -np.log2(p)
    return Trees(langs, symbol, state.reshape(-1), bits)


def _by_language(values: dict[str, float]) -> Column:
    """A number of the row's language, looked up: a join would shuffle all texts by language."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("lang"))


def train(documents: DataFrame, sample_bytes: int = SAMPLE_BYTES, model_bytes: int = MODEL_BYTES) -> Trees:
    """Trees for the languages of ``documents`` (doc_id, text, lang); rows without either are left out."""
    prepare(documents.sparkSession)
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    if not sizes:
        return NOTHING
    size = _by_language({row["lang"]: float(row["b"]) for row in sizes})
    last = F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / PIECE).cast("int")
    # The head of the text stands for it: all of it would be hashed again for every piece.
    turn = lambda i: F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.octet_length("text"), i), F.lit(1 << 30)) / float(1 << 30)
    numbers = F.sequence(F.lit(0), last)

    def counted(texts: DataFrame, drawn) -> pd.DataFrame:
        sample = texts.select("lang", "text", last.alias("last"), F.filter(numbers, drawn).alias("pieces")).where(F.size("pieces") > 0)
        counts = sample.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        return counts.toPandas()

    rows = counted(known, lambda i: turn(i) * size < float(sample_bytes))
    missing = sorted({row["lang"] for row in sizes if row["b"]} - set(rows["lang"]))
    if missing:
        left = known.where(F.col("lang").isin(missing) & (F.octet_length("text") > 0))
        least = left.groupBy("lang").agg(F.min(F.array_min(F.transform(numbers, turn))).alias("least")).collect()
        bound = _by_language({row["lang"]: row["least"] for row in least})
        rows = pd.concat([rows, counted(left, lambda i: turn(i) <= bound)], ignore_index=True)
    return grow(rows, model_bytes) if len(rows) else NOTHING


def identify(documents: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            out["lang_pred"] = [x[0] for x in found]
            out["score"] = [x[1] for x in found]
            yield out

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInPandas(run, "doc_id long, lang_pred string, score double")


def query(spark, folder):
    """The language of every document, learned from three quarters of them."""
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    trees = train(documents.where(~held_out))
    return identify(documents, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

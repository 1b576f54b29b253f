"""Bounded-space online packing of token streams into fixed windows.

Every task keeps a fixed number of open windows.  A document's full windows are emitted at once;
its remainder goes to the open window it fills best.  Where it fits none while all windows are
open, the fullest is topped up with the front of the remainder (or left with a gap under
``least_cut`` tokens), emitted, and the rest of the remainder opens a new window.  What is left
open at the end of the tasks is merged, ``fan_in`` tasks at a time and level by level, by
running the open windows together and cutting them anew; every merge leaves one open window, and
the last is cut into powers of two, which need no padding.

Edge cases: a null text is empty and has the separator alone; repeated rows are packed once each;
a null doc_id is kept; an empty table gives an empty result; other columns are ignored.  A text
is encoded whole, so one text has to fit in a worker's memory, no group of texts has to.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import prepare, store, table

WINDOW = 1024
OPEN = 32
LEAST_CUT = 16
FAN_IN = 64
FLUSH = 2_000

# Fixed: how byte-level BPE of this family splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, ids binary, "
    "sequence_id long, offset long, part long, open boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE file, as the ``tokenizers`` library gives them.

    Texts within Latin Extended-B run through tiktoken over the same merges, which is three times
    as fast; the others, for which the two libraries' character classes may differ, and those with
    one of the file's special tokens run through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.odd = re.compile("[^\x00-ɏ]" + "".join("|" + re.escape(t) for t in special)).search

    def __call__(self, text: str) -> np.ndarray:
        if self.odd(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.total),
            Piece(self.doc, self.start + at, self.ids[at:], self.total),
        )


class Packer:
    """The open windows of one task."""

    def __init__(self, size: int, windows: int, least_cut: int):
        self.size, self.windows, self.least_cut = size, windows, least_cut
        self.open: list[list[Piece]] = []
        self.gaps: list[int] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the windows that this completes."""
        while len(piece.ids) >= self.size:
            full, piece = piece.cut(self.size)
            yield [full]
        n = len(piece.ids)
        if not n:
            return
        best = min((i for i, gap in enumerate(self.gaps) if gap >= n), key=self.gaps.__getitem__, default=None)
        if best is None and len(self.open) == self.windows:
            fullest = min(range(self.windows), key=self.gaps.__getitem__)
            if self.gaps[fullest] >= self.least_cut:
                front, piece = piece.cut(self.gaps[fullest])
                self.open[fullest].append(front)
                n = len(piece.ids)
            yield self._close(fullest)
        if best is None:
            self.open.append([piece])
            self.gaps.append(self.size - n)
        else:
            self.open[best].append(piece)
            self.gaps[best] -= n
            if not self.gaps[best]:
                yield self._close(best)

    def _close(self, i: int) -> list[Piece]:
        self.gaps[i], self.gaps[-1] = self.gaps[-1], self.gaps[i]
        self.open[i], self.open[-1] = self.open[-1], self.open[i]
        self.gaps.pop()
        return self.open.pop()


def joined(pieces: list[Piece], size: int, last: bool) -> Iterator[tuple[list[Piece], bool]]:
    """Run pieces together and cut them at ``size``; the rest stays open or, if ``last``, is cut
    into powers of two.  Pieces of one document that meet become one."""
    left = sum(len(p.ids) for p in pieces)
    room, window = (size if left >= size or not last else 1 << (left.bit_length() - 1)), []
    queue = pieces[::-1]
    while queue:
        p = queue.pop()
        if len(p.ids) > room:
            p, rest = p.cut(room)
            queue.append(rest)
        if window and (q := window[-1]).doc == p.doc and q.start + len(q.ids) == p.start and q.total == p.total:
            window[-1] = Piece(q.doc, q.start, np.concatenate([q.ids, p.ids]), q.total)
        else:
            window.append(p)
        room -= len(p.ids)
        left -= len(p.ids)
        if not room:
            yield window, False
            window = []
            room = size if left >= size or not last else 1 << max(0, left.bit_length() - 1)
    if window:
        yield window, True


class Rows:
    """Output rows, flushed in bounded frames."""

    def __init__(self, part: int, base: int):
        self.part, self.next, self.rows = part, base, []

    def add(self, window: list[Piece], still_open: bool) -> None:
        offset = 0
        for p in window:
            n = len(p.ids)
            self.rows.append((p.doc, p.start, n, p.total, p.ids.tobytes(), self.next, offset, self.part, still_open))
            offset += n
        self.next += 1

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=COLUMNS)
        out["doc_id"] = out["doc_id"].astype("Int64")
        self.rows = []
        return out


def _first_level(path: str, size: int, windows: int, least_cut: int, separator: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        packer, rows = Packer(size, windows, least_cut), Rows(part, part << 32)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text) if isinstance(text, str) else np.empty(0, "<u4"), np.array([separator], "<u4"))
                doc = None if pd.isna(doc) else int(doc)
                for window in packer.add(Piece(doc, 0, ids, len(ids))):
                    rows.add(window, False)
                if len(rows.rows) >= FLUSH:
                    yield rows.frame()
        for window in packer.open:
            rows.add(window, True)
        yield rows.frame()

    return run


def _merge(size: int, level: int, last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "sequence_id", "offset"])
        pieces = [
            Piece(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, "<u4"), int(t))
            for d, s, i, t in zip(group["doc_id"], group["start"], group["ids"], group["doc_tokens"])
        ]
        rows = Rows(int(key[0]), (level << 56) + (int(key[0]) << 32))
        for window, still_open in joined(pieces, size, last):
            rows.add(window, still_open)
        return rows.frame()

    return run


def pack(
    documents: DataFrame,
    tokenizer: str,
    size: int = WINDOW,
    windows: int = OPEN,
    least_cut: int = LEAST_CUT,
    fan_in: int = FAN_IN,
    separator: int = 0,
) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, start, length, doc_tokens,
    ids (little-endian unsigned 32-bit), sequence_id, offset."""
    prepare(documents.sparkSession)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    level = store(plain.mapInPandas(_first_level(tokenizer, size, windows, least_cut, separator), SCHEMA), "packed")
    closed = [level.where("NOT open")]
    number = 0
    while True:
        left = level.where("open")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        number += 1
        groups = left.withColumn("task", F.expr(f"part div {fan_in}")).groupBy("task")
        level = store(groups.applyInPandas(_merge(size, number, parts < fan_in), SCHEMA), "packed")
        closed.append(level.where("NOT open"))
    return functools.reduce(DataFrame.unionByName, closed).drop("part", "open")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def query(spark, folder):
    """All documents packed into sequences of 1,024 tokens."""
    import public_tokenizers

    return digest(pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))

"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

**Merges to a transducer.**  A sequence of tokens is what merging makes of its bytes exactly if
merging makes each two neighbours of theirs.  So merging is a transducer that guesses: it walks
down the trie of the vocabulary, may emit the token it stands on, and goes on from the root,
provided the emitted token may follow the one before (:meth:`Merges.may_follow`, which replays the
merges along the seam).  Of all guesses for a string just one is right.

**Determinised.**  A state of the deterministic machine is the set of guesses that are still open
after the bytes read: for each, the tokens since the point that all share, and its place in the
trie.  What all open guesses agree on is emitted at once; a guess closes when the trie has no way
on, at most the longest token later, so the lookahead is bounded by the vocabulary, not by the
text.  States and transitions are made when a text first needs them and kept, up to ``STATES``;
beyond it the machine starts anew from nothing, with the same output.  Pieces up to ``LONGEST``
bytes also keep their whole output, up to ``KEPT`` pieces.

**Decoding** reads ids in chunks of any size.  An automaton over UTF-8 holds back the at most three
bytes of an unfinished character; bytes that cannot be part of one become U+FFFD, as a decoder of
the Unicode standard does.  Its transitions over whole tokens are made lazily too.

Edge cases: a null or empty text has no ids; repeated rows are encoded each; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored; strings that look like
special tokens are ordinary text.  A text is handled whole, so it has to fit in a worker's memory;
no group of texts has to.
"""

from __future__ import annotations

import base64
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import prepare, table

#: Entries that a worker keeps at most: states, pairs of tokens and ends of tokens; pieces of text.
STATES, EDGES, KEPT = 200_000, 20_000, 500_000
LONGEST = 48
CHUNK = 512
_NEVER = 1 << 62
SCHEMA = "doc_id long, ids binary"
DECODED = "doc_id long, ids binary, decoded string"


class Merges:
    """Ranks of a byte-level vocabulary: a token's rank is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        #: The two tokens that a token is merged from; None for single bytes.
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Tokens that merging never makes of their own bytes; they stand for a whole piece only.
        self.unmade: dict[bytes, int] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, int, bytes]]] = {}
        #: Whether b may follow a, by a * 2^32 + b, as far as it was asked.
        self.follows: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = None
                continue
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at], _NEVER), ranks.get(token[at:], _NEVER)
                if a < rank and b < rank and a in self.halves and b in self.halves and self._meet(a, b, rank):
                    self.halves[rank] = (a, b)
                    break
            else:
                self.unmade[token] = rank

    def _edge(self, token: int, right: bool) -> list[tuple[int, int, bytes]]:
        """What stands at one end of a token while it is being merged, last to first: the rank
        of the merge that made it, of the merge that uses it up, and its bytes."""
        known = self._edges.get((token, right))
        if known is None:
            known, used, at = [], _NEVER, token
            while (halves := self.halves[at]) is not None:
                known.append((at, used, self.bytes[at]))
                used, at = at, halves[right]
            known.append((-1, used, self.bytes[at]))
            if len(self._edges) > EDGES:
                self._edges.clear()
            self._edges[token, right] = known
        return known

    def _meet(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether merges of a rank below ``limit`` leave the seam between ``a`` and ``b`` alone.

        Walks back through the pairs of edge pieces that are there at once.  Their own merge comes
        first if its rank is below that of the merge using up the left one, and not above that of
        the right one, which stands further right.
        """
        left, right, find = self._edge(a, True), self._edge(b, False), self.ranks.get
        i = j = 0
        while True:
            made, used, x = left[i]
            made_too, used_too, y = right[j]
            rank = find(x + y, _NEVER)
            if rank < limit and rank < used and rank <= used_too:
                return False
            # Back in time: undo the later of the two merges.
            if made > made_too:
                i += 1
            elif made_too >= 0:
                j += 1
            else:
                return True

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` as they are where they are neighbours."""
        known = self.follows.get(a << 32 | b)
        if known is None:
            if len(self.follows) > STATES:
                self.follows.clear()
            known = self.follows[a << 32 | b] = self._meet(a, b)
        return known


class Transducer:
    """The deterministic machine.  A state is a tuple of guesses (tokens not yet emitted, trie
    node), by length of what is in the trie; the token emitted last is part of it where a guess
    starts right behind it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        trie: list[dict[int, int]] = [{}]
        token = [-1]
        for text, rank in merges.ranks.items():
            if rank not in merges.halves:
                continue
            node = 0
            for byte in text:
                child = trie[node].get(byte)
                if child is None:
                    child = trie[node][byte] = len(trie)
                    trie.append({})
                    token.append(-1)
                node = child
            token[node] = rank
        #: By node and byte: the node below, its token or -1, whether there is more below it.
        self.trie = [{b: (c, token[c], bool(trie[c])) for b, c in below.items()} for below in trie]
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        #: By 256 * state + byte: 256 * the next state, and the tokens emitted.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._number((-1, (((), 0),)))

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _move(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        before, guesses = state
        going, ended, trie, follows = [], None, self.trie, self.merges.follows
        for tokens, node in guesses:
            below = trie[node].get(byte)
            if below is None:
                continue
            child, token, more = below
            if token >= 0 and ended is None:
                last = tokens[-1] if tokens else before
                if last < 0:
                    ended = (*tokens, token)
                else:
                    follow = follows.get(last << 32 | token)
                    if follow or follow is None and self.merges.may_follow(last, token):
                        ended = (*tokens, token)
            if more:
                going.append((tokens, child))
        if ended is None:
            raise ValueError("no way on: the vocabulary is not closed under merging")
        going.append((ended, 0))
        if not going[0][0]:
            # The longest guess starts right behind what was emitted last, which still matters.
            return (before, tuple(going)), ()
        shared = min(len(tokens) for tokens, _ in going)
        while shared and any(tokens[:shared] != ended[:shared] for tokens, _ in going):
            shared -= 1
        if shared:
            going = [(tokens[shared:], node) for tokens, node in going]
        out = ended[:shared]
        return (out[-1] if out and not going[0][0] else -1, tuple(going)), out

    def feed(self, number: int, data: bytes, out: list[int]) -> int:
        """Read ``data`` in state ``number``, append what is emitted, return the state reached."""
        moves, at = self.moves, number << 8
        for byte in data:
            move = moves.get(at + byte)
            if move is None:
                state, emitted = self._move(self.states[at >> 8], byte)
                if len(self.states) >= STATES:
                    self._forget()
                    moves, at = self.moves, self._number(state) << 8
                    out.extend(emitted)
                    continue
                move = moves[at + byte] = (self._number(state) << 8, emitted)
            at, emitted = move
            if emitted:
                out.extend(emitted)
        return at >> 8

    def run(self, data: bytes) -> list[int]:
        """Tokens of one piece of text."""
        whole = self.merges.unmade.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        if data:
            # The guess that ends here, with nothing begun in the trie, is the last.
            last = self.feed(0, data, out)
            out.extend(self.states[last][1][-1][0])
        return out


class Splitter:
    """Matches of the pattern that splits text before merging, by tiktoken's character classes.

    The ``regex`` library may know characters that tiktoken's does not class yet (or the reverse).
    A character that the two class differently stands in as one of the right class.
    """

    CLASSES = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\t"}

    def __init__(self, pattern: str):
        import tiktoken

        self.find = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        self.probes = [
            (regex.compile(c), tiktoken.Encoding("class", pat_str=c, mergeable_ranks=single, special_tokens={}), stand_in)
            for c, stand_in in self.CLASSES.items()
        ]
        self.stand_ins: dict[str, str] = {}

    def stand_in(self, letter: str) -> str:
        """``letter`` itself, or one of its class where the libraries differ."""
        theirs = ["" if not e.encode_ordinary(letter) else s for _, e, s in self.probes]
        ours = [s if r.match(letter) else "" for r, _, s in self.probes]
        return letter if ours == theirs else next(filter(None, theirs), "!")

    def __call__(self, text: str) -> Iterable[str]:
        if not text.isascii():
            known = self.stand_ins
            differ = {}
            for letter in set(text):
                if letter not in known:
                    known[letter] = self.stand_in(letter)
                if known[letter] != letter:
                    differ[ord(letter)] = known[letter]
            if differ:
                return (text[m.start() : m.end()] for m in self.find.finditer(text.translate(differ)))
        return self.find.findall(text)


class Kept(dict):
    """Ids of pieces as bytes; a missing one runs through the transducer and is kept if short."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.machine.run(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: Merges, pattern: str):
        self.machine, self.split = Transducer(merges), Splitter(pattern)
        self.kept = Kept(self.machine)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self.split(text)))


class Utf8:
    """Automaton over bytes of UTF-8.  Its state is what it holds back: the start of a character."""

    @staticmethod
    def needs(start: bytes) -> tuple[int, int, int]:
        """Bytes that are to follow ``start`` (0: none, -1: it starts nothing) and the range that
        the next of them lies in."""
        first = start[0]
        size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        if not size:
            return -1, 0, 0
        low, high = 0x80, 0xBF
        if len(start) == 1:
            # Neither overlong forms nor surrogates nor what lies beyond U+10FFFF.
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(first, (low, high))
        return size - len(start), low, high

    @classmethod
    def step(cls, held: bytes, data: bytes) -> tuple[str, bytes]:
        """Text that ``data`` completes after ``held``, and what is held back then."""
        out, pending = [], held
        for byte in data:
            if pending:
                left, low, high = cls.needs(pending)
                if low <= byte <= high:
                    pending += bytes([byte])
                    if left == 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("\ufffd")
            pending = bytes([byte])
            left, _, _ = cls.needs(pending)
            if left <= 0:
                out.append(chr(byte) if left == 0 else "\ufffd")
                pending = b""
        return "".join(out), pending


class Decoder:
    """Text of a stream of ids, whole characters at a time."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        #: Tokens that hold whole characters only: from nothing held back to nothing held back.
        self.whole: dict[int, str] = {}
        for i, data in tokens.items():
            text, held = Utf8.step(b"", data)
            if not held:
                self.whole[i] = text

    def feed(self, held: bytes, ids: Iterable[int]) -> tuple[str, bytes]:
        """Text of ``ids`` after the bytes ``held`` back so far, and what is held back then."""
        out = []
        for i in ids:
            if not held and i in self.whole:
                out.append(self.whole[i])
                continue
            moves = self.moves.setdefault(held, {})
            move = moves.get(i)
            if move is None:
                if i not in self.tokens:
                    raise ValueError(f"no token has id {i}")
                move = moves[i] = Utf8.step(held, self.tokens[i])
                if len(self.moves) > STATES:
                    self.moves.clear()
            text, held = move
            out.append(text)
        return "".join(out), held

    def __call__(self, ids: np.ndarray, chunk: int = CHUNK) -> Iterator[str]:
        held = b""
        for at in range(0, len(ids), chunk):
            part = ids[at : at + chunk].tolist()
            try:
                text = "".join(map(self.whole.__getitem__, part)) if not held else None
            except KeyError:
                text = None
            if text is None:
                text, held = self.feed(held, part)
            yield text
        if held:
            yield "\ufffd"


def ranked(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines "base64 of the bytes, rank"."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@functools.lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    made = Encoder(Merges(ranked(path)), pattern)
    # States are tuples that stay: looking for cycles in them only costs time.
    gc.freeze()
    gc.set_threshold(500_000)
    return made


@functools.lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder({rank: token for token, rank in ranked(path).items()})


def _rows(function: Callable, schema: str) -> Callable:
    """Apply ``function`` to each row's values; a frame of results for each batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [function(*row) for row in zip(*(batch[c] for c in batch.columns))]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = batch["doc_id"].astype("Int64").to_numpy() if len(rows) else out["doc_id"]
            yield out.astype({"doc_id": "Int64"})

    return run


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each document's text."""
    prepare(documents.sparkSession)

    def row(doc, text):
        return doc, encoder(path, pattern)(text) if isinstance(text, str) else b""

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_rows(row, SCHEMA), SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for; null ids stand for none."""
    prepare(encoded.sparkSession)

    def row(doc, ids):
        return doc, ids, "".join(decoder(path)(np.frombuffer(ids or b"", "<u4")))

    return encoded.select("doc_id", "ids").mapInPandas(_rows(row, DECODED), DECODED)


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """What :func:`decode` gives of :func:`encode`, in one pass through one worker."""
    prepare(documents.sparkSession)

    def row(doc, text):
        ids = encoder(path, pattern)(text) if isinstance(text, str) else b""
        return doc, ids, "".join(decoder(path)(np.frombuffer(ids, "<u4")))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_rows(row, DECODED), DECODED)


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, folder):
    """All documents encoded, and the ids decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digest(round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN))

"""Whitening, hard negatives and the BPE transducer against brute force and on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from nightledger.llm import negatives, transducer, whitening

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
INF, NAN = float("inf"), float("nan")


def plain(x, components):
    """Unit eigenvectors (columns) and eigenvalues of the covariance of the distinct rows."""
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    return u, e[::-1][:components], v[:, ::-1][:, :components], e.sum()


@pytest.fixture
def vectors(spark):
    def make(rows, schema="vec_id long, embedding array<double>, label int"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


def test_whitening_equals_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 60)
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 9)) * np.array([3, 2, 1.5, 1, 0.9, 0.8, 0.5, 0.3, 0.01]))
    x[250:] = x[rng.integers(0, 250, 250)]  # repeated rows count once in the fit
    u, e, v, total = plain(x, 4)
    got = sorted(whitening.whiten(vectors([(i, (r / 256).tolist(), 0) for i, r in enumerate(x)])).collect(), key=lambda g: (g.vec_id, g.component))
    assert [(g.vec_id, g.component) for g in got] == [(i, c) for i in range(500) for c in (1, 2, 3, 4)]
    z = (x - u.mean(0)) @ v / np.sqrt(e)
    w = np.array([g.whitened for g in got]).reshape(-1, 4)
    assert np.allclose(w * np.sign((w * z).sum(0)), z, atol=1e-11)
    assert np.allclose([g.explained for g in got[:4]], e / total, rtol=1e-12)
    sums = [int(s) for s in u.sum(0)]
    assert [g.deviation for g in got[::4]] == [sum((len(u) * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert {g.n for g in got} == {len(u)} and max(g.identity_error for g in got) < 1e-12


@pytest.mark.parametrize("spread", [[1, 1, 1, 1, 0, 0], [5, 5, 1, 0, 0, 0], [1e6, 1, 1e-3, 1, 0, 1]])
def test_bidiagonalisation_survives_equal_and_missing_deviations(spread):
    """Equal singular values and dimensions without any use a Krylov space up before its time."""
    rng = np.random.default_rng(2)
    u, _ = np.linalg.qr(rng.normal(size=(40, 6)))
    x = u * np.array(spread, float)

    class Local(whitening.Blocks):
        def total(self, function, kind="double"):
            return list(function(x))

    right, b = whitening.bidiagonalise(Local(None, 6, "<i8"))
    assert np.allclose(right.T @ right, np.eye(6), atol=1e-13)
    assert np.allclose(b, np.triu(b) - np.triu(b, 2))
    assert np.allclose(np.linalg.svd(b)[1], sorted(spread, reverse=True), atol=1e-12 * max(spread))
    assert np.allclose(right @ b.T @ b @ right.T, x.T @ x, atol=1e-12 * max(spread) ** 2)


def test_whitening_of_odd_tables(vectors):
    rows = [
        (1, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, [0.25], 1), (3, None, 1), (4, [1.0, None], 1), (5, [NAN, 1.0], 1),
        (6, [INF, 0.0], 1), (7, [], 1), (None, [-0.5, 2.0], 1), (8, [-0.0, 3.0], None),
    ]
    frame = vectors(rows).selectExpr("*", "'x' AS component", "0 AS n", "0 AS x", "0 AS whitened")
    got = whitening.whiten(frame).collect()
    assert sorted((g.vec_id or -1, g.component) for g in got) == sorted((i, c) for i in (1, 1, 2, 7, -1, 8) for c in (1, 2))
    x = np.array([[256, 128], [64, 0], [0, 0], [-128, 512], [0, 768]])
    sums = x.sum(0)
    assert {g.deviation for g in got if g.vec_id == 7} == {int(((5 * x[2] - sums) ** 2).sum())} and {g.n for g in got} == {5}
    assert whitening.whiten(frame.limit(0)).collect() == []
    same = vectors([(i, [1.0, 2.0], 0) for i in range(5)])
    assert whitening.whiten(same).collect() == []  # no variance, no component
    huge = whitening.whiten(vectors([(0, [1e300, 0.0], 0), (1, [-1e300, 1.0], 0), (2, [4.0, 2.0], 0)])).collect()
    assert {g.deviation for g in huge if g.vec_id == 0} == {whitening.LONGEST}


def mined(x, labels, ids, anchors, positives=5, wanted=10):
    out = []
    for a in anchors:
        scores = {i: sum(int(p) * int(q) for p, q in zip(x[a], x[i])) for i in ids if i != a}
        first = sorted((i for i in scores if labels[i] == labels[a]), key=lambda i: (-scores[i], i))[:positives]
        for p in first:
            good = (i for i in scores if labels[i] != labels[a] and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p])
            out += [(a, p, r + 1, i, scores[p], scores[i]) for r, i in enumerate(sorted(good, key=lambda i: (-scores[i], i))[:wanted])]
    return sorted(out)


@pytest.mark.parametrize("scale", [4, 256, 1 << 27])
def test_negatives_equal_brute_force(vectors, monkeypatch, scale):
    """Few, many and very many bits a field; blocks, runs and tiles of many sizes."""
    for name, value in (("BLOCK", 40), ("AT_ONCE", 3), ("TILE", 90), ("ANCHORS", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 7)) + 0.6
    v[100:140] = v[3]  # ties
    labels = np.where(rng.random(300) < 0.6, 1, rng.integers(0, 4, 300))
    frame = vectors([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(v, labels))])
    got = sorted(tuple(g) for g in negatives.mine(frame, "vec_id % 25 = 0", scale=scale).collect())
    x = np.floor(v * scale).astype(object)
    assert got == mined(x, labels, range(300), range(0, 300, 25)) and len(got) > 300


def test_negatives_meet_all_candidates_in_many_partitions(vectors, monkeypatch):
    """Tiles of both sides meet wherever their keys are dealt to, not only in one partition."""
    for name, value in (("BLOCK", 40), ("TILE", 90), ("ANCHORS", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(6)
    v, labels = rng.normal(size=(300, 7)) + 0.6, rng.integers(0, 4, 300)
    frame = vectors([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(v, labels))])
    conf = frame.sparkSession.conf
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {name: conf.get(name) for name in names}
    try:
        for name, value in names.items():
            conf.set(name, value)
        got = sorted(tuple(g) for g in negatives.mine(frame, "vec_id % 25 = 0").collect())
    finally:
        for name, value in before.items():
            conf.set(name, value)
    assert got == mined(np.floor(v * 256).astype(object), labels, range(300), range(0, 300, 25)) and len(got) > 300


def test_fields_hold_extremes():
    for low, high in ((0, 0), (-256, 255), (255, 255), (-1, 0), (-(1 << 30), (1 << 30) - 1)):
        rng = np.random.default_rng(3)
        x, a = rng.integers(low, high + 1, (11, 64)), rng.integers(low, high + 1, (5, 64))
        x[0], x[1], a[0], a[1] = low, high, low, high
        packed = negatives.Packed(x, int(a.min()), int(a.max()))
        want = a.astype(object) @ x.T.astype(object)
        assert packed.scores(a).tolist() == np.clip(want, -(1 << 63), (1 << 63) - 1).tolist()
    assert negatives.Packed(np.full((3, 64), 100), -100, 100).fields >= 2


def test_negatives_of_odd_tables(vectors):
    rows = [
        (0, [1.0, 1.0], 1), (100, [1.0, 0.0], 2), (1, [2.0, 2.0], 1), (1, [2.0, 2.0], 1), (2, [1.0, 0.5], 3), (3, None, 1), (4, [1.0, None], 1),
        (5, [NAN, 1.0], 1), (6, [INF, 0.0], 1), (7, [1.0], 4), (8, [], 1), (None, [9.0, 9.0], 2), (9, [1.0, 1.0], None), (10, [0.0, 0.0], 3),
    ]
    frame = vectors(rows).selectExpr("*", "'x' AS rank", "0 AS score", "0 AS tile", "0 AS block")
    got = sorted(tuple(g) for g in negatives.mine(frame, "vec_id % 100 = 0", scale=1).collect())
    # Row 100 has no other row of its label; row 8 counts as zeros and scores 0, as rows 7 and 10 may.
    assert got == mined(
        {0: [1, 1], 100: [1, 0], 1: [2, 2], 2: [1, 0], 7: [1, 0], 8: [0, 0], 10: [0, 0]},
        {0: 1, 100: 2, 1: 1, 2: 3, 7: 4, 8: 1, 10: 3}, (0, 100, 1, 2, 7, 8, 10), (0, 100),
    )
    assert got == [(0, 8, 1, 10, 0, 0)]
    assert negatives.mine(frame.limit(0), "vec_id % 100 = 0").collect() == []
    assert negatives.mine(frame.where("vec_id = 1"), "vec_id % 100 = 0").collect() == []


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.ranked(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    encode = transducer.encoder(RANKS, public_tokenizers.PATTERN)
    return lambda text: np.frombuffer(encode(text), "<u4").tolist()


def odd_texts():
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(1, 127), *range(0xA0, 0x250))] + list(" \n\t's") * 20
    letters += list("漢字🙂١ ՘\U00011de0\U0010ffff\x1c\x85")  # some are newer than tiktoken's tables
    for _ in range(2_000):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
    for _ in range(2_000):  # runs, where merges of equal rank meet
        few = rng.sample("abcdefghijklmnopqrstuvwxyz-=_ .0", rng.randint(1, 4))
        yield "".join(rng.choice(few) for _ in range(rng.randrange(200)))
    yield "a" * 50_000 + " " * 50_000
    yield "<|endoftext|>"


def test_transducer_equals_tiktoken(ours, theirs):
    for text in odd_texts():
        assert ours(text) == theirs.encode_ordinary(text)


def test_transducer_on_joined_tokens_that_starts_anew(theirs, monkeypatch):
    """Bytes of random tokens, which need not be text, with a machine that keeps few states."""
    monkeypatch.setattr(transducer, "STATES", 500)
    merges = transducer.Merges(transducer.ranked(RANKS))
    machine, rng, tokens = transducer.Transducer(merges), random.Random(4), list(merges.bytes.values())
    assert not merges.unmade
    for _ in range(3_000):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        assert machine.run(data) == theirs._core_bpe.encode_single_piece(data)
        assert len(machine.states) <= 501


def test_tokens_that_merging_never_makes():
    """"abc" has no merge of two tokens, so it stands for a whole piece only."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bb": 257, b"abc": 258, b"xyz": 259}
    machine = transducer.Transducer(transducer.Merges(ranks))
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    assert list(machine.merges.unmade.values()) == [259]
    for text in ("abc", "xyz", "xyzx", "aabcabbb", "bbb", "abbbbb"):
        assert machine.run(text.encode()) == own.encode_ordinary(text)


def test_emission_waits_no_longer_than_the_longest_token():
    merges = transducer.Merges(transducer.ranked(RANKS))
    machine, longest = transducer.Transducer(merges), max(map(len, merges.ranks))
    data = (" understanding misunderstandings" * 40).encode()
    out, number = [], 0
    for at, byte in enumerate(data, 1):
        number = machine.feed(number, bytes([byte]), out)
        assert at - sum(len(merges.bytes[i]) for i in out) <= 2 * longest


def test_characters_are_classed_as_in_tiktoken():
    splitter = transducer.Splitter(public_tokenizers.PATTERN)
    for code in (*range(0x3000), *range(0x10000, 0x12000), *range(0x1F000, 0x1F200)):
        letter = chr(code)
        if not 0xD800 <= code < 0xE000:
            stand_in = splitter.stand_in(letter)
            for ours, other, _ in splitter.probes:
                assert bool(ours.match(stand_in)) == bool(other.encode_ordinary(letter))


def test_streaming_decoder(theirs):
    merges = transducer.Merges(transducer.ranked(RANKS))
    decode, rng = transducer.decoder(RANKS), random.Random(6)
    for _ in range(2_000):  # ids of no text, cut anywhere
        ids = [rng.randrange(len(merges.ranks)) for _ in range(rng.randrange(40))]
        want = b"".join(merges.bytes[i] for i in ids).decode("utf-8", "replace")
        assert "".join(decode(np.array(ids, "<u4"), chunk=rng.randint(1, 9))) == want
    for text in odd_texts():
        ids = np.array(theirs.encode_ordinary(text), "<u4")
        assert "".join(decode(ids, chunk=3)) == text
    with pytest.raises(ValueError):
        "".join(decode(np.array([1 << 20], "<u4")))


def test_tokens_of_odd_tables(odd, none, theirs):
    frame, rows = odd
    got = transducer.digest(transducer.decode(transducer.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)).collect()

    def row(doc, text):
        ids = theirs.encode_ordinary(text or "")
        digests = [hashlib.sha256(d).hexdigest() for d in (np.array(ids, "<u4").tobytes(), (text or "").encode())]
        return (-1 if doc is None else doc, len(ids), *digests)

    assert sorted((-1 if g.doc_id is None else g.doc_id, *g[1:]) for g in got) == sorted(row(r[0], r[1]) for r in rows)
    both = transducer.digest(transducer.round_trip(frame, RANKS, public_tokenizers.PATTERN)).collect()
    assert Counter(both) == Counter(got)
    assert transducer.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []
    assert transducer.round_trip(none, RANKS, public_tokenizers.PATTERN).collect() == []

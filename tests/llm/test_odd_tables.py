"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and
empty tables, with the results that the docstrings define."""

import random
import zlib

import public_tokenizers
import pytest

from invented_texts import invented
from nightledger.llm import language, licenses, mixing, neardup, packing, quality, sharding, spotsigs, topk, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_sharding(odd, none):
    frame, rows = odd
    got = sharding.numbered(frame, [1.0] * 4, [1.0] * 5).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.size, g.text_crc32) for g in got) == want
    for shard in {g.shard for g in got}:
        slots = sorted(g.slot for g in got if g.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({g.shard for g in got if g.doc_id is None}) == 1
    assert sharding.numbered(none, [1.0], [1.0, 1.0]).collect() == []
    assigned = sharding.assign(frame, "doc_id", [1.0] * 4)
    assert assigned.columns == frame.columns and assigned.count() == len(rows)


def test_mixing(odd, none):
    frame, rows = odd
    got = mixing.plan(frame, (5, 2, 1), 1.5, 2.0).collect()
    assert len(got) == len(rows)
    assert all(g._mix_times in (0, 1, 2) for g in got)
    assert sorted(g._mix_size for g in got) == sorted(len((r[1] or "").split()) for r in rows)
    alike = {}
    for g in got:
        alike.setdefault((g.doc_id, g.text, g.source), set()).add(g._mix_times)
    assert all(len(v) == 1 for v in alike.values())
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(g._mix_times for g in got)
    assert mixing.mix(none).collect() == []


def test_packing(odd, none):
    frame, rows = odd
    got = packing.pack(frame, VOCABULARY).collect()
    assert {g.doc_id for g in got} == {r[0] for r in rows}
    encode = packing.encoder(VOCABULARY)
    assert sum(g.length for g in got) == sum(len(encode(r[1] or "")) + 1 for r in rows)
    assert [g.doc_tokens for g in got if g.doc_id == 3] == [1]
    assert packing.pack(none, VOCABULARY).collect() == []


def test_near_duplicates(odd, none):
    frame, rows = odd
    got = neardup.linked(frame).collect()
    assert len(got) == len(rows)
    of = {}
    for g in got:
        of.setdefault(g.doc_id, []).append(g)
    assert [(g.n_shingles, g.component_id, g.kept) for i in (3, 4, 5) for g in of[i]] == [(0, 3, True), (0, 4, True), (0, 5, True)]
    assert [(g.component_id, g.kept) for g in of[1]] == [(1, True), (1, True)]
    assert [(g.component_id, g.kept) for g in of[2]] == [(1, False)]
    assert [(g.n_shingles, g.component_id) for i in (6, 7) for g in of[i]] == [(1, 6), (1, 6)]
    assert of[10][0].component_id == 9
    assert all(g.component_id is None and g.kept for g in of[None])
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 8, 9, 11, 12] and ids.count(None) == 2
    assert neardup.linked(none).collect() == []
    assert neardup.one_of_each(none).collect() == []


def test_rows_without_copies(odd, none):
    frame, rows = odd
    kept = neardup.without_copies(frame)
    assert kept.columns == frame.columns
    got = kept.collect()
    # Both texts under id 11 stay; the copy of row 1 that has no id goes, the empty row without one stays.
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == [2, 3, 4, 5, 6, 8, 9, 11, 11, 12]
    assert {r.text for r in got if r.doc_id == 11} == {r[1] for r in rows if r[0] == 11}
    assert [r.text for r in got if r.doc_id is None] == [None]
    assert neardup.without_copies(none).collect() == []


def test_copies_without_an_id_and_texts_that_share_one(frame):
    rng = random.Random(4)
    texts = [invented(rng, "en", 80) for _ in range(6)]
    rows = [(None, texts[0], "en", "a")] * 3 + [(7, t, "en", "b") for t in texts[:4]] + [(8, texts[4], "en", "c"), (8, texts[4], "en", "c")]
    rows += [(9, texts[4] + " end", "en", "c"), (10, texts[5], "en", "c")]
    got = neardup.without_copies(frame(rows)).collect()
    assert sorted(r.text.removesuffix(" end") for r in got) == sorted(texts)


def test_spotsigs(odd, none, frame):
    table, rows = odd
    got = spotsigs.compared(table).collect()
    assert len(got) == len(rows)
    assert {g.fingerprint for g in got if g.doc_id in (3, 4)} == {""}
    assert len({g.fingerprint for g in got if g.doc_id in (1, 2)}) == 1
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert spotsigs.compared(none).collect() == []
    alone = spotsigs.compared(frame([(5, "the word", "en", "s")])).collect()
    assert [(g.n_chars, g.near_next) for g in alone] == [(8, 1.0)]


def test_language(odd, none):
    frame, rows = odd
    got = language.identify(frame, language.train(frame)).collect()
    assert len(got) == len(rows)
    unknown = [g for g in got if g.lang_pred == "und"]
    assert {g.doc_id for g in unknown} == {3, 4, 5, 8, None} and all(g.score == 0 for g in unknown)
    assert language.identify(none, language.train(none)).collect() == []
    assert {g.lang_pred for g in language.identify(frame, language.train(none)).collect()} == {"und"}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(module, odd, none, labels):
    frame, rows = odd
    known = labels([(1, 1, 0), (1, 1, 0), (2, 1, 1), (6, 0, 0), (9, None, None), (None, 1, 1)])
    got = module.score(frame, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= g.score <= 1 for g in got)
    assert all(g.held_out == (zlib.crc32(b"" if g.doc_id is None else str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert len({round(g.score, 12) for g in got if g.doc_id in (3, 4)}) == 1
    assert module.score(none, known).collect() == []
    assert len(module.score(frame, labels([])).collect()) == len(rows)
    kept = module.keep(frame, known)
    assert kept.columns == frame.columns and kept.count() <= len(rows)


def test_licenses(odd, none):
    frame, _ = odd
    got = licenses.scan(frame).collect()
    assert [(g.doc_id, g.paragraph, g.family) for g in got if g.confirmed] == [(12, 0, "Apache-2.0")]
    assert licenses.scan(none).collect() == []


def test_top_k(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5]), (100, [0.25, 0.25]), (100, [0.25, 0.25]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]),
        (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [2.0]), (8, []), (None, [9.0, 9.0]), (9, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = topk.top_k(frame, "vec_id % 100 = 0", k=3).collect()
    best = {(g.query_id, g.rank): (g.vec_id, g.score) for g in got}
    assert best == {
        (0, 1): (7, 2 * 1024 * 1024), (0, 2): (1, 1024 * 1024 + 512 * 512), (0, 3): (2, 1024 * 1024 + 512 * 512),
        (100, 1): (7, 2 * 1024 * 256), (100, 2): (0, 1536 * 256), (100, 3): (1, 1536 * 256),
    }
    assert topk.top_k(frame.limit(0), "vec_id % 100 = 0").collect() == []

"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from invented_texts import invented
from nightledger.llm import language, licenses, mixing, neardup, packing, quality, sharding, spotsigs, topk, toxicity
from nightledger.llm.components import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def joined_by(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def copies():
    """Exact and near copies around the threshold, in one large group and several small ones."""
    rng, texts = random.Random(3), []
    for group, size in enumerate((150, 40, 12, 6, 3)):
        base = invented(rng, "en", 120).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = invented(rng, "en", 1)
            texts.append(" ".join(words))
        texts += [" ".join(base)] * 3
    texts += [invented(rng, "de", rng.randint(1, 80)) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(frame, copies, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)  # large buckets go through pairs of blocks
    got = {g.doc_id: g for g in neardup.linked(frame(copies)).collect()}
    sets = {r[0]: shingled(r[1]) for r in copies}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = joined_by(links, sets)
    assert {i: g.component_id for i, g in got.items()} == want
    assert all(g.n_shingles == len(sets[i]) and g.kept == (want[i] == i) for i, g in got.items())
    assert max(Counter(want.values()).values()) > 20 and len(set(want.values())) > 100


def test_estimate_of_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 1.0):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
            n = int(2_000 * share / (1 + share) * 2 / 2)
            a, b = np.unique(pool[:1_000]), np.unique(np.concatenate([pool[: int(2_000 * share / (1 + share))], pool[1_000 : 2_000 - n]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (np.frombuffer(neardup.packed(neardup.minima(s)), np.uint64) for s in (a, b))
            errors.append(float(neardup.agreement(x, y)) - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.09


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = components(spark.createDataFrame(chain + star + [(7, 7), (3, 4)], "a long, b long")).collect()
    roots = defaultdict(set)
    for g in got:
        roots[g.root].add(g.id)
    assert sorted(map(len, roots.values())) == [41, 60]


def test_packing_round_trip(frame, copies):
    rows = copies + [(900, "x " * 30_000, "en", "s"), (901, "naïve <|endoftext|> 漢字 ", "en", "s"), (901, "naïve <|endoftext|> 漢字 ", "en", "s")]
    pieces = packing.pack(frame(rows), VOCABULARY, windows=4, fan_in=2)
    got, digest = pieces.collect(), packing.digest(pieces)
    whole = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for g in got:
        by_doc[g.doc_id].append(g)
        by_sequence[g.sequence_id].append(g)
    for i, t, *_ in {r[0]: r for r in rows}.values():
        ids = whole.encode(t, add_special_tokens=False).ids + [0]
        times = sum(r[0] == i for r in rows)
        count = Counter()
        for g in by_doc[i]:
            assert g.doc_tokens == len(ids) and 0 < g.length <= 1024
            assert np.frombuffer(g.ids, "<u4").tolist() == ids[g.start : g.start + g.length]
            count.update(range(g.start, g.start + g.length))
        assert count == Counter({k: times for k in range(len(ids))})
    used = wasted = 0
    for pieces_ in by_sequence.values():
        at = 0
        for g in sorted(pieces_, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 1024
        used += at
        wasted += 0 if at & (at - 1) == 0 else 1024 - at
    assert wasted <= 0.02 * used
    crc = {(d.sequence_id, d.offset): d.ids_crc32 for d in digest.collect()}
    assert len(crc) == len(got)


def test_encoder_equals_tokenizers():
    rng, encode = random.Random(2), packing.encoder(VOCABULARY)
    letters = [chr(c) for c in range(1, 0x250)] + list(" \n\t'sll 0123ab") * 20 + ["漢", "🙂", " ", "١"]
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        assert encode(text).tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_mixing_reaches_the_water_level(frame):
    rng = random.Random(8)
    rows = [(i, invented(rng, "en", rng.randint(0, 40)), "en", None if i % 11 == 0 else f"s{min(i % 50, 7)}") for i in range(900)]
    planned = mixing.plan(frame(rows), (5, 2, 1), 1.5, 2.0).collect()
    again = mixing.plan(frame(rows), (5, 2, 1), 1.5, 2.0).collect()
    assert {(p.doc_id, p._mix_times) for p in planned} == {(p.doc_id, p._mix_times) for p in again}
    sizes, goal, taken = Counter(), {}, Counter()
    for p in planned:
        sizes[p.source] += p._mix_size
        goal[p.source] = p.target
        taken[p.source] += p._mix_size * p._mix_times
        assert p._mix_times <= 2
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        want.update({s: left * weight[s] / sum(weight[x] for x in free) for s in free})
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    for s in names:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 40


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4_000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")
    rows = sharding.numbered(ids, [1.0] * 16, [1.0] * 17).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 0.6 * 4_000 / 17 < moved < 1.4 * 4_000 / 17
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 16 and max(counts.values()) < 1.4 * 250
    heavy = Counter(r.shard for r in sharding.assign(ids, "doc_id", [3.0, 1.0]).collect())
    assert 0.7 < heavy[0] / 4_000 < 0.8


def test_spotsigs_equal_brute_force(frame, copies):
    got = {g.doc_id: g for g in spotsigs.compared(frame(copies)).collect()}
    order = sorted(copies, reverse=True)
    for k, (i, t, *_) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == spotsigs.written(spotsigs.signatures(t))
        a, b, c = (set(spotsigs.signatures(x).tolist()) for x in (t, edited, following))
        assert g.near_edited == len(a & b) / len(a | b) and g.near_next == len(a & c) / len(a | c)


def test_spotsigs_pairs_equal_brute_force(spark, copies):
    kinds = {}
    for i, t, *_ in copies:
        kinds.setdefault(tuple(sorted(spotsigs.signatures(t).tolist())), i)
    rows = [(i, [int(x) for x in s]) for s, i in kinds.items()]
    got = {(g.a, g.b) for g in spotsigs.near_pairs(spark.createDataFrame(rows, "id long, items array<long>")).collect()}
    sets = {i: set(s) for i, s in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 30


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 150)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    vectors = np.concatenate([base[rng.integers(0, 60, 1_400)] + 0.02 * rng.normal(size=(1_400, 6)), np.ones((600, 6))])
    vectors *= rng.choice([0.3, 1.0, 4.0], (2_000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for g in sorted(topk.top_k(frame, "vec_id % 100 = 0").collect(), key=lambda g: g.rank):
        got[g.query_id].append((g.vec_id, g.score))
    whole = np.floor(vectors * 1024).astype(np.int64)
    for q in range(0, 2_000, 100):
        scores = whole @ whole[q]
        order = sorted((i for i in range(2_000) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert got[q] == [(i, scores[i]) for i in order]


def test_top_k_of_more_buckets_than_an_int_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 1)  # 2,500 buckets; bucket 2,048 has number 2^31
    vectors = np.random.default_rng(5).integers(-50, 51, (2_500, 3)).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(frame, "vec_id % 500 = 0", k=3, scale=1).collect(), key=lambda g: (g.query_id, g.rank))
    scores = (vectors @ vectors.T).astype(np.int64)
    want = [(q, i, scores[q, i]) for q in range(0, 2_500, 500) for i in sorted((i for i in range(2_500) if i != q), key=lambda i: (-scores[q, i], i))[:3]]
    assert [(g.query_id, g.vec_id, g.score) for g in got] == want


def test_code_lengths_are_exact():
    """Probabilities of the 256 bytes after any context add up to one, and lengths to a plain walk."""
    import pandas as pd

    text = "abracadabra abracadabra"
    counted = next(iter(language._count(iter([pd.DataFrame({"lang": ["x"], "text": [text]})]))))
    trees = language.grow(counted)
    width = trees.bits.shape[2]
    p = np.exp2(-trees.bits[0].astype(float))
    own = width - 1
    assert np.allclose(p[:, :own].sum(1) + (256 - own) * p[:, own], 1, atol=1e-5)
    data = language.stream("cadabra xyz")
    s = trees.symbol[np.concatenate([np.zeros(3, np.uint8), data])]
    walk = sum(float(trees.bits[0, trees.state[(s[i - 3] * width + s[i - 2]) * width + s[i - 1]], s[i]]) for i in range(3, len(s)))
    assert trees.lengths(data)[0] == pytest.approx(walk)


def plain_code_lengths(rows):
    """Method C by dictionaries: a function of language and text that gives the text's bits."""
    counts, overall = {}, Counter()
    for text, lang in rows:
        data = b"\0\0\0" + text.lower().encode()
        for at in range(3, len(data)):
            for k in range(4):
                context = data[at - k : at]
                counts.setdefault((lang, context), Counter())[data[at]] += 1
                overall[context] += 1

    def share(lang, context, byte):
        while overall[context] < (1, 1, 2, 4)[len(context)] and context:
            context = context[1:]
        seen = counts.get((lang, context), {})
        shorter = (lambda b: share(lang, context[1:], b)) if context else (lambda b: 1 / 256)
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / total
        return (len(seen) / total if seen else 1.0) * shorter(byte) / (1 - sum(shorter(b) for b in seen))

    def bits(lang, text):
        data = b"\0\0\0" + text.lower().encode()
        return -sum(math.log2(share(lang, data[i - 3 : i], data[i])) for i in range(3, len(data)))

    return bits


def test_language_query_equals_plain_prediction_by_partial_matching(spark, frame, tmp_path):
    rng = random.Random(16)
    rows = [(i, invented(rng, lang, rng.randint(1, 12)), lang, "s") for i in range(60) for lang in [rng.choice(["en", "de", "fr"])]]
    rows += [(70, invented(rng, "de", 900), "de", "s"), rows[3], rows[3], (61, "1 2 3", "en", "s"), (62, None, "fr", "s")]
    # Bytes that nothing else has, in documents that are scored only.
    rows += [(i, t, None, "s") for i, t in enumerate(["\u0416 der", "", "\u4e2d\u6587", "Zug um Zug the le"], 63)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = language.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, lang) for i, t, lang, _ in rows if t is not None and lang and not held(i)]
    bits, langs, texts = plain_code_lengths(learned), sorted({lang for _, lang in learned}), {r[0]: r[1] for r in rows}
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == held(r.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(text) > 2_000:  # slow to walk; learned above all the same
            assert r.lang_pred == "de"
            continue
        cost = {lang: bits(lang, text) for lang in langs}
        best = min(langs, key=cost.get)
        assert r.lang_pred == best, text
        assert r.score == pytest.approx(1 / sum(2.0 ** (cost[best] - c) for c in cost.values()), rel=1e-3)


def test_language_held_out(frame):
    rng = random.Random(6)
    rows = [(i, invented(rng, lang, rng.randint(8, 60)), lang, "s") for i in range(300) for lang in [rng.choice(["en", "de", "fr"])]]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    trees = language.train(frame([r for r in rows if r not in held]))
    got = {g.doc_id: g for g in language.identify(frame(held), trees).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)


def test_language_of_few_long_documents_is_learned(frame):
    rng = random.Random(9)
    rows = [(i, invented(rng, lang, 6_000), lang, "s") for i, lang in enumerate(["en", "de", "fr"])]
    smallest = min(len(r[1].encode()) for r in rows)
    trees = language.train(frame(rows), sample_bytes=smallest // 3)
    assert trees.langs == ["de", "en", "fr"]
    counted = [(r[0], r[1][: len(r[1]) // 20], None, "s") for r in rows]
    assert {g.doc_id: g.lang_pred for g in language.identify(frame(counted), trees).collect()} == {0: "en", 1: "de", 2: "fr"}


def test_language_of_one_repeated_document_is_learned(frame):
    """Copies of a row are drawn together, or not at all; the language is learned in either case."""
    rng = random.Random(11)
    german, english = invented(rng, "de", 40), [(i, invented(rng, "en", 40), "en", "s") for i in range(50)]
    for n, doc in enumerate([None, *range(1_000, 1_019)]):
        rows = [(doc, german, "de", "s")] * (300 if n else 3_000) + english
        trees = language.train(frame(rows), sample_bytes=5_000)
        assert trees.langs == ["de", "en"]
        if n < 2:
            got = language.identify(frame(rows), trees).collect()
            assert len(got) == len(rows) and {g.lang_pred for g in got if g.doc_id == doc} == {"de"}


def test_all_of_a_small_language_is_counted(frame, monkeypatch):
    texts, seen = ["ein langer Text in Stücken, İ und ẞ " * 400, "", "kurz"], []
    monkeypatch.setattr(language, "grow", lambda counts, model_bytes: seen.append(counts))
    language.train(frame([(i, t, "de", "s") for i, t in enumerate(texts)]))
    assert seen[0]["n"].sum() == sum(len(language.stream(t)) for t in texts)


def test_quality_held_out(frame, labels):
    rng, rows, known = random.Random(9), [], []
    for i in range(500):
        good = rng.random() < 0.8
        text = ". ".join(invented(rng, "en", 12).capitalize() for _ in range(rng.randint(2, 8))) + "."
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join([invented(rng, "en", 1)] * 60)
        rows.append((i, text, "en", "s"))
        known.append((i, int(good), 0))
    got = {g.doc_id: g for g in quality.score(frame(rows), labels(known)).collect()}
    held = [k for k in known if got[k[0]].held_out]
    assert sum((got[i].score >= 0.3) == bool(good) for i, good, _ in held) >= 0.97 * len(held)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    good, bad = rng.beta(6, 2, 20_000), rng.beta(2, 6, 20_000)
    histogram = lambda x: np.histogram(x, 1_000, (0, 1))[0].astype(float)
    mixed = np.concatenate([good[:14_000], bad[:6_000]])
    assert quality.estimated_prior(histogram(good), histogram(mixed)) == pytest.approx(0.7, abs=0.04)


def test_toxicity_held_out(frame, labels):
    rng, rows, known = random.Random(10), [], []
    for i in range(600):
        words, bad = invented(rng, "en", rng.randint(10, 60)).split(), rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorbeling", "zorbelated", "scum", "krumpfish"]))
        rows.append((i, " ".join(words), "en", "s"))
        known.append((i, 1, int(bad)))
    got = {g.doc_id: g for g in toxicity.score(frame(rows), labels(known)).collect()}
    held = [k for k in known if got[k[0]].held_out]
    assert sum((got[i].score >= 0.5) == bool(bad) for i, _, bad in held) >= 0.97 * len(held)


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    first = np.where(truth, rng.random(20_000) < 0.7, rng.random(20_000) < 0.05)
    votes = [first, np.where(rng.random(20_000) < 0.95, first, ~first)]  # a voter and its echo
    votes += [np.where(truth, rng.random(20_000) < 0.6, rng.random(20_000) < 0.02) for _ in range(3)]
    masks = sum(v.astype(np.int64) << i for i, v in enumerate(votes))
    kinds, where, counts = np.unique(masks, return_inverse=True, return_counts=True)
    anchors = np.zeros((len(kinds), 2))
    np.add.at(anchors, (where[:500], truth[:500].astype(int)), 1)
    model = toxicity.LabelModel(5).fit(kinds, counts.astype(float), anchors)
    parents = model.trees[1][0]
    assert parents.get(1) == 0 or parents.get(0) == 1
    assert model.prior[1] == pytest.approx(0.2, abs=0.03)
    assert ((model.posterior(kinds)[where] > 0.5) == truth).mean() > 0.93


def test_licenses_of_planted_notices(frame):
    rng = random.Random(12)
    planted = {i: f for i, f in enumerate(sorted(licenses.NAMES) * 2)}
    rows = []
    for i in range(200):
        lines = [invented(rng, "en", rng.randint(3, 90)) for _ in range(3)]
        if i in planted:
            lines.insert(1, f"This project is licensed under the {licenses.NAMES[planted[i]][0].removeprefix('the ')}.")
        rows.append((i, "\n".join(lines), "en", "s"))
    got = licenses.scan(frame(rows)).where("confirmed").collect()
    assert {(g.doc_id, g.paragraph, g.family) for g in got} == {(i, 1, f) for i, f in planted.items()}


#: Standard paragraphs of five licences.
STANDARD = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def test_licenses_in_prose_wrapped_and_in_blocks(frame):
    """Notices between words, over a line break and as standard paragraphs; clean texts name none."""
    rng, rows, want = random.Random(7), [], {}

    def add(text, family, kind):
        want[len(rows)] = family, kind
        rows.append((len(rows), text, "en", "s"))

    for family in sorted(licenses.NAMES) * 2:
        for name in licenses.NAMES[family]:
            notice = f"This project is licensed under the {name.removeprefix('the ')}.".split()
            before, after = invented(rng, "en", 40), invented(rng, "en", 40)
            add(" ".join([before, *notice, after]), family, "within")
            add(" ".join([before, *notice[:-2]]) + "\n" + " ".join([*notice[-2:], after]), family, "wrapped")
    for family, text in STANDARD.items():
        for block in (text, textwrap.fill(text, 72), textwrap.indent(textwrap.fill(text, 70), "# ")):
            add(block, family, "block")
            add(invented(rng, "en", 50) + "\n" + block + "\n" + invented(rng, "en", 50), family, "block within")
    for _ in range(200):
        add("\n".join(invented(rng, rng.choice(["en", "de", "fr"]), rng.randint(3, 200)) for _ in range(4)), None, "clean")
    both = "Released under the MIT License.\nReleased under the Apache License 2.0.\n" + invented(rng, "en", 90) + "\nISC License"
    rows += [(None, both, "en", "s"), (None, rows[0][1], "en", "s"), (None, rows[0][1], "en", "s")]
    got = defaultdict(set)
    for g in licenses.scan(frame(rows)).where("confirmed").collect():
        got[g.doc_id].add((g.family, g.paragraph))
    assert not {i for i, (family, _) in want.items() if {f for f, _ in got[i]} - {family}}
    for kind in ("within", "wrapped", "block", "block within"):
        these = [i for i, (_, k) in want.items() if k == kind]
        assert sum(bool(got[i]) for i in these) >= 0.95 * len(these), kind
    assert got[None] == {("MIT", 0), ("Apache-2.0", 1), ("ISC", 3), (want[0][0], 0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the supplied tables")
def test_pipeline_equals_its_parts(spark):
    """Each stage against its operator's decisions on the same rows, and the packed end by a round trip."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, folder, "documents")
    labels = corpus_pipeline.table(spark, folder, "labels")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())

    good = corpus_pipeline.store(stages["quality"](spark, docs, folder), "test")
    assert good.columns == columns and ids(good) == ids(quality.score(docs, labels).where("score >= 0.3"))
    clean = corpus_pipeline.store(stages["toxicity"](spark, good, folder), "test")
    assert clean.columns == columns and ids(clean) == ids(toxicity.score(good, labels).where("score < 0.5"))
    single = corpus_pipeline.store(stages["near_duplicates"](spark, clean, folder), "test")
    sets = {r.doc_id: shingled(r.text) for r in clean.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = joined_by(links, sets)
    assert single.columns == columns and ids(single) == sorted(i for i in sets if roots[i] == i)
    mixed = corpus_pipeline.store(stages["mixing"](spark, single, folder), "test")
    times = Counter({p.doc_id: p._mix_times for p in mixing.plan(single, (5, 2, 1), 1.5, 2.0).collect()})
    assert mixed.columns == columns and Counter(ids(mixed)) == +times
    packed = corpus_pipeline.store(stages["packing"](spark, mixed, folder), "test").collect()
    encode = packing.encoder(VOCABULARY)
    assert sum(p.length for p in packed) == sum(len(encode(r.text or "")) + 1 for r in mixed.collect())
    assert Counter(p.doc_id for p in packed if p.start == 0) == Counter(ids(mixed))

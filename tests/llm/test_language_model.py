import cProfile
import math
import pstats
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import language_model as lm

DOCS = "doc_id long, text string, score double, token long"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def tokens(text):
    return (text or "").encode().lower().split() + [lm.END]


def corpus():
    draw = random.Random(6)
    out = []
    for i in range(300):
        # each word all but settles the next one; some words are rare
        words = [f"w{draw.randint(0, 39)}"]
        for _ in range(draw.randint(10, 60)):
            words.append(f"w{(int(words[-1][1:]) * 7 + 3) % 40}" if words[-1][0] == "w" and draw.random() < 0.9 else draw.choice(["Rare", f"r{draw.randint(0, 99)}", f"w{draw.randint(0, 39)}"]) if words[-1][0] == "w" else f"w{draw.randint(0, 39)}")
        out.append((i, " ".join(words)))
    return out + [(900, None), (901, ""), (None, "w1 w2"), (7, out[7][1]), (902, "new" * 5 + " unseen unseen")]


def vocabulary(texts):
    counts = Counter(w for t in texts for w in tokens(t))
    token, c = np.array([lm.token_hash(w) for w in counts]), np.array(list(counts.values()))
    by = np.lexsort((token, -c))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    order = np.argsort(token)
    return lm.Vocabulary(token[order], rank[order], c[by], int(c.sum()), len(c))


@pytest.mark.parametrize("head", [300_000, 30, 0], ids=["all in the head", "most through the join", "no head"])
def test_base_equals_direct_and_score_beats_it(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "BATCH", 256)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], DOCS).repartition(2)
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.language_model_scores(docs).collect()}
    gains = []
    for i, t in rows:
        r = got[i, len(tokens(t))]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t))
        assert (r["n_known"], r["train_tokens"], r["held_out"]) == (sum(counts[w] > 0 for w in tokens(t)), total, held(i))
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
        if held(i) and t and i < 900:
            gains.append((r["score"] - r["base_score"]) / len(tokens(t)))
    assert lm.language_model_scores(docs).count() == len(rows)
    if head == 300_000:
        assert len(gains) > 40 and np.mean(gains) > 0.1 and np.mean(np.array(gains) > 0) > 0.95


def test_score_equals_a_plain_loop():
    texts = [t.encode() if t else t for _, t in corpus()[:40]] + [None, b"", b"never seen before"]
    known = vocabulary(t.decode() if t else t for t in texts[:30])
    model, codes = lm.LogBilinear(known), lm.Codes(known)
    draw = np.random.default_rng(2)
    model.rows[:] = draw.normal(0, 0.5, model.rows.shape)
    model.rows[model.pad] = 0
    model.rows[model.at_word + known.words :, lm.WIDTH] = -1e4
    n, in_head, base, score, tail, times = lm.head_scores(model, codes, texts)
    names = {int(t): int(r) for t, r in zip(known.token, known.rank)}
    for k, text in enumerate(texts):
        line, want = [model.pad] * lm.ORDER, 0.0
        for word in tokens(text.decode() if text else text):
            code = lm.token_hash(word)
            rank = names.get(code, -1)
            query = sum(model.rows[line[-1 - i], : lm.WIDTH] * model.rows[model.at_distance + i, : lm.WIDTH] for i in range(lm.ORDER))
            query = np.append(query, 1)
            in_model = 0 <= rank < known.words
            kind = rank // known.per_class if in_model else known.classes
            s = np.array([query @ model.rows[model.at_class + c] for c in range(known.classes + 1)])
            want += (s[kind] - np.log(np.exp(s).sum())) / np.log(10)
            if in_model:
                first = kind * known.per_class
                s = np.array([query @ model.rows[model.at_word + first + j] for j in range(known.per_class) if first + j < known.words])
                want += (s[rank - first] - np.log(np.exp(s).sum())) / np.log(10)
            elif rank >= 0:
                want += math.log10((known.c[rank] + 0.5) / known.rest_mass)
            line.append(rank if in_model else known.rest + (rank if rank >= 0 else code) % lm.SHARED)
        assert abs(score[k] - want) < 1e-3 * max(1, abs(want))
        assert sum(times[k].as_py()) == n[k] - in_head[k] and len(set(tail[k].as_py())) == len(tail[k].as_py())


def test_probabilities_sum_to_one():
    known = vocabulary([t for _, t in corpus()])
    model = lm.LogBilinear(known)
    model.rows[: model.at_class] += 0.3
    query = np.ones((1, lm.WIDTH + 1), np.float32) * 0.4
    every = np.append(np.arange(known.words), known.rest)
    assert abs(np.exp(model.log_probability(np.repeat(query, len(every), axis=0), every)).sum() - 1) < 1e-4


def test_noise_contrastive_training_learns():
    texts = [b" ".join([b"a", b"b", b"c", b"d"] * 400)] * 3
    known = vocabulary([t.decode() for t in texts])
    model, codes, draw = lm.LogBilinear(known), lm.Codes(known), np.random.default_rng(3)
    before = lm.head_scores(model, codes, texts[:1])[3][0]
    for _ in range(60):
        lm.learn_texts(model, codes, texts, draw)
    assert lm.head_scores(model, codes, texts[:1])[3][0] > before / 4 > before


def test_every_training_token_is_a_target():
    texts = [b"a b c a b", None, b"", b" ".join(b"w%d" % (i % 40) for i in range(20_000))]
    known = vocabulary([t.decode() if t else t for t in texts])
    seen = []

    class Recording(lm.LogBilinear):
        def step(self, line, target, draw):
            seen.extend(target[lm.ORDER :][target[lm.ORDER :] >= 0].tolist())
            return super().step(line, target, draw)

    codes = lm.Codes(known)
    n = lm.learn_texts(Recording(known), codes, texts, np.random.default_rng(1))
    code, _ = codes.encode(texts)
    assert n == len(code) == 20_009 and Counter(seen) == Counter(np.where(code < known.words, code, known.rest).tolist())


def test_head_is_all_tokens_from_a_count_on(spark):
    counts = spark.createDataFrame([(i, 1 + i % 50) for i in range(1000)], "token long, c long")
    for most in (0, 19, 20, 500, 5000):
        known = lm.head_of(counts, most)
        assert len(known.token) <= most and (known.n, known.distinct) == (sum(1 + i % 50 for i in range(1000)), 1000)
        assert all(np.diff(known.c) <= 0) and sorted(known.c)[:1] in ([], [min(known.c, default=0)])
        if len(known.c):
            assert len(known.c) == sum(1 + i % 50 >= known.c[-1] for i in range(1000))
    empty = lm.head_of(counts.limit(0))
    assert (empty.n, empty.distinct, empty.words) == (0, 0, 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert lm.language_model_scores(docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b", 0.5, 1) for i in range(60) if held(i)], DOCS)
    assert {(r["n_known"], r["train_tokens"]) for r in lm.language_model_scores(only_held).collect()} == {(0, 0)}


def test_small_partitions_do_not_make_the_model_vanish(spark):
    draw = random.Random(21)
    words = [f"v{i}" for i in range(60)]
    after = {w: draw.sample(words, 3) for w in words}

    def text():
        out = [draw.choice(words)]
        while len(out) < 120:
            out.append(draw.choice(after[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    gain = {}
    for n in (1, 24):
        scored = lm.language_model_scores(docs.repartition(n)).where("held_out")
        gain[n] = scored.select(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    assert gain[1] > 0.15 and abs(gain[24] - gain[1]) < 0.1 * gain[1], gain


def test_tokens_cost_no_calls_of_their_own():
    draw = random.Random(8)
    texts = [" ".join(f"x{draw.randrange(40_000)}" for _ in range(20_000)).encode() for _ in range(8)]
    known = vocabulary(t.decode() for t in texts[:4])
    model, codes = lm.LogBilinear(known), lm.Codes(known)
    profile = cProfile.Profile()
    profile.enable()
    n = lm.learn_texts(model, codes, texts, np.random.default_rng(1))
    lm.head_scores(model, codes, texts)
    profile.disable()
    assert n == 160_008 and pstats.Stats(profile).total_calls < 0.3 * n


def test_a_step_follows_the_gradient_of_a_plain_loop(monkeypatch):
    texts = [t.encode() if t else t for _, t in corpus()[:12]] + [None, b"never seen before", b"w1 w2 w3"]
    known = vocabulary(t.decode() if t else t for t in texts[:8])
    model, codes = lm.LogBilinear(known), lm.Codes(known)
    model.rows[:] = np.random.default_rng(2).normal(0, 0.4, model.rows.shape)
    model.rows[model.pad] = 0
    line, target, _ = model.layout(*codes.encode(texts), codes.tail)
    rows, want = model.rows.astype(float), np.zeros(model.rows.shape)
    draw = np.random.default_rng(9)
    kinds = np.minimum(np.searchsorted(np.cumsum(model.class_noise), draw.random(lm.NOISE), "right"), known.classes)
    low = model.cumulated[np.arange(known.classes) * known.per_class]
    mass = model.cumulated[(np.arange(known.classes) + 1) * known.per_class] - low
    inside = np.searchsorted(model.cumulated, low[:, None] + draw.random((known.classes, lm.NOISE)) * mass[:, None], "right") - 1
    inside = np.minimum(inside, known.words - 1)
    for t in range(lm.ORDER, len(line)):
        if target[t] < 0:
            continue
        near, weight = rows[line[t - 1 - np.arange(lm.ORDER)], : lm.WIDTH], rows[model.at_distance : model.at_class, : lm.WIDTH]
        query = np.append((near * weight).sum(axis=0), 1)
        kind = target[t] // known.per_class
        pairs = [(model.at_class + kind, model.class_chance[kind], 1)] + [(model.at_class + k, model.class_chance[k], 0) for k in kinds]
        if target[t] < known.rest:
            pairs += [(model.at_word + target[t], model.word_chance[target[t]], 1)] + [(model.at_word + w, model.word_chance[w], 0) for w in inside[kind]]
        back = np.zeros(lm.WIDTH + 1)
        for row, chance, real in pairs:
            pull = real - 1 / (1 + math.exp(-(query @ rows[row] - chance)))
            want[row] += pull * query
            back += pull * rows[row]
        for i in range(lm.ORDER):
            want[line[t - 1 - i], : lm.WIDTH] += back[: lm.WIDTH] * weight[i]
            want[model.at_distance + i, : lm.WIDTH] += back[: lm.WIDTH] * near[i]
    want[model.pad] = 0
    got = np.zeros(model.rows.shape)
    monkeypatch.setattr(model, "_ascend", lambda rows, gradient: np.add.at(got, rows, gradient))
    for _ in range(2):  # what a step keeps between calls doesn't reach the next one
        got[:] = 0
        assert model.step(line, target, np.random.default_rng(9)) == (target >= 0).sum()
        assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_sums_out_of_reach_are_exact():
    known = vocabulary([t for _, t in corpus()])
    model = lm.LogBilinear(known)
    query = np.ones((6, lm.WIDTH + 1), np.float32) * np.array([[-40], [-8], [0.1], [1], [8], [40]], np.float32)
    model.rows[model.at_class : model.at_word, lm.WIDTH] = 5
    own = np.arange(6) % (known.classes + 1)
    score = query.astype(float) @ model.rows[model.at_class : model.at_word].astype(float).T
    most = score.max(axis=1)
    want = score[np.arange(6), own] - most - np.log(np.exp(score - most[:, None]).sum(axis=1))
    assert most.max() > 90 and most.min() < -90
    assert np.allclose(model._log_softmax(query, model.at_class, known.classes + 1, own), want, rtol=1e-4, atol=1e-4)


def test_ranks_and_counts_equal_direct():
    draw = np.random.default_rng(4)
    ends = np.array([np.iinfo(np.int64).min, -1, 0, 1, np.iinfo(np.int64).max])
    for token in (draw.integers(-(1 << 63), (1 << 63) - 1, 3000), np.arange(-500, 500) * 3, ends, ends[:0]):
        token = np.unique(token)
        rank = draw.permutation(len(token))
        known = lm.Vocabulary(token, rank, np.ones(len(token), np.int64), len(token), len(token))
        asked = np.concatenate([token, token[:-1] + 1, draw.integers(-2000, 2000, 500), ends])
        names = dict(zip(token.tolist(), rank.tolist()))
        assert known.ranks(asked).tolist() == [names.get(x, -1) for x in asked.tolist()]
    texts = [["a B b", None, ""], ["b \x0bc\x00 c"], ["", "\u00c4 \u00e4 A"]]
    found = Counter()
    for made in lm._count(iter([pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in texts])):
        found.update(dict(zip(*(c.to_pylist() for c in made.columns))))
    assert found == Counter(lm.token_hash(w) for t in texts for x in t for w in tokens(x))

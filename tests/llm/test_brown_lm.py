import math
import random
import zlib
from collections import Counter

import numpy as np
from meridion.llm import brown_lm
from meridion.llm.brown_lm import _from_planes, _planes, op1_brown_class_lm, score_documents
from pyspark.sql import functions as F


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_query_base_and_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d in docs if not held[d.doc_id] for w in words(d.text))
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in op1_brown_class_lm(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r, w = rows[d.doc_id], words(d.text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d.doc_id], len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_add_up():
    """After any class all classes, and within a class its words and its place for an unknown one, have probability one."""
    names = [("a", 0, 9), ("b", 1, 5), ("c", 2, 4)]
    of = np.concatenate([[0, 1, 0], 2 + np.arange(brown_lm.LOOKS)])
    rest = {3: (7, 2), 10: (1, 1)}
    m = np.zeros((2 + brown_lm.LOOKS, 2 + brown_lm.LOOKS))
    m[0, 1], m[1, 0], m[5, 0] = 6, 3, 2
    transition, within = brown_lm.smoothed(m, of, names, rest, 2)
    assert np.allclose((10**transition).sum(axis=1), 1)
    words = {0: [9, 4], 1: [5], 2 + 3: [4, 3, 0], 2 + 10: [1, 0], 2 + 20: [0]}  # counts; 0: the unknown word
    for c, counts in words.items():
        assert math.isclose(sum((n + 1) / 10 ** within[c] for n in counts), 1)


def test_deterministic_and_counts_grow(spark):
    df = spark.createDataFrame([(i, f"the cat{i % 5} sat on mat{i % 3} .", i % 4 == 0) for i in range(80)], "doc_id long, text string, h boolean")
    a = sorted(map(tuple, score_documents(df, F.col("h"), classes=4, rounds=4).collect()))
    b = sorted(map(tuple, score_documents(df.repartition(3), F.col("h"), classes=4, rounds=4).collect()))
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[6] for x in a], [x[6] for x in b])
    assert sum(x[6] for x in a) > sum(x[5] for x in a)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, "A  b"), (2, "A  b"), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS held")
    rows = sorted(map(tuple, score_documents(df, F.col("doc_id") == 3).collect()), key=repr)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == sorted([(1, False, 1, 1, 10), (None, False, 3, 3, 10), (2, False, 3, 3, 10), (2, False, 3, 3, 10), (3, True, 1, 1, 10)], key=repr)
    assert score_documents(df.limit(0), F.lit(False)).count() == 0
    nothing = score_documents(df, F.lit(True)).collect()
    assert len(nothing) == 5 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def test_planes_round_trip():
    a = np.array([0, 1, 255, 256, 1 << 20, (1 << 32) - 1], np.uint32)
    assert (_from_planes(_planes(a)) == a).all() and len(brown_lm._planes(a[:0])) == 0


def test_exchange_makes_training_tokens_more_likely_round_by_round(spark, monkeypatch):
    from meridion.llm import brown_lm

    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(12)] for c in ("noun", "verb", "adj")]
    texts = [" ".join(rng.choice(kinds[k % 3]) for k in range(30)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    plain = brown_lm.smoothed
    monkeypatch.setattr(brown_lm, "smoothed", lambda m, *rest: seen.append(brown_lm.likelihood(m)) or plain(m, *rest))
    totals = []
    for rounds in (0, 1, 2, 4, 8):
        rows = brown_lm.score_documents(df, F.lit(False), classes=4, rounds=rounds).collect()
        totals.append(sum(r.score for r in rows))
    assert seen == sorted(seen) and seen[-1] > seen[0]
    assert totals[-1] > totals[0]


def _plain(rows, classes, most_words):
    """The model of one round of the rarer words and none of the frequent ones, word by word; (score by row, rarer words that moved)."""
    texts = [(i, words(t), h) for i, t, h in rows]
    count = Counter(w for _, t, h in texts if not h for w in t)
    total = sum(count.values())
    often = sorted((w for w in count if count[w] * most_words >= total), key=lambda w: (-count[w], w))
    n = classes + brown_lm.LOOKS
    look = {w: classes + (0 if w == b"\n" else brown_lm._looks(w)) for _, t, _ in texts for w in t}
    of = dict(look) | {w: k % classes for k, w in enumerate(often)}
    pairs = Counter((a, b) for _, t, h in texts if not h for a, b in zip([t[-1], *t], t))

    def matrix():
        m = np.zeros((n, n))
        for (a, b), k in pairs.items():
            m[of[a], of[b]] += k
        return m

    m = matrix()
    p = np.log((m + 0.1) / (m.sum(axis=1, keepdims=True) + 0.1 * n))
    share = np.log(m.sum(axis=0) + 1.0)
    move = {}
    for w in sorted(set(count) - set(often)):
        gain = sum(k * (p[of[a]] - share) for (a, b), k in pairs.items() if b == w) + sum(k * p[:, of[b]] for (a, b), k in pairs.items() if a == w)
        best = int(gain[:classes].argmax())
        move[w] = best if gain[best] > gain[look[w]] else look[w]
    assert not set(move) & set(often)
    start = brown_lm.likelihood(m)
    of |= move
    m = matrix()
    assert brown_lm.likelihood(m) >= start
    once = np.zeros((n, n))
    for (a, b), k in pairs.items():
        if count[b] == 1 and b not in often:
            once[of[a], look[b]] += k
    tokens, kinds = np.zeros(n), np.zeros(n)
    for w, c in count.items():
        tokens[of[w]] += c
        kinds[of[w]] += 1
    places = np.concatenate([np.zeros(classes), np.ones(brown_lm.LOOKS)]) + once.sum(axis=0)
    usual = np.where(kinds + places > 0, tokens + once.sum(axis=0) + 1, 0)
    after = (m + once + n * usual / usual.sum()) / ((m + once).sum(axis=1, keepdims=True) + n)
    assert np.allclose(after.sum(axis=1), 1)
    score = {i: sum(math.log10(after[of[a], of[b]] * (count[b] + 1) / max(1, (tokens + kinds + places)[of[b]])) for a, b in zip([t[-1], *t], t)) for i, t, _ in texts}
    return score, sum(move[w] != look[w] for w in move)


def test_rarer_words_move_as_in_a_plain_model(spark, monkeypatch):
    """Every word met in training is exchanged; in many buckets and batches as in one."""
    rng = random.Random(5)
    kinds = [[f"{c}{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(40)] for c in ("no", "ve", "ad")]
    rows = [(i, " ".join(rng.choice(kinds[k % 3][: rng.choice((3, 40))]) for k in range(rng.randrange(1, 40))) + f" once{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", i % 7 == 2) for i in range(100)]
    want, moved = _plain(rows, 3, 30)
    assert moved > 30
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    for bucket_words, batch_bytes in ((10**6, 1 << 20), (20, 600)):
        monkeypatch.setattr(brown_lm, "BUCKET_WORDS", bucket_words)
        monkeypatch.setattr(brown_lm, "BATCH_BYTES", batch_bytes)
        got = {r.doc_id: r.score for r in score_documents(df, F.col("h"), classes=3, rounds=0, most_words=30, rare_rounds=1).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want), bucket_words

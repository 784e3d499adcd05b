import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meridion.llm import periodic_runs
from meridion.llm.periodic_runs import WORDS, find_runs, op12_periodic_runs, runs_of


def plain_runs(words):
    """All runs by comparing every period at every place."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))  # the smallest period of a stretch comes first
                found.append((i, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in found)


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def found(texts):
    out = [[] for _ in texts]
    for t, s, n, q in zip(*runs_of([[w.encode() for w in t] for t in texts]), strict=True):
        out[t].append((int(s), int(n), int(q)))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=70), max_size=4))
def test_equals_plain_on_few_letters(texts):
    assert found(texts) == [plain_runs(t) for t in texts]


def test_equals_plain_on_planted_periods():
    rng, texts = random.Random(5), []
    for _ in range(300):
        t = []
        for _ in range(rng.randint(1, 6)):
            root = rng.choices("abcdefgh", k=rng.randint(1, 12))
            t += (root * rng.randint(1, 7))[: rng.randint(1, 90)] + rng.choices("abcdefghijkl", k=rng.randint(0, 5))
        texts.append(t)
    assert found(texts) == [plain_runs(t) for t in texts]
    assert sum(map(len, found(texts))) > 300


def test_long_periods_in_a_long_text():
    root = [f"w{k}" for k in range(30_000)]
    assert found([["x", *root * 4, "y"], root * 3, ["la"] * 100_000]) == [[(1, 120_000, 30_000)], [], [(0, 100_000, 1)]]


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_nulls_white_space_repeats_and_clashing_columns(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK_BYTES", block)
    texts = [None, "", " \t\n", "a b " * 5, "ha " * 6, "ha " * 6, "x\x0by\x0cz\r" * 4, "one two", "é " * 7 + " "]
    rows = [(None if k == 1 else k, t, "r", 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, runs string, n_words int")
    got = find_runs(df).collect()
    assert sorted(((r.row.id, r.row.runs, r.row.n_words) for r in got), key=str) == sorted(((r[0], "r", 7) for r in rows), key=str)
    by = {r.row.id: r for r in got}
    for k, t in enumerate(texts):
        words = re.findall(WORDS, t or "")
        r = by[None if k == 1 else k]
        assert [tuple(x) for x in r.runs] == plain_runs(words)
        assert r.n_words == len(words) and r.collapsed == plain_collapsed(words, plain_runs(words))
    assert by[4].collapsed == "ha" and by[6].collapsed == "x y z"
    assert find_runs(df.limit(0)).count() == 0
    assert find_runs(df.select("text")).count() == len(texts)


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    periodic = 0
    for d in docs:
        w, h = re.findall(WORDS, d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        # Only words that are there four times can be in a run; the plain search would take too long on all.
        runs = plain_runs(w) if n < 1500 else found([w])[0]
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(plain_collapsed(w, runs))
        periodic += h % 10 == 0 and bool(runs)
    assert periodic > 3

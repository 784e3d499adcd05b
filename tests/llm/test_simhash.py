import random
from collections import Counter

import pytest
import xxhash
from meridion.llm import simhash_dedup
from meridion.llm.simhash_dedup import fingerprints, links, near_copies, near_duplicates, op5_simhash_near_dedup
from meridion.operators.components import connected_components
from pyspark.sql import functions as F


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, radius=2):
    """Smallest id by brute force."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = {}
    for i, d in enumerate(ids):
        if d is not None:
            out[find(i)] = min(out.get(find(i), d), d)
    return [out.get(find(i)) for i in range(len(ids))]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, groups([d.doc_id for d in docs], fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_near_dedup(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("radius,limit", [(2, 2), (2, 100), (3, 2), (3, 100)])
def test_links_have_the_components_of_all_pairs(spark, radius, limit):
    rng = random.Random(7)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(14)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in connected_components(links(df, radius, limit)).collect()}
    want = groups(fps, [f & (1 << 64) - 1 for f in fps], radius)
    assert [got.get(f, f) for f in fps] == want


def test_nulls_ties_and_empty(spark):
    rows = [(3, None), (1, " \n"), (None, ""), (None, "only here"), (5, "A b c d"), (5, "a B c d"), (4, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_duplicates(df).collect()), key=str)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = sorted(((d, signed(plain(t)), c) for (d, t), c in zip(rows, [1, 1, 1, None, 4, 4, 4], strict=True)), key=str)
    assert got == want
    assert near_duplicates(df.limit(0)).count() == 0
    assert fingerprints(df).count() == len(rows)


def word_fingerprint(text):
    counts = Counter((text or "").encode().lower().split())
    weigh = {w: n.bit_length() for w, n in counts.items()}
    hashes = {w: xxhash.xxh64(w, seed=42).intdigest() for w in counts}
    return sum(1 << b for b in range(64) if 2 * sum(weigh[w] for w in counts if hashes[w] >> b & 1) > sum(weigh.values()))


def copy_groups(ids, texts, radius=6, check=12):
    """Smallest id of each group of edited copies by brute force."""
    fps, root = [(word_fingerprint(t), plain(t)) for t in texts], list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i][0] ^ fps[j][0]).bit_count() <= radius and (fps[i][1] ^ fps[j][1]).bit_count() <= check:
                root[find(i)] = find(j)
    out = {}
    for i, d in enumerate(ids):
        if d is not None:
            out[find(i)] = min(out.get(find(i), d), d)
    return [out.get(find(i)) for i in range(len(ids))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("joined,compared", [(32, 2048), (2, 7)])
def test_edited_copies_equal_brute_force(spark, monkeypatch, joined, compared):
    """Also where every key is too large to be joined, and with nulls, empty texts, repeats and clashing columns."""
    rng = random.Random(3)
    bases = [[rng.choice("abcdefghij") * 2 + str(rng.randrange(400)) for _ in range(150)] for _ in range(25)]
    texts = [edited(rng, b, rng.randrange(8)) for b in bases for _ in range(7)] + [None, "", " ", " ".join(bases[0]), " ".join(bases[0])]
    ids = [None if k == 5 else k * 3 % 500 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, node int")
    monkeypatch.setattr(simhash_dedup.wide_components, "__defaults__", (6, 12, 3, joined, compared))
    got = Counter((r.doc_id, r.component_id) for r in near_copies(df).collect())
    assert got == Counter(zip(ids, copy_groups(ids, texts), strict=True))
    assert near_copies(df.limit(0)).count() == 0


def test_edited_copies_recall(spark):
    """Of pairs whose five-word shingles are at least 0.8 alike, nine in ten or more meet; unrelated texts do not."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        words = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), edited(rng, words, rng.randrange(1, 7))]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [k for k in range(0, 600, 2) if len(shingles[k] & shingles[k + 1]) >= 0.8 * len(shingles[k] | shingles[k + 1])]
    assert len(alike) > 200
    assert sum(got[k] == got[k + 1] for k in alike) >= 0.9 * len(alike)
    assert all(got[k] // 2 == k // 2 for k in got)

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from meridion.llm import packing
from meridion.llm.packing import VOCABULARY, WINDOW, ShardIndex, WordEncoder, op9_retrieval_packing, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path(VOCABULARY)
ODD = [
    "", " ", "Hello, WORLD!!", "it's I'LL we're 's", "a<|endoftext|>b <|ENDOFTEXT|>", "<|startoftext|>.", "x-. y_, z1;", "ÉÈ, été! ςΣ. é, ́.", "ab cd\x1fef\x85gh",
    "你好, 世界。", "1,234.5", "foo-,", "İ. ıI!", "²,", "a b|", "###", "***$$$ %%%", "A", "aB.", "\x00.", "'s.", "don't.", "ǅ. ﬁ,", "ÉTÉ été e\u0301t ΑΣ Σ ªº ß ẞ ŉ ǰ ﬀ 한국어 \u1112\u1161 𝐀𝐁 Ⅷ",
]


def library(texts):
    tk = Tokenizer.from_file(PATH)
    return [tk.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_words_encode_as_whole_texts():
    texts = [*ODD, " ".join(ODD), "\n".join(reversed(ODD))]
    encoder = WordEncoder(PATH, 1)
    assert encoder.by_word
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(texts)] == library(texts)


def check(rows, want):
    """want: ids of each document by id, as often as it occurs."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for key, copies in want.items():
        assert sum(p.length for p in pieces[key]) == sum(map(len, copies))
        for p in pieces[key]:
            assert any(len(c) == p.doc_tokens and zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for c in copies)
    total = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= WINDOW
        total += at
    return total / (len(sequences) * WINDOW)


def test_query_packs_each_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], ([x] for x in library([d.text or "" for d in docs])), strict=True))
    rows = op9_retrieval_packing(spark, sf_dir).collect()
    assert check(rows, want) > 0.98


def test_nulls_repeats_clashes_and_empty(spark):
    from meridion.llm.packing import digest

    long = "word " * 6000
    df = spark.createDataFrame([(1, None, 1), (None, "ab c", 2), (2, long, 3), (2, long, 3), (3, "", 4)], "doc_id long, text string, shard int")
    a, b = library(["ab c", long])
    check(digest(pack(df, PATH, shard_bytes=20000)).collect(), {1: [[1]], 3: [[1]], None: [a], 2: [b, b]})
    assert pack(df.limit(0), PATH).count() == 0


def test_neighbours_rank_as_bm25():
    docs = [np.array(x, "<u2") for x in ([5, 6, 7], [5, 6, 8], [9, 9], [5, 1, 1, 1], [6, 5, 7])]
    index = ShardIndex(docs)
    index.unused[0] = False
    n, avg = len(docs), sum(map(len, docs)) / len(docs)

    def score(d):
        out = 0.0
        for t in (5, 6, 7):
            df = sum(t in x for x in docs)
            tf = int((docs[d] == t).sum())
            out += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))
        return out

    assert index.neighbours(0, 10) == sorted((d for d in (1, 3, 4)), key=lambda d: (-score(d), d))


@pytest.mark.parametrize("most_sent", [4096, 0])
def test_shards_are_dealt_by_retrieval_over_the_whole_corpus(spark, monkeypatch, most_sent):
    """Documents on one subject lie in few shards although their ids and texts hash anywhere; all weigh terms alike."""
    monkeypatch.setattr(packing, "PIVOTS", 16)
    words = [f"{a}{b}" for a in ("water", "stone", "paper", "light", "green", "sound", "north", "glass") for b in ("house", "field", "works", "road", "man", "line")]
    subjects = [words[k * 6 : k * 6 + 6] for k in range(8)]
    texts = [" ".join(subjects[i % 8][(i * j + j) % 6] for j in range(1, 40)) + f" number {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = pack(df, PATH, window=256, shard_bytes=20_000, most_sent=most_sent).select("doc_id", "sequence_id").collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.doc_id].add(r.sequence_id >> 32)
    assert set(shards) == set(range(400)) and all(len(s) == 1 for s in shards.values())
    assert len(set.union(*shards.values())) >= 5
    together = 0
    for k in range(8):
        at = [next(iter(shards[i])) for i in range(k, 400, 8)]
        together += max(at.count(s) for s in set(at))
    # A hash of the id leaves about a fifth of a subject in its best shard.
    assert together > 0.6 * 400


def test_equal_documents_and_oversized_parts_are_dealt_evenly(spark):
    from meridion.llm.packing import digest

    texts = ["copy of one text " * 30] * 300 + [f"other text {i} about {i * 7} things " * 20 for i in range(100)]
    df = spark.createDataFrame([(i % 350, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = defaultdict(list)
    for i, t in enumerate(library(texts)):
        want[i % 350].append(t)
    rows = pack(df, PATH, shard_bytes=16_000)
    held = Counter(r.sequence_id >> 32 for r in rows.select("sequence_id", "doc_id").collect())
    assert max(held.values()) < 100
    check(digest(rows).collect(), want)


def test_shard_index_takes_the_statistics_of_the_corpus():
    from meridion.llm.packing import CorpusStatistics

    docs = [np.array(x, "<u2") for x in ([5, 6], [5, 8], [6, 9])]
    df = np.zeros(10, np.int64)
    df[[5, 6, 8, 9]] = 900, 2, 5, 5
    index = ShardIndex(docs, CorpusStatistics(1000, 2.0, df))
    index.unused[0] = False
    assert index.neighbours(0, 10) == [2, 1]  # 5 is rare in the shard only as 6 is


def test_window_draws_neighbours_until_it_is_full():
    """More than 48 short neighbours fill a window, and one behind 48 that do not fit is taken; unrelated ones are not."""
    far = [np.full(12, 9, "<u2")] * 80
    near = [np.array([5, 6], "<u2")] * 90
    docs = [np.array([5] * 30, "<u2"), *far, *near]
    first = [d for d, _, _, q, _ in packing.pack_shard(docs, 200) if q == 0]
    assert first[0] == 0 and len(first) == 86 and all(d > 80 for d in first[1:])
    # the seed leaves room for 4: 60 better ones are too long
    docs = [np.array([5] * 196, "<u2"), *[np.array([5] * 6, "<u2")] * 60, *[np.array([7] * 4, "<u2")] * 3, np.array([5, 7, 7, 7], "<u2")]
    assert [d for d, _, _, q, _ in packing.pack_shard(docs, 200) if q == 0] == [0, 64]


def test_all_terms_of_a_seed_count():
    seed = np.arange(2, 60, dtype="<u2")
    docs = [seed, *[np.array([t], "<u2") for t in range(2, 60)], np.array([99], "<u2")]
    index = ShardIndex(docs)
    index.unused[0] = False
    assert index.neighbours(0, 100) == list(range(1, 59))


def test_best_neighbour_that_does_not_fit_is_cut():
    docs = [np.array([5, 6, 7, 8, 5, 6], "<u2"), np.array([5, 6, 7, 8, 9, 9], "<u2"), np.array([5] + [9] * 20, "<u2"), np.array([5, 6, 7, 8], "<u2")]
    rows = packing.pack_shard(sorted(docs, key=len, reverse=True), 24)
    assert sum(n for _, _, n, *_ in rows) == sum(map(len, docs))
    # long [5, 9..] is the seed; of the others the best that fits no more is cut at the window's end
    assert [(o, n) for _, _, n, q, o in rows if q == 0][-1][0] + [n for _, _, n, q, _ in rows if q == 0][-1] == 24


def plain_pack(docs, window):
    """The rule word by word: scores by the formula, one document at a time."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))

    def score(seed, d):
        found = Counter(docs[d].tolist())
        idf = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t in found}
        return sum(idf[t] * found[t] * 2.2 / (found[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in sorted(set(docs[seed].tolist())) if t in found)

    unused, pieces, sequence, rest = set(range(n)), [], 0, None
    while rest or unused:
        seed, start = rest or (min(unused), 0)
        unused.discard(seed)
        rest, used = None, min(window, len(docs[seed]) - start)
        pieces.append((seed, start, used, sequence, 0))
        if start + used < len(docs[seed]):
            rest, sequence = (seed, start + used), sequence + 1
            continue
        near = sorted((d for d in unused if score(seed, d) > 0), key=lambda d: (-round(score(seed, d), 9), d))
        for d in near:
            if used + len(docs[d]) <= window:
                unused.discard(d)
                pieces.append((d, 0, len(docs[d]), sequence, used))
                used += len(docs[d])
        order = [d for d in near if d in unused][:1] + sorted(unused)
        for d in dict.fromkeys(order):
            if used < window:
                unused.discard(d)
                took = min(len(docs[d]), window - used)
                pieces.append((d, 0, took, sequence, used))
                used += took
                rest = (d, took) if took < len(docs[d]) else None
        sequence += 1
    return pieces


@pytest.mark.parametrize("seed,window,dense", [(1, 64, 12), (2, 64, 1), (3, 40, 500), (4, 200, 12)])
def test_shard_is_packed_as_a_plain_version_packs_it(seed, window, dense, monkeypatch):
    monkeypatch.setattr(ShardIndex, "_DENSE", dense)
    rng = np.random.default_rng(seed)
    docs = [rng.zipf(1.5, int(k)).clip(1, 300).astype("<u2") for k in rng.integers(1, 90, 70)]
    docs = sorted([*docs, docs[3], docs[3], docs[8]], key=len, reverse=True)
    assert packing.pack_shard(docs, window) == plain_pack(docs, window)


def test_local_division_keeps_every_document_and_the_bound():
    from meridion.llm.packing import CorpusStatistics, divide

    rng = np.random.default_rng(5)
    docs = [rng.integers(k % 7 * 50, k % 7 * 50 + 60, int(n)).astype("<u2") for k, n in enumerate(rng.integers(1, 200, 300))] + [np.full(50, 9, "<u2")] * 80
    statistics = CorpusStatistics(len(docs), 100.0, np.full(1000, 5))
    parts = divide(docs, statistics, 2000)
    assert sorted(k for p in parts for k in p) == list(range(len(docs)))
    assert all(sum(len(docs[k]) for k in p) <= 2000 or len(p) == 1 for p in parts)


def test_letters_of_every_kind_with_and_without_marks():
    """All code points, before and behind punctuation: normal forms that end in a mark among them."""
    import unicodedata

    points = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and unicodedata.category(c := chr(k)) != "Cn"]
    texts = ["".join(f"a{c}. {c}, {c}{c}! x{c}A{c}; " for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    encoder = WordEncoder(PATH, 1)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(texts)] == library(texts)


def test_latin_words_are_spelt_as_the_library_spells_them():
    draw = random.Random(5)
    letters = "aeinst" + "".join(map(chr, range(0xC0, 0x100)))
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(5000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in WordEncoder(PATH, 1).encode_all(texts)] == library(texts)


def test_marks_are_set_apart_within_each_text():
    draw = random.Random(7)
    texts = ["", ".", "a.", "é.", "..", "a", *("".join(draw.choice("ab7ß÷ñ.,!| \n\t日_'") for _ in range(draw.randint(0, 20))) for _ in range(20000))]
    want = [re.sub(r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:*$&%#|]+)(?=[ \n]|\Z)", r"\1 \2", t) for t in texts]
    assert packing._marks_apart(pa.array(["x, ", *texts]).slice(1)).to_pylist() == want
    assert [packing._marks_apart(pa.array(t, pa.string())).to_pylist() for t in ([], [""], ["."])] == [[], [""], ["."]]


def test_text_ids_may_be_empty(spark):
    df = spark.createDataFrame([("", "ab c"), ("x", "ab c"), (None, "ab c"), ("a", "ab c")], "doc_id string, text string")
    assert sorted((r.doc_id for r in pack(df, PATH).collect()), key=str) == sorted(["", "x", None, "a"], key=str)

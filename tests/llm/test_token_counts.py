import random

import public_tokenizers
import pytest
import sentencepiece
from meridion.llm.token_counts import MODEL, count_tokens, op10_token_counts
from pyspark.sql import functions as F

PATH = public_tokenizers.path(MODEL)
ODD = ["", " ", "   ", "a", " a", "a ", "a  b   c", "\n\n x \t y", "<s> </s> <unk>", "▁▁ a▁b", "你好" * 50, "x\x00y \x1f", "\U0001f600" * 9 + " é", "ab" * 900, " " * 700, "la " * 900, "   z"]


def library(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)]


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (64, 16), (7, 2)])
def test_equals_the_library_on_odd_texts(spark, chunk, overlap):
    texts = [*ODD, "".join(ODD) * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert got == {i: (len(t.encode()), n) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))}


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (None, "ab c"), (2, "ab c"), (2, "ab c")], "doc_id long, text string")
    rows = sorted(map(tuple, count_tokens(df, PATH).collect()), key=str)
    n = library(["ab c"])[0]
    assert rows == sorted([(1, 0, 0), (None, 4, n), (2, 4, n), (2, 4, n)], key=str)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    want = dict(zip([d.doc_id for d in docs], library([d.t for d in docs]), strict=True))
    got = op10_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)
    small = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH, chunk_chars=500, overlap_chars=60)
    assert {r.doc_id: r.n_tokens for r in small.collect()} == want


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (9, 4)])
def test_marks_beside_spaces_count_as_in_the_library(spark, chunk, overlap):
    rng = random.Random(7)
    letters = [*"▁▁▁   abAé.\n\t", "你", "\U0001f600", "\x00", "<s>", "<0x0A>"]
    texts = ["▁ ", "a ▁ ▁ b", " ▁", *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "`doc.id` long, `a.text` string").repartition(4)
    got = {r["doc.id"]: r.n_tokens for r in count_tokens(df, PATH, "doc.id", "a.text", chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert got == dict(enumerate(library(texts)))

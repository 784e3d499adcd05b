from helpers import same
from meridion.llm.rule_ledger import BITS, OP3_SQL, POLICIES, ablations, failed, ledger, op3_rule_ledger
from pyspark.sql import functions as F


def test_query_equals_sql(spark, sf_dir):
    same(op3_rule_ledger(spark, sf_dir), sf_dir, OP3_SQL)


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z q x y z q x y z", "l1 w\n\nl1 w\nl1 w \n", "ÀÉ & < > # é\x0b\x0c\r|", "w\x1fw\x85w w", "ab " * 70]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ledger string, t int")
    rows = {r.row.doc_id: r.ledger for r in ledger(df).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert rows[i].n_words == len(words), t
        assert rows[i].word_chars == sum(len(w.decode()) for w in words)
        assert rows[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert rows[i].n_repeat_words == plain_repeats(words), t
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert rows[i].n_dup_lines == len(lines) - len(set(lines))
    assert ledger(df.limit(0)).count() == 0
    assert ledger(df.union(df)).count() == 2 * len(texts)


def test_policies_and_ablations(spark):
    bits = [0, 0, 1, 4, 5, 4, 64, 3]
    df = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    assert [r[0] for r in df.select(failed(F.col("fail_bits"), "base")).collect()] == [bool(b & 3) for b in bits]
    for r in ablations(df).collect():
        mask = sum(BITS[x] for x in POLICIES[r.policy])
        b = BITS[r.rule]
        assert (r.n_docs, r.n_kept, r.n_failed, r.n_only) == (8, sum(not x & mask for x in bits), sum(bool(x & b) for x in bits), sum(x & mask == b for x in bits))

from collections import Counter

import corpus_pipeline
from helpers import sql_rows
from meridion.llm.rule_ledger import OP3_SQL
from test_packing import check, library
from test_simhash import copy_groups


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == columns
    rows = [{r.doc_id: r for r in x.collect()} for x in out]
    ledger, names = sql_rows(sf_dir, OP3_SQL, ["documents"])
    assert set(rows[1]) == {r[names.index("doc_id")] for r in ledger if r[names.index("kept")]}
    assert set(rows[2]) == set(rows[1]) and all(r.n_chars == len(r.text) for r in rows[2].values())
    assert any(rows[2][i].text != rows[1][i].text for i in rows[1])
    ids = sorted(rows[2])
    smallest = copy_groups(ids, [rows[2][i].text for i in ids])
    assert set(rows[3]) == {i for i, g in zip(ids, smallest, strict=True) if i == g}
    mixed = Counter(r.doc_id for r in out[4].collect())
    assert set(mixed) == set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[3])
    want = {i: library([rows[4][i].text]) * n for i, n in mixed.items()}
    from meridion.llm.packing import digest

    assert check(digest(docs).collect(), want) > 0.98


def test_run_and_odd_rows(spark, sf_dir, tmp_path):
    text = "one two three four five six seven eight nine ten " * 3
    filler = [f"alpha{i} beta{i} gamma{i} delta{i} word{i * 7} more{i * 3} text{i}" for i in range(40)]
    good = " ".join(filler)
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (None, good + " tail", None, None, None), (2, None, "en", "a", 1), (3, text, "en", None, 3), (4, good + " other words here", "en", "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 4, None} and {1, None} <= {r.doc_id for r in got}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_one_of_many_copies_stays_whole(spark, tmp_path):
    copied = "\n".join(" ".join(f"{w}{k}" for w in ("stone", "river", "cloud", "maple", "copper")) for k in range(12))
    pages = [(i, copied, "en", "a", len(copied)) for i in range(40)]
    for i in range(40, 160):
        text = "\n".join(["Home"] + [" ".join(f"{w}{i * 13 + k}" for w in ("window", "garden", "letter", "summer")) for k in range(9)])
        pages.append((i, text, "en", "a", len(text)))
    docs = spark.createDataFrame(pages, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.drop_site_lines(spark, docs, "").write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert all(texts[i] == copied for i in range(40))
    assert not any("Home" in texts[i] for i in range(40, 160))
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_each_group(spark, lines, "").collect()}
    assert kept[0] == copied and not kept.keys() & set(range(1, 40))

from helpers import same
from meridion.llm.line_dedup import OP6_SQL, drop_boilerplate, op6_site_line_dedup


def test_query_equals_sql(spark, sf_dir):
    same(op6_site_line_dedup(spark, sf_dir), sf_dir, OP6_SQL)


def test_edge_cases(spark):
    rows = [(i, f"Home\nstory {i}\n Home \n", "a") for i in range(4)] + [(9, "Home\nstory 9", "b"), (9, "Home\nstory 9", "b"), (10, None, "a"), (None, "Home", None), (11, "", "a"), (12, "x\n\ny", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.row.doc_id, r.clean, r.n_lines, r.n_dropped) for r in drop_boilerplate(df, max_permille=300).collect()), key=repr)
    want = [(i, f"story {i}\n", 4, 2) for i in range(4)] + [(9, "Home\nstory 9", 2, 0)] * 2 + [(10, None, 0, 0), (None, "Home", 1, 0), (11, "", 1, 0), (12, "x\n\ny", 3, 0)]
    assert got == sorted(want, key=repr)
    assert drop_boilerplate(df.limit(0)).count() == 0
    assert drop_boilerplate(df.withColumnRenamed("source", "rid").selectExpr("*", "1 row", "2 t", "3 site"), site_col="rid").count() == len(rows)

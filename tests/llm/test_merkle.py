import hashlib
import zlib

import pytest
from helpers import same
from meridion.llm import merkle
from meridion.llm.merkle import COLUMNS, OP13_SQL, manifest, op13_merkle_manifest
from pyspark.sql import functions as F


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """All levels, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    return [(level[i >> k ^ 1], (i >> k) & 1) if i >> k ^ 1 < len(level) else None for k, level in enumerate(levels[:-1])]


def folded(leaf, steps):
    for s in steps:
        leaf = sha(leaf) if s is None else sha(s[0] + leaf) if s[1] else sha(leaf + s[0])
    return leaf


def plain(rows, tampered):
    """(id, leaf, subroot, root, proof, folded) for rows (id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k, v in by.items()}
    levels = {k: tree([leaf(r) for r in v]) for k, v in trees.items()}
    top, out = tree([levels[k][-1][0] for k in order]), []
    for g, k in enumerate(order):
        for i, r in enumerate(trees[k]):
            steps = siblings(levels[k], i) + siblings(top, g)
            other = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4])) if tampered(r) else leaf(r)
            out.append((r[0], leaf(r), levels[k][-1][0], top[-1][0], sha("".join(s[0] for s in steps if s)), folded(other, steps)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [*range(1, 18), 31, 32, 33, 100])
def test_positions_are_those_of_the_postorder(n):
    top, order = merkle.height(n), []

    def visit(level, index):
        if level:
            for i in (2 * index, 2 * index + 1):
                if i << (level - 1) < n:
                    visit(level - 1, i)
        order.append((level, index))

    visit(top, 0)
    assert [merkle.position(k, i, n) for k, i in order] == list(range(len(order)))
    assert merkle.subtree_size(top, n) == len(order)
    leaves = [hashlib.sha256(b"%d" % k).digest() for k in range(n)]
    levels, log = tree([x.hex() for x in leaves]), merkle.append_log(leaves, top)
    assert [log[32 * k : 32 * k + 32].hex() for k in range(len(order))] == [levels[k][i] for k, i in order]
    for i, leaf in enumerate(leaves):
        path = merkle.path_of(log, i, n, top)
        assert merkle.fold(leaf, path).hex() == levels[-1][0]
        assert [d.hex() for s, d in merkle._steps(path) if s != merkle._ALONE] == [s[0] for s in siblings(levels, i) if s]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def rows_of(found):
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded) for r in found.collect()), key=str)


ROWS = [
    *((k, f"s{k % 5}", "en", k * 7, f"text {k}") for k in range(-3, 150)),
    *((k, None, None, None, None) for k in range(5)),
    (None, "a", "de", 1, ""),
    (None, None, "de", 2, "é\n"),
    (7, "x", "de", 3, "y" * 100_000),
    *[(9, "x", "fr", 4, "copy")] * 40,
    (1, "x", "", 1, "empty name"),
    (2, "x", "Ω", 1, "alone"),
]


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_nulls_repeats_and_blocks_of_any_size(spark, levels):
    hit = lambda r: r[0] is not None and r[0] % 3 == 0
    df = frame(spark, ROWS).withColumns({"tree": F.lit(1), "leaf": F.lit(2), "row": F.lit(3)})
    changed = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    found = manifest(df, COLUMNS, "lang", "doc_id", F.when(F.col("doc_id") % 3 == 0, changed), levels)
    assert rows_of(found) == plain(ROWS, hit)


def test_one_row_and_no_row(spark):
    one = [(5, "a", "en", 1, "t")]
    assert rows_of(manifest(frame(spark, one), COLUMNS, "lang", "doc_id")) == plain(one, lambda r: False)
    assert manifest(frame(spark, one).limit(0), COLUMNS, "lang", "doc_id").count() == 0


def test_the_log_has_every_node_once_at_its_place(spark):
    n = 41
    leaves = spark.createDataFrame([("t", k, n, hashlib.sha256(b"%d" % k).digest()) for k in range(n)], "tree string, rank long, n long, digest binary")
    levels = tree([hashlib.sha256(b"%d" % k).hexdigest() for k in range(n)])
    nodes = merkle.log_nodes(merkle.build(leaves, 2), 2).collect()
    assert sorted(r.position for r in nodes) == list(range(sum(map(len, levels))))
    assert {(r.level, r["index"]): r.digest for r in nodes} == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level)}
    assert all(merkle.position(r.level, r["index"], n) == r.position for r in nodes)


def test_query_equals_sql_and_plain(spark, sf_dir):
    df = op13_merkle_manifest(spark, sf_dir)
    same(df, sf_dir, OP13_SQL)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    want = plain(docs, lambda r: zlib.crc32(str(r[0]).encode()) % 7 == 0)
    got = df.collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == want
    assert {r.verified for r in got} == {True, False}

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortmill.llm import merkle


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        b = i // arity * arity
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + arity])))
        i //= arity
    return out


def plain(rows, arity):
    """(id, leaf, subroot, root, path) of rows (id, lang, text)."""
    keys = sorted({r[1] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    of = {k: sorted(((r[0], sha(field(r[0]) + field(r[1]) + field(r[2]))) for r in rows if r[1] == k), key=lambda x: (x[0] is not None, x)) for k in keys}
    trees = {k: tree([x[1] for x in of[k]], arity) for k in keys}
    top = tree([trees[k][-1][0] for k in keys], arity)
    return [(i, leaf, trees[k][-1][0], top[-1][0], path(trees[k], n, arity) + path(top, j, arity)) for j, k in enumerate(keys) for n, (i, leaf) in enumerate(of[k])]


def built(df, arity, levels):
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("text"))
    out = merkle.manifest(df, leaf, F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, arity, levels)
    return out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path")))


def plain_sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("arity,levels", [(8, 3), (2, 2), (3, 1)])
def test_equals_a_plain_tree_over_several_rounds(spark, arity, levels):
    langs = [None, "", "en", "é", "z", "a-b", "=", "EN"]
    rows = [(i, langs[0 if i < 60 else i % 8], f"Text {i} ñ") for i in range(100)] + [(200, "lone", "x"), (None, "en", "no id"), (201, "en", None), (202, "en", ""), (203, "en", "Y" * 200_000)]
    rows += [(300, "z", "same")] * 7 + [(301, "z", "b"), (301, "z", "a")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    for name in ("key", "node", "leaf", "root", "place", "path", "c0"):
        df = df.withColumn(name, F.lit("clash"))
    got = built(df, arity, levels).collect()
    want = plain(rows, arity)
    assert plain_sort((r.doc_id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in got) == plain_sort(want)
    assert all(r.folded == r.root for r in got)
    assert {r.leaf: r.proof for r in got if r.doc_id == 5} == {w[1]: sha("".join(a + b for a, b in w[4])) for w in want if w[0] == 5}


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(7, "en", "A")], "doc_id long, lang string, text string")
    r = built(df, 8, 3).first()
    assert r.leaf == r.subroot == r.root == r.folded == sha("1:72:en1:A") and r.path == [] and r.proof == sha("")
    assert built(df.where("false"), 8, 3).count() == 0


def test_a_changed_leaf_does_not_verify(spark):
    df = spark.createDataFrame([(i, "en", f"T{i}") for i in range(20)], "doc_id long, lang string, text string")
    leaf = merkle.leaf_digest(F.col("text"))
    out = merkle.manifest(df, leaf, F.col("lang"), F.col("doc_id"), {"other": merkle.leaf_digest(merkle.lower_ascii(F.col("text")))}, 2, 2)
    assert out.where(merkle.fold(F.col("other"), F.col("path")) == F.col("root")).count() == 0


def test_hot_key_and_hot_row_are_blocks_like_others(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    got = built(df, 8, 1)
    rows = [(1, "en", "t")] * 2000 + [(i, "en", "t") for i in range(2000, 4000)]
    assert got.select("root").distinct().collect()[0].root == plain(rows, 8)[0][3]
    assert got.where("folded = root").count() == 4000

"""Texts with quotes, comments and faults, each with its outcome."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grovekit.functions.masks import Masks
from grovekit.sources import newick


def parsed(spark, text, names="A B C D E".split()):
    table = spark.createDataFrame(list(enumerate(names)), "taxon int, name string")
    return newick.parse(newick.from_lines(spark, [text]), table, Masks(len(names)))


@pytest.mark.parametrize(("text", "fault"), [
    ("(A,B)(C,D);", "several roots"), ("x(A,B);", "several roots"), ("'x'y(A,B);", "several roots"), ("A;", "root is a leaf"), ("((A,B),C;", "brackets"), ("(A,B));", "brackets"),
    ("(A,'B,C);", "doesn't end"), ("(A,[B,C);", "doesn't end"), ("(A,(B,A));", "twice"),
])
def test_faults_of_gene_trees(spark, text, fault):
    with pytest.raises(Exception, match=fault):
        parsed(spark, text).collect()


@pytest.mark.parametrize("text", ["((A,B),(C,D)); junk", "((A,B)(C,D));", "(A,,B,C);", "([c]A,B);", "((A,B),(C,D))"])
def test_gene_trees_may_be_careless(spark, text):
    assert {r["taxon"] for r in parsed(spark, text).collect() if r["taxon"] is not None} >= {0, 1}


def test_quotes_and_comments(spark):
    names = ["a;b", "B", "C", "it's (x)", "a[1]", "n:1"]
    text = "(('a;b'[one]:1.5,B[two[x]:2)'in;ner'[three]:3,(C,('it''s (x)','a[1]':0.5)[four],'n:1':7)lab[five]:8)[six];"
    rows = parsed(spark, text, names).collect()
    leaf = {r["taxon"]: (r["length"], r["comments"]) for r in rows if r["taxon"] is not None}
    assert leaf == {0: (1.5, ["[one]"]), 1: (2.0, ["[two[x]"]), 2: (None, []), 3: (None, []), 4: (0.5, []), 5: (7.0, [])}
    inner = {r["mask"]: (r["label"], r["length"], r["comments"]) for r in rows if r["taxon"] is None}
    assert inner == {3: ("in;ner", 3.0, ["[three]"]), 24: (None, None, ["[four]"]), 60: ("lab", 8.0, ["[five]"]), 63: (None, None, ["[six]"])}
    back = newick.to_text(parsed(spark, text, names), spark.createDataFrame(list(enumerate(names)), "taxon int, name string")).first()["newick"]
    assert back == "(('a;b',B),(C,('it''s (x)','a[1]'),'n:1'));"
    assert newick.stripped(newick.from_lines(spark, ["((A[x]:1,'b:;)':2)'l:ab':3[y],C)r;"])).first()["newick"] == "((A,'b:;)'),C);"


@pytest.mark.parametrize(("text", "fault"), [
    ("((A,B),(C,D)); junk", "text after"), ("((A,B),(C,D));;", "text after"), ("(A,,B,C);", "without a name"), ("(A,B,);", "without a name"), ("((A,B)(C,D));", "missing comma"), ("();", "without a name"), (";", "without a name"),
    ("(A,B", "missing bracket"), ("(A,B));", "missing bracket"), ("(A,B),C;", "missing bracket"), ("A(B,C);", "missing comma"), ("([c]A,B);", "without a name"), ("(A [c] x,B);", "isn't one"), ("(A:1:2,B);", "isn't one"), ("(:1,B);", "without a name"), ("(A,'B);", "isn't one"), ("(A,[B);", "without a name"),
])
def test_strict_faults(spark, text, fault):
    with pytest.raises(newick.StrictTreeError, match=fault):
        newick.check_strict(newick.from_lines(spark, [text]))


@pytest.mark.parametrize("text", ["((A,B),(C,D));", "((A,B)x[c]:1.5[d],(C[e],D:2))", "( A , 'b;,)' : 1 ) root ;", "A;", "((A,B):0.1,(C,D)'l''b':2 [z]);", "A:3"])
def test_strict_accepts(spark, text):
    newick.check_strict(newick.from_lines(spark, [text]))


def test_numbers_have_no_gaps(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\n".join(["", *(f"({k},x{i});" for i in range(400)), "  ", f"({k},last);"]))
    want = [f"({k},{x});" for k in range(3) for x in (*(f"x{i}" for i in range(400)), "last")]
    for size in ("500b", "64m"):  # many stretches of a file, and one
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = newick.read_lines(spark, str(tmp_path)).orderBy("tree").collect()
        assert [r["tree"] for r in rows] == list(range(len(want))) and [r["newick"] for r in rows] == want
        assert [r["newick"] for r in newick.first_trees(newick.read_lines(spark, str(tmp_path)), 5).orderBy("tree").collect()] == want[:5]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.tre").write_text("[&R] (A,\n'b;c');(C,[x;y]D);\n ;")
    (tmp_path / "g/b.tre").write_text("(E,F)")
    rows = newick.concatenated(spark, str(tmp_path / "g")).orderBy("tree").collect()
    assert [(r["tree"], r["newick"]) for r in rows] == [(0, "(A, 'b;c');"), (1, "(C,[x;y]D);"), (2, "(E,F);")]


def test_awkward_rows(spark):
    names = spark.createDataFrame([(0, "A", "x"), (1, "B", "y")], "taxon int, name string, tree string")
    trees = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, " ; ", 1), (3, "(A,B);", 1), (4, "(A,B);", 1)], "tree long, newick string, taxon int")
    got = newick.parse(trees, names, Masks(2)).groupBy("tree").agg(F.count("*").alias("n")).collect()
    assert {(r["tree"], r["n"]) for r in got} == {(3, 3), (4, 3)}
    assert newick.parse(trees.limit(0), names, Masks(2)).collect() == [] and newick.leaf_names(trees.limit(0)).collect() == []

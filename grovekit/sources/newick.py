"""Newick text to interval-encoded nodes and back, without user functions on the way in.

A tree's tokens are numbered; depths are running sums; at one depth opening and closing brackets alternate, so a
node's end is the next closing one. A node is the half-open range of leaf positions below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masks import Masks

_QUOTED, _COMMENT = r"'[^']*(?:''[^']*)*'", r"\[[^\]]*\]"
#: One pass from the left, in which quotes, comments and the end of a tree are told apart: names and lengths with their quotes and comments,
#: brackets, commas and semicolons. What is left alone is a quote or a comment that never ends.
TOKEN = rf"(?:{_QUOTED}|{_COMMENT}|[^(),;'\[]+)+|[(),;]|['\[]"
_PIECE = rf"{_QUOTED}|{_COMMENT}|[^;'\[]+|;|['\[]"
#: A name (quoted or not), comments, a length, comments: all that a strict reader takes between brackets and commas.
_STRICT = rf"^\s*(?:{_QUOTED}|[^':\[\]]*)\s*(?:{_COMMENT}\s*)*(?::[^':\[\]]*(?:{_COMMENT}\s*)*)?$"


def _numbered(rows: DataFrame, *source: str) -> DataFrame:
    """rows (the source's columns, k: places within a source, from 1) with tree: gapless numbers by source, then place.

    Only a row for each source is sorted as a whole, for the offsets.
    """
    counts = rows.groupBy(*source).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(*source)) - F.col("n")).drop("n")
    return rows.join(before, list(source)).withColumn("tree", F.col("before") + F.col("k") - 1).drop("before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """tree, newick: one tree for each line that isn't blank, numbered from 0 without gaps in the order of files and lines.

    Lines are counted within the stretches in which Spark reads a file, and the stretches' counts give the offsets, so the numbers
    are the same however a file is divided.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("newick"))
    rows = rows.filter(F.length("newick") > 0).withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return _numbered(rows, "file", "block").select("tree", "newick")


def first_trees(trees: DataFrame, most: int) -> DataFrame:
    """The first trees of a gapless collection, in file order."""
    return trees.filter(F.col("tree") < most)


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A handful of trees given as text."""
    kept = [x.strip() for x in lines if x.strip()]
    return spark.createDataFrame(list(enumerate(kept)), "tree long, newick string")


def split_statements(text: DataFrame, column: str = "value", source: str | None = None) -> DataFrame:
    """tree, newick: several trees in one string, ended by semicolons that stand in no quotes or comments; numbered without gaps.

    source: a column that orders the strings; else they are taken in their present order.
    """
    src = F.col(source) if source else F.monotonically_increasing_id()
    pieces = text.select(src.alias("src"), F.posexplode(F.regexp_extract_all(F.col(column), F.lit(_PIECE), F.lit(0))).alias("i", "piece"))
    ends = F.count_if(F.col("piece") == ";").over(Window.partitionBy("src").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    parts = pieces.withColumn("part", F.coalesce(ends, F.lit(0))).filter("piece != ';'")
    whole = parts.groupBy("src", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "piece")))["piece"], "").alias("s"))
    # line ends within a tree are blanks
    whole = whole.withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " "))).filter(F.length("s") > 0)
    whole = whole.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("part")))
    return _numbered(whole, "src").select("tree", F.concat("s", F.lit(";")).alias("newick"))


def concatenated(spark: SparkSession, pattern: str) -> DataFrame:
    """All trees of many files in the order of their paths, without rooting marks."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\[&[RU]\]", "").alias("value"))
    return split_statements(files, source="file")


def _bare(text: Column) -> Column:
    """Without comments; what looks like one within quotes stays."""
    return F.regexp_replace(text, rf"({_QUOTED})|{_COMMENT}", "$1")


def stripped(trees: DataFrame) -> DataFrame:
    """Trees without lengths, labels of inner nodes and comments."""
    return trees.withColumn("newick", F.regexp_replace(_bare(F.col("newick")), rf"({_QUOTED})|(\))(?:{_QUOTED}|[^(),;'])+|:[^(),;]*", "$1$2"))


def tokens(trees: DataFrame) -> DataFrame:
    """tree, i, raw, tok, comments, prev: tok is raw without comments and blanks around it. Nothing after the first semicolon outside quotes counts."""
    every = _every_token(trees)
    return every.filter("NOT after_end AND tok != ';'").drop("after_end")


def _every_token(trees: DataFrame) -> DataFrame:
    each = trees.select("tree", F.posexplode(F.regexp_extract_all("newick", F.lit(TOKEN), F.lit(0))).alias("i", "raw"))
    each = each.withColumn("tok", F.trim(_bare(F.col("raw")))).filter("length(trim(raw)) > 0")
    each = each.withColumn("comments", F.filter(F.regexp_extract_all("raw", F.lit(rf"{_QUOTED}|{_COMMENT}"), F.lit(0)), lambda c: c.startswith("[")))
    by = Window.partitionBy("tree").orderBy("i")
    ended = F.coalesce(F.max(F.col("tok") == ";").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return each.withColumn("prev", F.lag("tok").over(by)).withColumn("after_end", ended)


def is_leaf() -> Column:
    return ~F.col("tok").isin("(", ")", ",", "") & F.coalesce(F.col("prev") != ")", F.lit(True))


def check_strict(trees: DataFrame) -> None:
    """Raises StrictTreeError at text after the tree, a leaf without a name, a missing comma or bracket, or a name that is more than a name and a length.

    Trees to annotate are read so; the gene trees' parse() passes over such things. What may follow a token is a rule on two neighbours.
    """
    t = _every_token(trees)
    mark = lambda c: F.col(c).isin("(", ")", ",", ";")
    by = Window.partitionBy("tree").orderBy("i")
    depth = F.sum(F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)).over(by)
    t = t.withColumn("depth", depth).withColumn("next", F.lead("tok").over(by))
    begins = F.col("prev").isNull() | F.col("prev").isin("(", ",")
    leaf = ~mark("tok") & begins
    wrong = (
        F.when(F.col("after_end"), "text after the tree")
        .when(begins & (F.col("tok").isin(")", ",", ";") | (leaf & ((F.col("tok") == "") | F.trim("raw").startswith("[") | F.col("tok").startswith(":")))), "a leaf without a name")
        .when((F.col("tok") == "(") & ~begins, "a missing comma")
        .when(~mark("tok") & ~F.col("raw").rlike(_STRICT), "a name that isn't one")
        .when((F.col("depth") < 0) | (F.col("depth") == 0) & (F.col("tok") == ",") | F.col("next").isNull() & ((F.col("depth") != 0) | F.col("tok").isin("(", ",")), "a missing bracket")
    )
    first = t.withColumn("wrong", wrong).filter("wrong IS NOT NULL").select("tree", "i", "wrong", "raw").orderBy("tree", "i").first()
    if first:
        raise StrictTreeError(f"{first['wrong']} in tree {first['tree']}, at {first['raw'][:30]!r}")


def leaf_names(trees: DataFrame) -> DataFrame:
    """tree, i, name of every leaf; labels after a closing bracket are not leaves."""
    return tokens(trees).filter(is_leaf()).select("tree", "i", _name().alias("name"))


def _name(tok: str = "tok") -> Column:
    """What stands before a length; quotes go, and doubled ones within are single."""
    inside = F.replace(F.regexp_extract(tok, rf"^'({_QUOTED[1:-1]})'", 1), F.lit("''"), F.lit("'"))
    return F.when(F.col(tok).startswith("'"), inside).otherwise(F.trim(F.regexp_extract(tok, "^([^:]*)", 1)))


def taxa(trees: DataFrame) -> DataFrame:
    """taxon, name: numbered from 0 by first appearance (tree, then place). Few rows, so one ordered window."""
    first = leaf_names(trees).groupBy("name").agg(F.min(F.struct("tree", "i")).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("taxon"), "name")


def parse(trees: DataFrame, names: DataFrame, masks: Masks, keep: DataFrame | None = None) -> DataFrame:
    """tree, node, parent, lvl, lo, hi, n_children, child_ord, taxon, mask, label, length, comments.

    names: taxon, name of all taxa. keep: names of the leaves to keep; the others go before ranges are made, as do
    nodes with fewer than two children left and trees with fewer than two leaves. A tree whose brackets don't match, whose
    quotes or comments don't end, that is a lone leaf or has several roots, or that has a taxon twice, raises an error with its
    number when the result is read. A null or blank text has no nodes. Other columns of either table don't matter; repeated
    trees have numbers of their own.
    """
    t = tokens(trees)
    by = Window.partitionBy("tree").orderBy("i")
    opened = F.sum(F.when(F.col("tok") == "(", 1).otherwise(0)).over(by)
    closed = F.sum(F.when(F.col("prev") == ")", 1).otherwise(0)).over(by)
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    t = t.withColumn("depth", opened - closed).withColumn("leaf", is_leaf()).withColumn("open_now", F.sum(step).over(by))
    whole = Window.partitionBy("tree")
    tops = F.count_if((F.col("tok") == "(") & (F.col("open_now") == 1) | F.col("leaf") & (F.col("open_now") == 0)).over(whole)
    lone = F.count_if(F.col("leaf") & (F.col("open_now") == 0)).over(whole) > 0
    endless = F.count_if(F.col("tok").isin("'", "[")).over(whole) > 0
    fault = F.when(endless, "a quote or comment doesn't end").when((F.min("open_now").over(whole) < 0) | (F.sum(step).over(whole) != 0), "brackets don't match")
    fault = fault.when((tops == 1) & lone, "the root is a leaf").when(tops > 1, "there are several roots")
    t = t.withColumn("fault", fault).withColumn("name", F.when(F.col("leaf"), _name()))
    names = names.select("taxon", "name")
    listed = names.join(keep.select("name"), "name", "left_semi") if keep is not None else names
    t = t.join(F.broadcast(listed), "name", "left")  # a dictionary of taxa
    t = t.withColumn("counted", F.when(F.col("leaf") & F.col("taxon").isNotNull(), 1).otherwise(0))
    t = t.withColumn("seen", F.sum("counted").over(by)).withColumn("after", F.lead("tok").over(by)).withColumn("next_comments", F.lead("comments").over(by))
    # brackets of one depth: the node ends where the next closing one stands
    bracket = F.col("tok").isin("(", ")")
    same = Window.partitionBy("tree", "depth", "bracket").orderBy("i")
    t = t.withColumn("bracket", bracket).withColumn("end", F.lead("seen").over(same)).withColumn("mark", F.lead("after").over(same)).withColumn("said", F.lead("next_comments").over(same))
    opens = F.col("tok") == "("
    nodes = t.filter(opens | (F.col("counted") == 1)).select(
        "tree",
        F.when(F.col("fault").isNotNull(), F.raise_error(F.concat("fault", F.lit(" in tree "), F.col("tree").cast("string")))).otherwise(F.col("i")).cast("long").alias("node"),
        F.when(opens, F.col("seen")).otherwise(F.col("seen") - 1).cast("int").alias("lo"),
        F.when(opens, F.col("end")).otherwise(F.col("seen")).cast("int").alias("hi"),
        "taxon",
        F.when(~opens, F.col("tok")).when(~F.col("mark").isin("(", ")", ","), F.col("mark")).alias("mark"),
        F.when(~opens, F.col("comments")).when(~F.col("mark").isin("(", ")", ","), F.col("said")).alias("comments"),
    )
    # of nodes with one range (a bracket around a single child, or left by the restriction) the innermost stays
    alone = F.row_number().over(Window.partitionBy("tree", "lo", "hi").orderBy(F.desc("node")))
    nodes = nodes.filter("hi > lo").withColumn("k", alone).filter("k = 1").drop("k")
    nodes = nodes.withColumn("n_leaves", F.max("hi").over(Window.partitionBy("tree"))).filter("n_leaves >= 2" if keep is not None else "n_leaves >= 1").drop("n_leaves")
    again = F.col("taxon").isNotNull() & (F.count("taxon").over(Window.partitionBy("tree", "taxon")) > 1)
    twice = F.raise_error(F.concat(F.lit("a taxon stands twice in tree "), F.col("tree").cast("string")))
    nodes = nodes.withColumn("taxon", F.when(again, twice).otherwise(F.col("taxon")).cast("int"))
    label = _name("mark")
    length = F.regexp_extract(F.regexp_replace("mark", _QUOTED, ""), r":\s*([^:]*)$", 1).try_cast("double")
    nodes = nodes.withColumn("label", F.when(F.col("taxon").isNull() & (label != ""), label)).withColumn("length", length).drop("mark")
    return with_parents(with_masks(nodes, masks))


def with_masks(nodes: DataFrame, masks: Masks) -> DataFrame:
    """mask: the taxa in each node's range. A node stands once at every position it covers, beside the leaf there."""
    each = nodes.withColumn("pos", F.explode(F.sequence("lo", F.col("hi") - 1)))
    each = each.withColumn("at", F.max("taxon").over(Window.partitionBy("tree", "pos")))
    return each.groupBy(*nodes.columns).agg(masks.union_of("at").alias("mask"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """parent, lvl, n_children and child_ord from the ranges, by windows alone.

    A node's level is the number of ranges open where it begins. Its parent is the last node of the level above that
    begins before it or with it.
    """
    nodes = nodes.drop("lvl", "parent", "n_children", "child_ord")
    edge = lambda at, kind, far: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), far.cast("int").alias("far"))
    # at one place ranges end before others begin; of those that begin, the longest comes first
    events = nodes.withColumn("e", F.explode(F.array(edge("lo", 1, -F.col("hi")), edge("hi", 0, F.col("lo")))))
    by = Window.partitionBy("tree").orderBy("e.at", "e.kind", "e.far", "node")
    open_now = F.sum(F.when(F.col("e.kind") == 1, 1).otherwise(-1)).over(by)
    nodes = events.withColumn("lvl", (open_now - 1).cast("int")).filter("e.kind = 1").drop("e")
    # each node opens its children's level and stands in its own
    twice = nodes.withColumn("opens", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("key", F.col("lvl") + F.col("opens").cast("int"))
    order = Window.partitionBy("tree", "key").orderBy("lo", ~F.col("opens"))
    nodes = twice.withColumn("parent", F.last(F.when(F.col("opens"), F.col("node")), ignorenulls=True).over(order)).filter("not opens").drop("opens", "key")
    child = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("lo")) - 1
    nodes = nodes.withColumn("child_ord", F.when(F.col("parent").isNull(), 0).otherwise(child).cast("int"))
    # the number of children: nodes of the next level that begin within the range, counted beside the node
    twice = nodes.withColumn("as_child", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("key", F.when(F.col("as_child"), F.col("parent")).otherwise(F.col("node")))
    kids = F.count(F.when(F.col("as_child"), 1)).over(Window.partitionBy("tree", "key"))
    return twice.withColumn("n_children", kids.cast("int")).filter("not as_child").drop("as_child", "key")


def to_text(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """tree, newick: topology and names, by plain aggregation: what opens before and closes after each leaf. names: taxon, name."""
    raw = F.col("name")
    name = F.when(raw.rlike(r"[(),:;'\[\]\s]"), F.concat(F.lit("'"), F.replace(raw, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(raw)
    leaf = nodes.filter("taxon is not null").select("tree", F.col("lo").alias("pos"), "taxon").join(F.broadcast(names), "taxon").select("tree", "pos", name.alias("name"))
    inner = nodes.filter("n_children > 0")
    opens = inner.groupBy("tree", F.col("lo").alias("pos")).agg(F.count("*").cast("int").alias("o"))
    closes = inner.groupBy("tree", (F.col("hi") - 1).alias("pos")).agg(F.count("*").cast("int").alias("c"))
    each = leaf.join(opens, ["tree", "pos"], "left").join(closes, ["tree", "pos"], "left")
    text = F.concat(F.repeat(F.lit("("), F.coalesce("o", F.lit(0))), "name", F.repeat(F.lit(")"), F.coalesce("c", F.lit(0))))
    return each.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("a")).select("tree", F.concat(F.array_join("a.t", ","), F.lit(";")).alias("newick"))


def leaf_table(nodes: DataFrame) -> DataFrame:
    """tree, pos, taxon."""
    return nodes.filter("taxon is not null").select("tree", F.col("lo").cast("int").alias("pos"), "taxon")


def trees_summary(nodes: DataFrame, n_taxa: int) -> DataFrame:
    """tree, n_leaves, is_complete, has_polytomy. A root of three children is no multifurcation."""
    poly = (F.col("n_children") > 2) & ~(F.col("parent").isNull() & (F.col("n_children") == 3))
    return nodes.groupBy("tree").agg(F.max("hi").cast("int").alias("n_leaves"), F.bool_or(poly).alias("has_polytomy")).withColumn("is_complete", F.col("n_leaves") == n_taxa)


class StrictTreeError(ValueError):
    """A summary tree that isn't exactly one tree over exactly the expected taxa."""


def check_species(trees: DataFrame, expected: DataFrame) -> None:
    """Raises unless there is one tree with every expected name once and no other."""
    if trees.count() != 1:
        raise StrictTreeError("expected exactly one tree")
    got = leaf_names(trees).groupBy("name").agg(F.count("*").alias("k"))
    off = got.join(expected.select("name", F.lit(1).alias("e")), "name", "full").filter("k is null or e is null or k > 1").orderBy("name").limit(5).collect()
    if off:
        raise StrictTreeError("taxa differ or repeat: " + ", ".join(r["name"] for r in off))

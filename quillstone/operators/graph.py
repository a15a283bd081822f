"""Citation graphs and outlines, by iteration over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut


def pagerank(edges: DataFrame, iterations: int = 50, damping: float = 0.85, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, score) of the nodes of (src, dst).

    Scores begin at 0, so the result after k rounds is a truncated series; a
    node's share counts all its edges, parallel ones too, but goes to each
    target once; what a node without edges holds is lost. Edges are laid out by
    source once; sums are made before the shuffle, so a hub is no hot spot.
    """
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut(edges.distinct().join(degree, "src"))
    base = (1 - damping) / n
    scores = nodes.withColumn("score", F.lit(0.0))
    for k in range(iterations):
        sent = links.join(scores, links["src"] == scores["id"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        new = nodes.join(sent, nodes["id"] == sent["dst"], "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if (k + 1) % every == 0 or k + 1 == iterations:
            new = cut(new)
            if tolerance and k + 1 < iterations:
                moved = new.join(scores.withColumnRenamed("score", "old"), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
                if moved < tolerance:
                    return new
        scores = new
    return scores


def graph_stats(edges: DataFrame) -> DataFrame:
    """(id, out_edges, in_edges, in_sources): edges as given, and distinct sources."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_edges"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_edges"), F.countDistinct("src").alias("in_sources"))
    return out.join(into, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_edges", "in_edges", "in_sources")])


def chain_ends(renames: DataFrame) -> DataFrame:
    """(old, final) of renames (old, new): what each name is called in the end, by pointer doubling; a cycle stops where it closes."""
    at = cut(renames.groupBy("old").agg(F.min("new").alias("final")))
    # the reach of a pointer doubles each round; a cycle keeps turning, so rounds end once a chain of as many names would have
    reach, names = 1, at.count()
    while reach <= 2 * names:
        reach *= 2
        nxt = at.select(F.col("old").alias("final"), F.col("final").alias("far"))
        new = cut(at.join(nxt, "final", "left").select("old", F.coalesce(F.when(F.col("far") != F.col("old"), F.col("far")), F.col("final")).alias("final"), F.col("final").alias("was")))
        if new.where("final <> was").isEmpty():
            return new.select("old", "final")
        at = new.select("old", "final")
    return at


def outline(sections: DataFrame, tree: str) -> DataFrame:
    """(tree, id, depth, path) of sections (tree, id, parent, turn): pre-order paths of sibling numbers, as ``1.2.3``.

    Levels are joined one after the other until one is empty; a section that no root leads to is left out.
    """
    siblings = Window.partitionBy(tree, "parent").orderBy("turn", "id")
    numbered = cut(sections.select(tree, "id", "parent", F.row_number().over(siblings).alias("n")))
    level = numbered.where("parent IS NULL").select(tree, "id", F.lit(1).alias("depth"), F.col("n").cast("string").alias("path"))
    out, level = level, cut(level)
    while True:
        up = level.select(F.col(tree), F.col("id").alias("parent"), F.col("depth"), F.col("path"))
        level = cut(numbered.join(up, [tree, "parent"]).select(tree, "id", (F.col("depth") + 1).alias("depth"), F.concat_ws(".", "path", "n").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def last_sections(walked: DataFrame, tree: str, by: str) -> DataFrame:
    """(tree, by, id, path): of the sections of a walked outline that share a value of ``by``, the last in pre-order."""
    place = F.transform(F.split("path", r"\."), lambda n: n.cast("int"))
    return walked.groupBy(tree, by).agg(F.max_by(F.struct("id", "path"), place).alias("s")).select(tree, by, "s.id", "s.path")


def full_text(sections: DataFrame, walked: DataFrame, tree: str) -> DataFrame:
    """(tree, n, chars): sections of each tree that its outline reaches, and the length of their text."""
    x = walked.join(sections.select(tree, "id", "title", "body"), [tree, "id"])
    return x.groupBy(tree).agg(F.count("*").alias("n"), F.sum(F.length("title") + F.length("body") + 1).alias("chars"), F.max("depth").alias("depth"))


def pruned(walked: DataFrame, wanted: DataFrame, tree: str) -> DataFrame:
    """``walked`` (tree, id, depth, path) with ``match`` for the sections ``wanted`` (tree, id), without what lies below a match: a walk that stops there goes on beside it."""
    x = walked.join(wanted.select(tree, "id").distinct().withColumn("match", F.lit(True)), [tree, "id"], "left").withColumn("match", F.coalesce("match", F.lit(False)))
    steps = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
    # each section looks for the paths above it among the matches
    up = x.where(F.size(steps) > 1).select(tree, "id", "path", F.explode(F.slice(above, F.lit(1), F.size(steps) - 1)).alias("up"))
    below = up.join(x.where("match").select(tree, F.col("path").alias("up")), [tree, "up"], "left_semi").select(tree, "path").distinct()
    return x.join(below, [tree, "path"], "left_anti").select(*walked.columns, "match")


def find_section(walked: DataFrame, wanted: DataFrame, tree: str) -> DataFrame:
    """(tree, id, path): of the sections of each tree that have a wanted id, the last that a walk which stops below matches comes to."""
    place = F.transform(F.split("path", r"\."), lambda n: n.cast("int"))
    return pruned(walked, wanted, tree).where("match").groupBy(tree).agg(F.max_by(F.struct("id", "path"), place).alias("s")).select(tree, "s.id", "s.path")

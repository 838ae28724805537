"""The import graph: resolution of relative imports, edges, and breadth-first neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import Growing, staged
from corvane.functions.paths import dirname, normalized

# What a relative import may stand for, in order of precedence.
CANDIDATE_SUFFIXES = ("", ".js", ".ts", ".py", "/index.js")


def resolve_imports(imports: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, src, ord, dst): the file each relative specifier stands for; those that stand for none are left out.

    ``imports`` holds (keys…, path, ord, specifier), ``files`` (keys…, path).
    """
    relative = imports.where(F.col("specifier").startswith("."))
    base = normalized(F.concat(dirname(F.col("path")), F.lit("/"), F.col("specifier")))
    tried = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("suffix")) for i, s in enumerate(CANDIDATE_SUFFIXES)])
    candidates = relative.select(*keys, F.col("path").alias("src"), "ord", base.alias("_base"), F.inline(tried)).select(
        *keys, "src", "ord", "rank", F.concat("_base", "suffix").alias("dst")
    )
    known = files.select(*keys, F.col("path").alias("dst")).distinct()
    return candidates.join(known, [*keys, "dst"]).groupBy(*keys, "src", "ord").agg(F.min_by("dst", "rank").alias("dst"))


def build_edges(imports: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, src, dst, out_pos, in_pos): each pair of files once, without loops.

    ``out_pos`` orders a file's imports as its source does, ``in_pos`` a file's importers by path.
    """
    once = resolve_imports(imports, files, keys).where("src != dst").groupBy(*keys, "src", "dst").agg(F.min("ord").alias("_first"))
    out = F.row_number().over(W.partitionBy(*keys, "src").orderBy("_first", "dst")) - 1
    into = F.row_number().over(W.partitionBy(*keys, "dst").orderBy("src")) - 1
    return once.select(*keys, "src", "dst", out.alias("out_pos"), into.alias("in_pos"))


def neighbors(edges: DataFrame, starts: DataFrame, keys: list[str], depth: int = 1) -> DataFrame:
    """(keys…, start, direction, path, hops, pos) within ``depth`` hops of each start, in either direction.

    ``direction`` is ``imports`` or ``imported_by``; ``pos`` is the order of discovery; starts are never their own
    neighbours.  ``starts`` holds (keys…, start).  Each hop is one join of its frontier with the edges, staged, so the
    plan of a hop doesn't grow with their number; the search ends when a frontier is empty, whatever the depth.
    """
    spark = edges.sparkSession
    node = [*keys, "start", "direction"]
    if depth > 1:
        edges = staged(edges, "edges")  # read in each hop
    both = edges.select(*keys, F.lit("imports").alias("direction"), F.col("src").alias("_from"), F.col("dst").alias("path"), F.col("out_pos").alias("_pos")).unionByName(
        edges.select(*keys, F.lit("imported_by").alias("direction"), F.col("dst").alias("_from"), F.col("src").alias("path"), F.col("in_pos").alias("_pos"))
    )
    begin = starts.select(*keys, "start").where("start is not null").distinct().withColumn("direction", F.explode(F.array(F.lit("imports"), F.lit("imported_by"))))
    frontier = begin.select(*node, F.col("start").alias("path"), F.lit(0).alias("hops"), F.lit(0).alias("_at"))
    seen = frontier
    growing = Growing(spark, "seen") if depth > 1 else None
    order = W.partitionBy(*node).orderBy("_key")
    for hop in range(1, depth + 1):
        if growing is not None:
            seen = growing.append(frontier)
            frontier = seen.where(F.col("hops") == hop - 1)
            if frontier.isEmpty():
                break
        step = (
            frontier.select(*node, F.col("path").alias("_from"), "_at")
            .join(both, [*keys, "direction", "_from"])
            .groupBy(*node, "path")
            .agg(F.min(F.struct("_at", "_pos")).alias("_key"))
            .join(seen.select(*node, "path"), [*node, "path"], "left_anti")
        )
        # Found in the order of the files that lead there, then of their imports.
        frontier = step.select(*node, "path", F.lit(hop).alias("hops"), F.row_number().over(order).alias("_at"))
    else:
        seen = seen.unionByName(frontier)
    place = W.partitionBy(*node).orderBy("hops", "_at")
    return seen.where("hops > 0").select(*node, "path", "hops", (F.row_number().over(place) - 1).alias("pos"))

"""Packing: the ranked chunks that fit a token budget, in one Markdown bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.functions.textops import token_estimate
from corvane.operators.budget import check_budget, fit_to_budget
from corvane.operators.ranges import sliced_texts, subtract_covered
from corvane.plans.index import Index
from corvane.plans.ranking import DEFAULT_TOP, rank_tasks


def pack_rows(ranked: DataFrame, texts: DataFrame, keys: list[str], budget: Column | float) -> DataFrame:
    """(task_id, keys…, rank, path, start_line, end_line, tokens, used, included, text) of ranked chunks.

    Lines that a better chunk of the same task covers are left out of later ones; what remains is costed by its
    text and kept up to the first overflow of the budget.
    """
    at = [*keys, "path"]
    segments = staged(subtract_covered(ranked, ["task_id", *at]), "segments")  # read for the ranges to cut and for what they belong to
    cut = sliced_texts(segments, texts, at)
    read = segments.join(cut, [*at, "start_line", "end_line"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    costed = read.withColumn("tokens", token_estimate(F.col("text")))
    return fit_to_budget(costed, ["task_id"], ["rank", "start_line"], "tokens", budget)


def trimmed_files(packed: DataFrame) -> DataFrame:
    """(task_id, path, fully, pos): files that lost a segment, in the order of loss from 0, and whether nothing of them is left."""
    per = packed.groupBy("task_id", "path").agg(
        F.min(F.when(~F.col("included"), F.struct("rank", "start_line"))).alias("_first"), F.max(F.col("included").cast("int")).alias("_kept")
    )
    pos = F.row_number().over(W.partitionBy("task_id").orderBy("_first")) - 1
    return per.where("_first is not null").select("task_id", "path", (F.col("_kept") == 0).alias("fully"), pos.alias("pos"))


def pack_texts(packed: DataFrame, tasks: DataFrame, files: DataFrame, keys: list[str], command: str = "corvane") -> DataFrame:
    """(task_id, text): the bundle of each task as Markdown; as ``render`` for one.

    ``packed`` holds costed segments, ``tasks`` (task_id, keys…, task, budget), ``files`` (keys…, path, lang).  Files come
    in the order of their best included chunk, chunks in the order of lines.  A bundle is as long as its budget allows.
    """
    lang = packed.join(files.select(*keys, "path", "lang"), [*keys, "path"], "left")
    fence = F.concat(
        F.lit("```"), F.when(F.coalesce("lang", F.lit("")) == "", "text").otherwise(F.col("lang")), F.lit("\n// "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n```\n"),
    )
    kept = F.col("included")
    per_file = lang.groupBy("task_id", "path").agg(
        F.min(F.when(kept, F.struct("rank", "start_line"))).alias("_first"),
        F.min(F.when(~kept, F.struct("rank", "start_line"))).alias("_lost"),
        F.count(F.when(kept, 1)).alias("_n"),
        F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("_used"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("start_line", fence.alias("x"))))), lambda r: r["x"]), "").alias("_chunks"),
    )
    more = F.when(F.col("_lost").isNotNull(), F.concat(F.lit("_(more of "), F.col("path"), F.lit(f" omitted — budget exceeded; see `{command} outline "), F.col("path"), F.lit("`)_\n"))).otherwise("")
    section = F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), F.col("_chunks"), more, F.lit("\n"))
    gone = F.concat(F.lit("- "), F.col("path"), F.lit(f" — see `{command} outline "), F.col("path"), F.lit("`\n"))

    def in_order(by: str, text: F.Column, when: F.Column) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(by).alias("o"), text.alias("x"))))), lambda r: r["x"])

    found = F.col("_n") > 0
    per_task = per_file.groupBy("task_id").agg(
        F.sum("_n").alias("_n"), F.count(F.when(found, 1)).alias("_files"), F.sum("_used").alias("_used"),
        F.array_join(in_order("_first", section, found), "").alias("_sections"), in_order("_lost", gone, ~found).alias("_gone"),
    )
    all_tasks = tasks.select("task_id", "task", "budget").join(per_task, "task_id", "left").na.fill(0, ["_n", "_files", "_used"])
    budget = F.col("budget").cast("string")
    summary = F.when(F.col("_n") == 0, F.concat(F.lit("_no chunks fit within budget "), budget, F.lit("_"))).otherwise(
        F.concat(F.lit("_"), F.col("_n").cast("string"), F.lit(" chunk(s) from "), F.col("_files").cast("string"), F.lit(" file(s), ~"), F.col("_used").cast("string"), F.lit(" tokens (budget "), budget, F.lit(")_"))
    )
    trimmed = F.when(F.size("_gone") > 0, F.concat(F.lit("## Trimmed (not included)\n\n"), F.array_join("_gone", ""))).otherwise("")
    whole = F.concat(F.lit(f"# {command} pack: "), F.coalesce("task", F.lit("")), F.lit("\n\n"), summary, F.lit("\n\n"), F.coalesce("_sections", F.lit("")), F.coalesce(trimmed, F.lit("")))
    return all_tasks.select("task_id", F.concat(F.regexp_replace(whole, r"\n+\z", ""), F.lit("\n")).alias("text"))


@dataclass(frozen=True)
class Included:
    file: str
    start_line: int
    end_line: int
    tokens: int


@dataclass(frozen=True)
class Bundle:
    text: str
    included: list[Included]
    trimmed: list[str]
    tokens: int


def render(task: str, rows: list, langs: dict[str, str], budget: float, command: str = "corvane") -> Bundle:
    """The bundle of costed rows in rank order: a header, the included chunks by file, and what was left out."""
    kept = [r for r in rows if r["included"]]
    lost = list(dict.fromkeys(r["path"] for r in rows if not r["included"]))
    used = sum(r["tokens"] for r in kept)
    by_file: dict[str, list] = {}
    for r in kept:
        by_file.setdefault(r["path"], []).append(r)
    shown = int(budget) if budget == int(budget) else budget
    summary = f"_{len(kept)} chunk(s) from {len(by_file)} file(s), ~{used} tokens (budget {shown})_" if kept else f"_no chunks fit within budget {shown}_"
    out = [f"# {command} pack: {task}", "", summary, ""]
    for file, chunks in by_file.items():
        out += [f"## {file}", ""]
        for r in sorted(chunks, key=lambda r: r["start_line"]):
            out += [f"```{langs.get(file) or "text"}", f"// {file}:{r["start_line"]}-{r["end_line"]}", r["text"], "```"]
        if file in lost:
            out.append(f"_(more of {file} omitted — budget exceeded; see `{command} outline {file}`)_")
        out.append("")
    gone = [f for f in lost if f not in by_file]
    if gone:
        out += ["## Trimmed (not included)", "", *(f"- {f} — see `{command} outline {f}`" for f in gone), ""]
    text = "\n".join(out).rstrip("\n") + "\n"
    return Bundle(text, [Included(r["path"], r["start_line"], r["end_line"], r["tokens"]) for r in kept], lost, used)


def pack(index: Index, texts: DataFrame, task: str, *, budget: float, top: int = DEFAULT_TOP, include_tests: bool = False) -> Bundle:
    """Rank, cost and render one task over a single corpus; only the ranked rows reach the driver."""
    check_budget(budget)
    spark = index.chunks.sparkSession
    tasks = spark.range(1).select(F.lit(0).alias("task_id"), F.lit(task).alias("task"))
    ranked = rank_tasks(index, tasks, top=top, include_tests=include_tests)
    rows = pack_rows(ranked, texts, index.keys, budget).orderBy("rank", "start_line").collect()
    paths = sorted({r["path"] for r in rows})
    langs = {r["path"]: r["lang"] for r in index.files.where(F.col("path").isin(paths)).select("path", "lang").collect()} if paths else {}
    return render(task, rows, langs, budget)

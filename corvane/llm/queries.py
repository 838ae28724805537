"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.sql import SQL  # noqa: F401
from corvane.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of which a record is among the elite; of those, the ones it repeats (4 times or more) and 2 to 6 records share."""
    from corvane.llm.term_weights import distinctive_terms

    scored = distinctive_terms(table(spark, d, "candidate"), "cand_id", "code", min_elite=0.5, min_count=4, min_df=2, max_df=6)
    return scored.select(F.col("record_id").alias("cand_id"), "term").distinct()


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every record with its score: of the code of candidates, and of the symbols that results show."""
    from corvane.llm.term_weights import distinctive_terms

    code = distinctive_terms(table(spark, d, "candidate"), "cand_id", "code")
    shown = table(spark, d, "rank_result").select(F.regexp_replace("symbol", r"\(\)$", "").alias("symbol")).where("symbol != ''")
    symbols = distinctive_terms(shown.withColumn("name", F.col("symbol")), "name", "symbol")
    return code.select(F.lit("code").alias("field"), F.col("record_id").cast("string").alias("record"), "term", "score").unionByName(
        symbols.select(F.lit("symbol").alias("field"), F.col("record_id").alias("record"), "term", "score")
    )


def p2_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its layout statistics and, if nobody wrote it by hand, the reason."""
    from corvane.llm.generated_files import judged_files

    return judged_files(table(spark, d, "files"), table(spark, d, "file_text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written source of their repo."""
    return p2_judged(spark, d).where("reason is not null").select("file_id").distinct()


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    """Files like one of another repo, with the similarity of the likest."""
    from corvane.llm.generated_files import near_copies

    return near_copies(table(spark, d, "files"), table(spark, d, "file_text")).select("file_id", F.round("copy_similarity", 6).alias("copy_similarity"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Functions with their documentation."""
    from corvane.llm.function_docs import documented_functions

    return documented_functions(table(spark, d, "files"), table(spark, d, "file_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The entries of files.symbols that have documentation."""
    return p3_pairs(spark, d).select("file_id", "sym_line").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are too large and come out in pieces."""
    return p4_pieces(spark, d).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of oversized chunks."""
    from corvane.llm.splitting import oversized_pieces

    return oversized_pieces(table(spark, d, "included_chunk"), table(spark, d, "candidate"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of code and of symbol names with its counts and verdict."""
    from corvane.llm.term_frequency import term_frequencies

    code = term_frequencies(table(spark, d, "candidate"), "code", id_col="cand_id").withColumn("field", F.lit("code"))
    files = table(spark, d, "files").where("symbols is not null").select(F.col("symbols.name").alias("names"))
    symbol = term_frequencies(files, "names").withColumn("field", F.lit("symbol"))
    return code.unionByName(symbol).select("field", "term", "occurrences", "records", "verdict")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be of use."""
    return p5_terms(spark, d).where("verdict is not null").select("field", "term", "verdict")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the number of its windows found."""
    from corvane.llm.leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaked test items by document."""
    return p6_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their weight even with all repeats: their slots of the mix outrun their blocks."""
    from corvane.llm.mixing import short_sources

    return short_sources(table(spark, d, "documents"), table(spark, d, "mix_target")).select("source")


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: each use of a document with its slot in the schedule."""
    from corvane.llm.mixing import mixed_documents

    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix really reaches."""
    from corvane.llm.mixing import reached_shares

    return reached_shares(table(spark, d, "documents"), table(spark, d, "mix_target")).withColumn("share", F.round("share", 9))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text lost its end."""
    from corvane.llm.truncation import truncated_texts

    return truncated_texts(table(spark, d, "documents")).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts."""
    from corvane.llm.truncation import truncation_rates

    return truncation_rates(table(spark, d, "documents")).withColumn("rate", F.round("rate", 9))


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_copies, p2_judged, p3_found, p3_pairs, p4_found, p4_pieces, p5_found, p5_terms, p6_found, p6_leaks, p7_found, p7_mixed, p7_shares, p8_found, p8_rates)}


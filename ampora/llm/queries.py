"""Queries of the text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampora.llm import boilerplate, language, leakage, names, oracle, packing, repeats, residue, survivors
from ampora.session import spread, table


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The texts with those columns, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with real content, with the numbers of their furniture lines."""
    documents = _texts(spark, sf_dir, "url", "title", "lang").where("text IS NOT NULL")
    good = documents.where(~residue.is_residue(F.col("text")))
    return boilerplate.furniture_lines(good, table(spark, sf_dir, "page_capture"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that isn't the article."""
    return _articles(spark, sf_dir).select("doc_id", F.explode("furniture").alias("line_no"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of spellings of one party."""
    return names.found(table(spark, sf_dir, "project_intel"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that supplies each field of each project."""
    return survivors.found(table(spark, sf_dir, "projects"), table(spark, sf_dir, "sources"))


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each field of each project that is closest to the weighted consensus of its rows."""
    projects = table(spark, sf_dir, "projects")
    values = survivors.field_values(projects, table(spark, sf_dir, "sources"))
    return survivors.several(survivors.consensus_survivors(values, survivors.record_weight()), projects)


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per project, with the rows that supply its fields."""
    projects = table(spark, sf_dir, "projects")
    best = survivors.several(survivors.survivors(survivors.field_values(projects, table(spark, sf_dir, "sources"))), projects)
    return survivors.records(best).select("canonical_key", F.to_json("fields").alias("fields"), F.to_json("suppliers").alias("suppliers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without real content or with an unfilled template."""
    return residue.found(_texts(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line repeated in its source."""
    return repeats.repeated_lines(_texts(spark, sf_dir, "source_id"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of each capacity."""
    return packing.containers(_texts(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the documents that repeat at least half of it."""
    return leakage.found(_texts(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main languages that the label doesn't give, and paragraphs in another language."""
    return language.found(_articles(spark, sf_dir), language.fit(table(spark, sf_dir, "lang_samples")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_records": p5_records, "p6_found": p6_found, "p7_found": p7_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()

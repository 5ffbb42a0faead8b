"""Sinks: content-addressed archive, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Writes each distinct page once below its content's digest, unless it's there; returns what was new."""
    spark = pages.sparkSession
    new = pages.where("html IS NOT NULL").select(F.sha2("html", 256).alias("digest"), "html").dropDuplicates(["digest"]).withColumn("shard", F.substring("digest", 1, 2))
    try:
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except Exception as e:  # nothing archived so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("shard").parquet(path)
    return new


def snapshot(projects: DataFrame, scan_id: str, snapshot_id: str, path: str, include_flagged: bool = False) -> None:
    """An immutable selection of a scan's projects; refuses while some aren't approved unless ``include_flagged``."""
    own = projects.where(F.col("scan_id") == scan_id)
    undecided = own.where("status IS NULL OR status NOT IN ('approved', 'auto_approved')").limit(1).count()
    if undecided and not include_flagged:
        raise ValueError("projects are undecided")
    own.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("errorifexists").partitionBy("snapshot_id").parquet(f"{path}/{snapshot_id}")


def json_export(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """A snapshot's rows as JSON, one per line."""
    rows = spark.read.parquet(f"{path}/{snapshot_id}")
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "snapshot_id"])).alias("value"))


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table, bars and line breaks escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("value"))


def report_lines(projects: DataFrame, coverage: DataFrame, fields: list[str]) -> DataFrame:
    """``place, line`` of a report: counts, coverage (label, n), a table of the rows, what is doubtful. Ordered by place, never collected."""
    spark = projects.sparkSession
    ok = F.col("status").isin("approved", "auto_approved")
    counts = projects.agg(F.count("*").alias("n"), F.count_if(ok).alias("reviewed"))
    top = counts.select(F.posexplode(F.array(F.lit("# Report"), F.concat(F.lit("- rows: "), "n"), F.concat(F.lit("- reviewed: "), "reviewed"), F.concat(F.lit("- doubtful: "), F.col("n") - F.col("reviewed"))))).select(F.struct(F.lit(0).alias("part"), F.col("pos").cast("string").alias("key")).alias("place"), F.col("col").alias("line"))
    covered = coverage.select(F.struct(F.lit(1).alias("part"), F.col("label").alias("key")).alias("place"), F.concat(F.lit("- "), "label", F.lit(": "), F.col("n").cast("string")).alias("line"))
    head = spark.createDataFrame([(2, "", "| " + " | ".join([*fields, "url", "score", "status"]) + " |"), (2, " ", "| " + " | ".join(["---"] * (len(fields) + 3)) + " |")], "part int, key string, line string").select(F.struct("part", "key").alias("place"), "line")
    flat = projects.select("row_id", *[F.coalesce(F.get_json_object("fields_json", f"$.{f}"), F.lit("")).alias(f) for f in fields], F.col("primary_url").alias("url"), F.col("score").cast("string").alias("score"), "status", "conflicts_json")
    order = F.lpad(F.col("row_id").cast("string"), 20, "0")
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    body = flat.select(F.struct(F.lit(3).alias("part"), order.alias("key")).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in [*fields, "url", "score", "status"]]), F.lit(" |")).alias("line"))
    names = F.concat_ws(", ", F.transform(F.from_json("conflicts_json", "array<struct<field:string>>"), lambda c: c["field"]))
    doubtful = flat.where((F.json_array_length("conflicts_json") > 0) | (F.col("status") == "review")).select(F.struct(F.lit(4).alias("part"), order.alias("key")).alias("place"), F.concat(F.lit("- "), order, F.lit(": "), F.when(names != "", names).otherwise("to be confirmed")).alias("line"))
    return top.unionByName(covered).unionByName(head).unionByName(body).unionByName(doubtful)


def registered_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, exists, size`` of the files below a folder that the executors share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(path, True) if system.exists(path) else None
    rows = []
    while files is not None and files.hasNext():
        f = files.next()
        rows.append((f.getPath().getName(), True, int(f.getLen())))
    return spark.createDataFrame(rows, "path string, exists boolean, size long")


def workbook_export(rows: DataFrame, fields: list[str], path: str) -> int:
    """A bounded selection as a workbook: one column per field, a second one for those that a foreign row fills, and the address.

    Needs columns of ``fields``, ``original`` (map of field to text), ``foreign`` (boolean) and ``url``; more than ``MAX_ROWS`` rows are an error.
    """
    from ampora.sources.workbook import MAX_ROWS, write

    filled = lambda f: F.bool_or(F.col("foreign") & (F.trim(F.coalesce(F.try_element_at("original", F.lit(f)), F.col(f).cast("string"), F.lit(""))) != ""))
    both = rows.agg(*[F.coalesce(filled(f), F.lit(False)).alias(f) for f in fields]).first().asDict()
    columns = [c for f in fields for c in [(f, F.col(f)), *([(f"{f} (original)", F.try_element_at("original", F.lit(f)))] if both[f] else [])]]
    chosen = rows.select(*[e.alias(n) for n, e in columns], F.col("url").alias("url")).limit(MAX_ROWS + 1).collect()
    if len(chosen) > MAX_ROWS:
        raise ValueError(f"a workbook holds {MAX_ROWS} rows at most")
    return write(path, [n for n, _ in columns] + ["url"], map(tuple, chosen))

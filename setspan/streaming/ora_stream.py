"""Incremental over-representation: every new differential table becomes a new contrast."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setspan.operators.de import directed_hits, table_universe
from setspan.operators.ora import ora
from setspan.session import cut_lineage

RESULT_SCHEMA = (
    "direction string, collection string, term_id string, overlap long, n_hits long, set_size long, "
    "n_universe long, pvalue double, padj double, qvalue double, batch_id long, contrast string"
)
DE_SCHEMA = (
    "contrast string, gene_id string, value double, direction string, is_sig boolean"
)


def ledger_path(output_dir: str) -> str:
    return output_dir.rstrip("/") + "_tested"


def read_incremental(spark: SparkSession, output_dir: str) -> DataFrame:
    """The results so far; contrasts are text, whatever their folders look like."""
    return spark.read.schema(RESULT_SCHEMA).parquet(output_dir)


def refuse(rows: DataFrame, why: str) -> None:
    bad = rows.select("contrast").limit(5).collect()
    if bad:
        raise ValueError(f"{why}: " + ", ".join(r["contrast"] for r in bad))


def seen_before(batch: DataFrame, batch_id: int, output_dir: str) -> DataFrame:
    """Contrasts of this batch that another batch has tested; a replayed batch is fine."""
    try:
        ledger = batch.sparkSession.read.schema("contrast string, batch_id long").parquet(ledger_path(output_dir))
    except AnalysisException:  # nothing written yet
        return batch.where(F.lit(False)).select("contrast")
    other = ledger.where(F.col("batch_id") != batch_id).select("contrast")
    return batch.select("contrast").distinct().join(other, "contrast", "left_semi")


def run_tests(de: DataFrame, term_gene: DataFrame, batch_id: int, output_dir: str, options: dict) -> None:
    """Results into the partitions of their contrasts, then the contrasts into the ledger."""
    result = ora(directed_hits(de), term_gene, table_universe(de), **options)
    result.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("contrast").parquet(output_dir)
    de.select("contrast").distinct().write.mode("overwrite").parquet(f"{ledger_path(output_dir)}/batch_id={batch_id}")


def ora_incremental(
    spark: SparkSession,
    input_dir: str,
    term_gene: DataFrame,
    output_dir: str,
    checkpoint_dir: str,
    max_files: int = 1000,
    **options,
) -> StreamingQuery:
    """Test contrasts that landed since the last run and stop.

    One Parquet file holds one whole contrast, so a batch needs nothing from other batches.
    Results overwrite their contrast's partition, which makes a replayed batch harmless. A
    contrast spread over files of one batch, or landing again later, is rejected. Tested contrasts
    stand in a ledger (``ledger_path``), written after the results and one folder a batch, so a
    contrast without any result is known too and no batch reads earlier results.
    """
    tables = (
        spark.readStream.schema(DE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(input_dir)
        .withColumn("_file", F.col("_metadata.file_path"))
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            files = batch.groupBy("contrast").agg(F.countDistinct("_file").alias("files"))
            refuse(files.where("files > 1"), "contrast in several files")
            refuse(seen_before(batch, batch_id, output_dir), "contrast already tested")
            run_tests(batch.drop("_file"), term_gene, batch_id, output_dir, options)
        finally:
            batch.unpersist()

    return (
        tables.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def landed_path(output_dir: str) -> str:
    return output_dir.rstrip("/") + "_landed"


def ora_incremental_parts(
    spark: SparkSession,
    input_dir: str,
    manifest_dir: str,
    term_gene: DataFrame,
    output_dir: str,
    checkpoint_dir: str,
    max_files: int = 1000,
    **options,
) -> StreamingQuery:
    """Test contrasts that come in several files, each as soon as all of its files have landed.

    ``manifest_dir`` gets Parquet rows (contrast, n_files); they may land before, between or after the
    files. A batch notes in a log (``landed_path``, one folder a batch, so a replay writes the same) which
    files and manifest rows it saw; it reads the rows of those contrasts alone that it completes, from
    their own files, so what waits is a row a file and not the tables. A file of several contrasts is
    a part of each. Refused are a contrast with more files than its manifest says, with two different
    manifest rows, and with a file or manifest row that lands after it was tested.
    """

    def source(schema: str, folder: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)

    files = source("contrast string", input_dir).select(
        "contrast", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("n_files")
    )
    stated = source("contrast string, n_files long", manifest_dir).select(
        "contrast", F.lit(None).cast("string").alias("file"), "n_files"
    )
    log_schema = "contrast string, file string, n_files long, batch_id long"

    def process(batch: DataFrame, batch_id: int) -> None:
        here = f"{landed_path(output_dir)}/batch_id={batch_id}"
        batch.distinct().write.mode("overwrite").parquet(here)
        log = spark.read.schema(log_schema).parquet(landed_path(output_dir))
        # A batch that is repeated does not look at later ones.
        log = log.where(F.col("batch_id") <= batch_id)
        now = log.where(F.col("batch_id") == batch_id).select("contrast").distinct()
        refuse(seen_before(now, batch_id, output_dir), "contrast already tested")
        known = log.join(now, "contrast", "left_semi").groupBy("contrast").agg(
            F.countDistinct("file").alias("files"), F.countDistinct("n_files").alias("manifests"),
            F.max("n_files").alias("n_files"), F.collect_set("file").alias("paths"),
        ).persist()
        try:
            refuse(known.where("manifests > 1"), "contrast with different manifest rows")
            refuse(known.where("files > n_files"), "contrast with more files than its manifest says")
            done = known.where("files = n_files and files > 0").select("contrast", "paths")
            # Names of files, as the source lists them too; the scan opens no others.
            paths = [r["path"] for r in done.select(F.explode("paths").alias("path")).distinct().toLocalIterator()]
            if paths:
                rows = spark.read.schema(DE_SCHEMA).parquet(input_dir).where(F.col("_metadata.file_path").isin(paths))
                de = cut_lineage(rows.join(done.select("contrast"), "contrast", "left_semi"))
                run_tests(de, term_gene, batch_id, output_dir, options)
        finally:
            known.unpersist()

    return (
        files.unionByName(stated)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )

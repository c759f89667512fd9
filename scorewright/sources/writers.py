"""Sinks: tables, bucketed and partitioned layouts, submissions, lineage graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.plans.specs import TableSpec


def create_table_as(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).format("parquet").saveAsTable(name)


def write_table(df: DataFrame, spec: TableSpec, mode: str = "errorifexists") -> None:
    """df as the table of a spec: its partitions, and its buckets, so that later joins and aggregations by the bucket columns need no shuffle."""
    comments = {c[0].lower(): c[2] for role in (spec.entitys, spec.dimensions, spec.extra_col, spec.snapshot_col, spec.partitioned_by) for c in role}
    df = df.select(*[F.col(c).alias(c, metadata={"comment": comments[c.lower()]}) if c.lower() in comments else F.col(c) for c in df.columns])
    writer = df.write.mode(mode).format(spec.stored_as)
    if spec.partitioned_by:
        writer = writer.partitionBy(*[c[0] for c in spec.partitioned_by])
    if spec.clustered_by:
        writer = writer.bucketBy(spec.bucket_num, *spec.clustered_by).sortBy(*spec.clustered_by)
    writer.saveAsTable(f"{spec.database}.{spec.name}")


def write_submission(df: DataFrame, key: str, path: str) -> None:
    """A headed CSV file sorted by key. One file is the format's rule, so one task writes it."""
    df.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_edges(edges: DataFrame, project_tag: str, path: str) -> None:
    """Lineage edges in a folder of their project; writing a project again replaces it alone."""
    edges.write.mode("overwrite").parquet(f"{path}/project_tag={project_tag}")


def delete_project(spark: SparkSession, project_tag: str, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/project_tag={project_tag}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

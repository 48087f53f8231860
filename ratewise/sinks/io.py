"""Writers and lineage cuts (SNK-01..05).

Vanilla parquet has no ``MERGE INTO``; upserts are a keyed full outer
join written to a *new* location (never overwrite a path that is being
read), then the caller swaps the table pointer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.session import checkpoint_dir

#: Tasks (and so files) that the rows of one partition are dealt over at most.
FILES_PER_PARTITION = 4


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once and cut its lineage.

    The rows are written as a Parquet table under the shared folder named
    by ``spark.checkpoint.dir`` (visible to every executor, survives the
    loss of any of them; never a local checkpoint) and read back, so the
    consumers scan a columnar file with pushdown instead of re-running the
    plan.  Used where one intermediate table feeds several branches.
    """
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merge_by_key(target: DataFrame, source: DataFrame, keys: list[str],
                 created_col: str | None = "created_at", updated_col: str | None = "updated_at",
                 now=None) -> DataFrame:
    """SNK-01: upsert.  Matched keys take the source values (keeping the
    target's ``created_at``), new keys are inserted, other target rows
    stay.  Returns the merged table (one full outer join on the keys)."""
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias("t__" + c) for c in cols], F.lit(True).alias("t__hit"))
    s = source.select(*keys, *[F.col(c).alias("s__" + c) for c in cols if c in source.columns],
                      F.lit(True).alias("s__hit"))
    j = t.join(s, keys, "full_outer")
    out = []
    for c in cols:
        if c == created_col:
            out.append(F.coalesce(F.col("t__" + c), F.col("s__" + c) if c in source.columns else F.lit(now)).alias(c))
        elif c == updated_col and now is not None:
            out.append(F.when(F.col("s__hit"), F.lit(now)).otherwise(F.col("t__" + c)).alias(c))
        elif c in source.columns:
            out.append(F.when(F.col("s__hit"), F.col("s__" + c)).otherwise(F.col("t__" + c)).alias(c))
        else:
            out.append(F.col("t__" + c).alias(c))
    return j.select(*keys, *out)


def new_table(spark: SparkSession, name: str) -> str:
    """The path of a new, empty table under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ratewise-tables/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Write with dynamic partition overwrite: only the partitions present
    in ``df`` are replaced (SNK-02/03).  Rows are dealt by partition (and,
    within it, by all columns), so a partition is few files and a large one
    is not one task's."""
    parts = df.repartition(*partition_cols, F.pmod(F.xxhash64(*df.columns), F.lit(FILES_PER_PARTITION)))
    (parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def append(df: DataFrame, path: str) -> None:
    """Rows added to a table of evaluations or audit entries (SNK-04/05)."""
    df.write.mode("append").parquet(path)


def audit_rows(changes: DataFrame, key_cols: list[str], old_cols: dict[str, str], new_cols: dict[str, str],
               action: str, entity: str, user: str, reason, at) -> DataFrame:
    """SNK-05: audit rows with the old / new values (field -> column) as JSON
    documents, the reason and the time of each change."""
    doc = lambda cols: F.to_json(F.struct(*[F.col(c).alias(f) for f, c in cols.items()]))
    return changes.select(
        F.lit(action).alias("action_type"), F.lit(entity).alias("entity_type"),
        F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols]).alias("entity_id"),
        doc(old_cols).alias("old_value"), doc(new_cols).alias("new_value"),
        F.lit(user).alias("user_name"), reason.alias("reason"), at.alias("created_at"))

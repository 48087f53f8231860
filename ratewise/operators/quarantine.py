"""Rows that cannot be used, set aside with the reason (PRC-07).

A run goes on when some of its units fail: a rule is an expression that is true
of a broken row (parsed by ``try_*`` functions, so it never raises), and a unit
with a broken row is set aside whole, with all reasons.  Good units are saved,
the others go to a table of their own, and the run's statistics are counted
from what was written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.sinks import io


def with_reasons(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``reasons``, the names of the rules that each breaks, in
    their order; a rule that is NULL is not broken."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*broken)))


def split(rows: DataFrame, unit: list[str], rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of the good units, and those of the others with their unit's
    ``reasons``.  NULL is a value of a unit like any other."""
    marked = with_reasons(rows, rules)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons"))))  # as many as there are rules
    bad = marked.where(F.size("reasons") > 0).groupBy(*[F.col(c).alias(f"_{c}") for c in unit]).agg(every.alias("_reasons"))
    same = F.lit(True)
    for c in unit:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    good = rows.join(bad, same, "left_anti")
    return good, rows.join(bad, same).select(*rows.columns, F.col("_reasons").alias("reasons"))


def save_run(rows: DataFrame, folder: str, unit: list[str], rules: Mapping[str, Column], run: list[str]) -> tuple[DataFrame, DataFrame]:
    """Writes a run's good and quarantined rows and returns both tables, all
    runs of them.  A run that is saved again replaces its own partitions."""
    rows = io.materialize(rows, "run")
    out = []
    for name, part in zip(("saved", "quarantine"), split(rows, unit, rules), strict=True):
        io.write_partitioned(part, f"{folder}/{name}", run)
        out.append(rows.sparkSession.read.schema(part.schema).parquet(f"{folder}/{name}"))  # a schema: it may hold no rows
    return out[0], out[1]


def run_statistics(saved: DataFrame, quarantine: DataFrame, unit: list[str], run: list[str], names: Mapping[str, str]) -> DataFrame:
    """Per run: processed units, units and rows set aside, rows generated and
    saved, and one error text per unit that failed.  ``names`` gives a letter to
    the columns that name a unit in its error."""
    of = lambda df, alias: df.groupBy(*run).agg(F.count("*").alias(f"{alias}_rows"), F.count_distinct(F.struct(*unit)).alias(f"{alias}_units"))
    label = F.concat_ws("/", *[F.concat(F.lit(letter), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c, letter in names.items()])
    errors = (quarantine.select(*run, F.concat(label, F.lit(": "), F.concat_ws(", ", "reasons")).alias("e")).distinct()
              .groupBy(*run).agg(F.array_sort(F.collect_list("e")).alias("errors")))  # a text per unit
    j = of(saved, "saved").join(of(quarantine, "quarantined"), run, "full_outer").join(errors, run, "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return j.select(*run, n("saved_units").alias("units_processed"), n("quarantined_units").alias("units_failed"),
                    (n("saved_rows") + n("quarantined_rows")).alias("recommendations_generated"), n("saved_rows").alias("recommendations_saved"),
                    n("quarantined_rows").alias("recommendations_quarantined"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))

"""Characters saved by each step of the compaction, per command family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compact import fold_steps, prepare


def reduction_by_technique(outputs: DataFrame) -> DataFrame:
    """family, outputs, chars_in and one column of saved characters per step."""
    df = prepare(outputs).filter(~F.col("blank"))
    df = df.select("family", "stripped", F.length("text").alias("_n_in"), F.length("stripped").alias("_n_escapes"))
    names = ["in", "escapes"]
    for name, step in fold_steps("stripped", "stripped"):
        df = step(df).withColumn(f"_n_{name}", F.length("stripped"))
        names.append(name)
    return df.groupBy("family").agg(
        F.count(F.lit(1)).alias("outputs"), F.sum("_n_in").alias("chars_in"),
        *[F.sum(F.col(f"_n_{a}") - F.col(f"_n_{b}")).alias(b) for a, b in zip(names, names[1:])])

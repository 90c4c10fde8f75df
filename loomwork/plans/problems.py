"""Failed runs as problem details: a status and a closed set of members, without nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(error_class: Column, category: Column, cause: Column) -> Column:
    """502 for a value or service failure, 504 for a timeout, 400 for a missing input, else 500."""
    return (
        F.when(error_class == "SchemaValidationError", 502)
        .when(cause == "Timeout", 504)
        .when(category == "service", 502)
        .when(error_class == "MissingInput", 400)
        .otherwise(500)
    )


def problem_details(errors: DataFrame, run_col: str = "run_id") -> DataFrame:
    """(run, status, problem): the problem as JSON text, members that are null left out."""
    said = status(F.col("error_class"), F.col("category"), F.col("cause"))
    body = F.struct(
        F.col("error_class").alias("type"), said.alias("status"), F.col("message").alias("detail"), F.col("name").alias("step"),
        F.col("position"), F.col("category"), F.col("cause"), F.when(F.size("fields") > 0, F.col("fields")).alias("fields"),
    )
    return errors.select(run_col, said.alias("status"), F.to_json(body).alias("problem"))

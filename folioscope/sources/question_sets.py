"""Question sets and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for the expected sections of a question that the collection doesn't answer; fixed value.
NOT_COVERED = "not-covered"
FIELDS = "id string, question string, expect string, answer string, evidence string, pool string, style string"


def write_results(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields left out; an existing path is refused."""
    rows.write.mode("error").json(path)


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions as JSON lines; `expect` is an array of sections, or a text for those out of scope."""
    plain = [c for c in questions.columns if c not in ("expect", "out_of_scope")]
    line = lambda expect: F.to_json(F.struct(*plain, expect.alias("expect")))
    out = F.coalesce("out_of_scope", F.lit(False))
    questions.select(F.when(out, line(F.lit(NOT_COVERED))).otherwise(line(F.col("expect"))).alias("value")).write.mode("error").text(path)


def _expected(expect: Column) -> Column:
    return F.from_json(F.when(expect.startswith("["), expect), "array<string>")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of JSON lines, with `expect` as an array and `out_of_scope`; a single section can stand as a text."""
    expect = F.col("expect")
    alone = F.when(expect != NOT_COVERED, F.array(expect))
    return (
        spark.read.schema(FIELDS)
        .json(path)
        .withColumn("out_of_scope", F.coalesce(expect == NOT_COVERED, F.lit(False)))
        .withColumn("expect", F.coalesce(_expected(expect), F.when(~expect.startswith("["), alone)))
    )

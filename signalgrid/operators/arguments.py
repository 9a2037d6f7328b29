"""Arguments of questions, checked and looked up row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import dim_subject, dim_theater


def resolve_requests(requests: DataFrame, theater: str, subject: str) -> DataFrame:
    """Add the theater's id and label, the subject's name, and why a request is refused.

    An unknown or missing theater means the default one; an unknown or missing subject is an error, named in
    ``refused``. Codes are looked up exactly as written. Both lists are short local tables.
    """
    spark = requests.sparkSession
    theaters = dim_theater(spark).select(F.col("theater").alias("theater_id"), F.col("label").alias("theater_label"))
    subjects = dim_subject(spark).select(F.col("code").alias("_code"), F.col("name").alias("subject_name"))
    known = [row[0] for row in fv.THEATERS]
    asked = requests.withColumn("theater_id", F.when(F.col(theater).isin(known), F.col(theater)).otherwise(
        F.lit(fv.DEFAULT_THEATER)))
    found = asked.join(theaters, "theater_id").join(subjects, F.col(subject) == F.col("_code"), "left").drop("_code")
    return found.withColumn("refused", F.when(F.col("subject_name").isNull(), F.lit("unknown subject")))

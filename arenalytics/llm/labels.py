"""Labelled rows for classifiers: folds by document id, held-out rows never learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo five; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def learnable(frame: DataFrame, labels: DataFrame, label: str, key: str = "key") -> DataFrame:
    """Rows of ``frame`` with ``fold`` and ``label`` (0.0 or 1.0), without the held-out fold.

    A document with several labels has the largest; null labels and labels of unknown documents are left out.
    """
    own = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("double").alias("label"))
    own = own.where(F.col("label").isNotNull() & (fold(F.col("labelled")) != 0)).groupBy("labelled").agg(F.max("label").alias("label"))
    return frame.join(own, F.col(key) == F.col("labelled")).drop("labelled").withColumn("fold", fold(F.col(key)))

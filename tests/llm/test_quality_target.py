from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pricetrail.llm import quality


def test_all_labelled_texts_count(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 997, F.lit("of"), F.col("id") % 31).alias("text"))
    assert np.array_equal(quality.log_ratios(docs, docs), np.zeros(quality.BUCKETS))

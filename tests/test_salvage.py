"""Bad rows of large batches: none takes a good row along."""

from pyspark.sql import functions as F

from clausemill.streaming import runs


def test_a_bad_row_that_shares_many_hash_bits_goes_alone(spark):
    low = F.xxhash64("id").bitwiseAND((1 << 16) - 1)
    twins = spark.range(3_000).groupBy(low.alias("h")).agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").first()["ids"]
    rows = spark.range(3_000).where(F.col("id").isin(twins) | (F.col("id") < 20)).persist()
    done, errors = [], []
    analyse = lambda b: b.select("id", F.when(F.col("id") == twins[0], F.raise_error(F.lit("broken"))).otherwise(F.lit(1)).alias("x"))
    runs._salvaged(rows, analyse, lambda df, part: done.extend(r.id for r in df.collect()), lambda df, code, error, part: errors.extend(r.id for r in df.collect()), "id")
    assert errors == [twins[0]]
    assert sorted(done) == sorted(set(twins[1:]) | set(range(20)) - {twins[0]})

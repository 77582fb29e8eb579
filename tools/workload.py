"""Scale test: the example workload of 80 dense-to-sparse models (about 20 million terms).

    python tools/workload.py [instances per density]

Times generating the terms, storing them sorted, reading them back with their statistics, and
scoring 64 samples of every model.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from bitloom.functions.hashing import portable_hash  # noqa: E402
from bitloom.operators.encoders import instances_of  # noqa: E402
from bitloom.operators.energy import energy  # noqa: E402
from bitloom.operators.generate import coefficients, random_linear, sample_pairs  # noqa: E402
from bitloom.operators.ranges import spread_range  # noqa: E402
from bitloom.operators.validation import term_stats  # noqa: E402
from bitloom.schemas import KEY, Batch  # noqa: E402
from bitloom.session import shared_folder  # noqa: E402
from bitloom.sources.tables import read_batch, write_batch  # noqa: E402
from tools.spark import session  # noqa: E402

VARIABLES = 1000
DENSITIES = [0.01, 0.1, 0.5, 0.9, 1.0]


def main() -> None:
    count = int(sys.argv[1]) if len(sys.argv) > 1 else 16
    spark = session(partitions=32)
    grid = spark.createDataFrame(
        [(f"d{d}", f"seed_{s}", 1000 * k + s, VARIABLES, d)
         for k, d in enumerate(DENSITIES) for s in range(count)],
        "batch string, instance_id string, seed long, n long, density double")
    pairs = coefficients(sample_pairs(grid), "uniform", F.col("i"), F.col("j"), -10, 10)
    batch = Batch(instances_of(grid.withColumnRenamed("n", "num_variables"), "random_qubo"),
                  random_linear(grid, distribution="uniform"), pairs.select(*KEY, "i", "j", "v"))
    path = f"{shared_folder(spark)}/workload"

    def lap(name, action):
        started = time.perf_counter()
        result = action()
        print(name, round(time.perf_counter() - started, 1), result if result else "", flush=True)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    lap("generate and store", lambda: write_batch(batch, path))
    stored = read_batch(spark, path)
    lap("terms", lambda: stored.quadratic.count())
    lap("statistics", lambda: run(term_stats(stored)))
    bits = spread_range(grid.select(*KEY, "n"), "n", "i").withColumn(
        "sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")))
    ).withColumn("x", portable_hash(F.col("sample_id"), F.col("i")) % 2)
    lap("energies of 64 samples", lambda: run(energy(stored, bits)))
    spark.stop()


if __name__ == "__main__":
    main()

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlens.operators import profile as P, quantiles as Q
from supportlens.operators.profile_store import ProfileStore


def test_a_profile_is_kept_current_by_new_files_alone(spark, tmp_path):
    draw = random.Random(6)
    schema = "a DOUBLE, b INT, c DOUBLE, t STRING"
    path = str(tmp_path / "rows")
    rows = [[(draw.choice([None, float("nan"), draw.gauss(1e6, 3.0), 5.0]), draw.randrange(9), None, "x") for _ in range(n)] for n in (700, 300, 1)]
    make = lambda part: spark.createDataFrame(part, schema)
    columns = ["a", "b", "c"]
    store = ProfileStore(spark, str(tmp_path / "store"), make([]).schema, columns)
    make(rows[0]).coalesce(1).write.parquet(path)
    assert len(store.update(path)) == 1 and store.update(path) == []
    for part in rows[1:]:
        make(part).coalesce(1).write.mode("append").parquet(path)
        assert len(store.update(path)) == 1
    every = spark.read.schema(make([]).schema).parquet(path)
    found = {r.column: r for r in store.describe(every).collect()}
    expected = {r.column: r for r in P.describe_numeric(every, columns).collect()}
    for c in ("a", "b"):
        for name in ("count", "min", "q25", "q50", "q75", "max"):
            assert found[c][name] == expected[c][name], (c, name)
        assert found[c]["mean"] == pytest.approx(expected[c]["mean"]) and found[c]["std"] == pytest.approx(expected[c]["std"])
    assert found["c"]["count"] == 0 and found["c"]["q50"] is None
    merged = {r.column: r for r in store.merged().collect()}
    assert merged["b"].about_distinct == 9 and merged["b"].n_rows == 1001
    median = np.median([r[1] for part in rows for r in part])
    assert abs(spark.createDataFrame([(merged["b"].quantiles,)], "q BINARY").select(F.kll_sketch_get_quantile_double("q", F.lit(0.5))).first()[0] - median) <= 1


def test_brackets_that_miss_do_no_harm(spark):
    frame = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    known = {"x": (5000, 0.0, 4999.0)}
    for bracket in ((10.0, 20.0), (2400.0, 2600.0), (2499.0, 2500.0), (2499.5, 2499.5)):
        found = Q.exact_quantiles(frame, ["x"], [0.5], rank_rows=50, known=known, brackets={("x", 0.5): bracket})
        assert found == {"x": {0.5: 2499.5}}

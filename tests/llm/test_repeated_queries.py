"""op2: query rows that share an identifier, and the query against its SQL."""

import duckdb
from pyspark.sql import functions as F

from conftest import SF
from gaugewatch.llm import topk
from gaugewatch.llm.queries import ORACLES, op2_exact_top_k


def test_each_row_of_one_id_gets_its_own_best(spark):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 60)]
    asking = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(asking + vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(rows, F.col("vec_id") == 0, k=4, scale=8).collect()
    wanted = []
    for _, query in asking:
        # One's own id is no candidate; ties go to the smaller id.
        scores = sorted((-sum(int(8 * a) * int(8 * b) for a, b in zip(query, v)), i) for i, v in vectors)
        wanted += [(0, rank, i, -score) for rank, (score, i) in enumerate(scores[:4], 1)]
    assert sorted(tuple(r) for r in found) == sorted(wanted)


def test_query_agrees_with_its_sql(spark):
    found = sorted(tuple(r) for r in op2_exact_top_k(spark, SF).collect())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
        assert found == sorted(db.sql(ORACLES["op2_exact_top_k"]).fetchall()) and found

from tessera import catalog


def test_reductions_over_all_rows(spark, sf_dir):
    queries, part = catalog.queries(), spark.read.parquet(f"{sf_dir}/part.parquet")
    sizes = {}
    for r in part.collect():
        sizes.setdefault(r.p_brand, []).append(r.p_size)
    for name, fold in {"add": sum, "maximum": max, "minimum": min}.items():
        assert {r.p_brand: r.y for r in queries[f"ufunc_reduce_{name}_all"](spark, sf_dir).collect()} == {b: fold(x) for b, x in sizes.items()}


def test_sliding_windows_of_whole_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("sum(size(embedding) - 2) AS n").first().n
    assert catalog.queries()["rows_sliding_all"](spark, sf_dir).count() == vectors

from pyspark.sql import functions as F

from dependra.functions.families import Copula
from dependra.operators import gof
from dependra.plans import catalog, catalog_models


def test_bootstrap_tests_every_brand(spark, small):
    got = {r.p_brand: r for r in catalog.QUERIES["gof_bootstrap"](spark, small).collect()}
    part = spark.read.parquet(f"{small}/part.parquet")
    assert {b: r.n for b, r in got.items()} == {r.p_brand: r["count"] for r in part.groupBy("p_brand").count().collect()}
    brand = sorted(got)[0]
    rows = catalog_models._part_pobs(spark, small).where(F.col("p_brand") == brand).orderBy("p_partkey").toPandas()
    one = gof.bootstrap(spark, Copula("frank"), rows.u.to_numpy(), rows.v.to_numpy(), 39, 5).first()
    assert (got[brand].statistic, got[brand].p_value) == (one.statistic, one.p_value)


def test_large_fit_takes_the_whole_table(spark, small):
    got = catalog.QUERIES["fit_large_table"](spark, small).first()
    assert got.n == spark.read.parquet(f"{small}/lineitem.parquet").count() and got.success

"""Kernels from SQL."""

from kindred.sql import register


def test_registered_functions(spark):
    names = register(spark, "k_")
    assert "k_double_metaphone" in names
    row = spark.sql("SELECT k_porter('building') AS p, k_double_metaphone('Smith') AS d, k_jaro_winkler('Dwayne', 'Duane') AS j, k_mra_compare('Byrne', 'Boern').matching AS m, k_cologne(NULL) AS n, k_eudex('java') = k_eudex('jiva') AS e").first()
    assert (row.p, row.d, round(row.j, 2), row.m, row.n, row.e) == ("build", ["SM0", "XMT"], 0.84, True, None, True)

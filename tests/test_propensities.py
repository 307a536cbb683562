import math

from braidwork.operators import tables


def test_counts_whose_products_exceed_a_long(spark):
    n = 4_000_000_000
    rows = spark.createDataFrame([(4, 0, 0, n), (4, 0, 1, n), (4, 1, 1, 2 * n)], "bin int, a int, b int, n long")
    got = {(r.a, r.b): r.propensity for r in tables.propensities(rows).collect()}
    # symmetrised: 2, 1, 1, 4 of 8; shares 3/8 and 5/8
    assert math.isclose(got[0, 0], math.log(8 * 2 / 9)) and math.isclose(got[1, 1], math.log(8 * 4 / 25)) and math.isclose(got[0, 1], math.log(8 / 15))

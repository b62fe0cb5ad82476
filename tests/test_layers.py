"""Queries a slice cover the slices of every layer."""

import pytest

from orrery import registry as Q

Q.load()

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rips_persistence", "path_torsion"])
def test_all_layers_have_rows(spark, name):
    slices = {tuple(r) for r in Q.QUERIES["geodesic_distortion"](spark, SF).select("label", "layer").collect()}
    got = {tuple(r) for r in Q.QUERIES[name](spark, SF).select("label", "layer").distinct().collect()}
    assert got == slices and {layer for _, layer in got} == {0, 1, 2, 3}

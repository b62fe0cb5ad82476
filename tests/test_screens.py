"""What the null families of the screens move."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import random as R
from orrery.functions.stats import auc
from orrery.operators import geometry
from orrery.plans import nulls as N
from orrery.plans import screens as C

KEYS = ["label", "layer"]


@pytest.fixture(scope="module")
def slices(spark):
    rng = np.random.default_rng(4)
    points = [(0, layer, i, [float(x) for x in rng.normal(size=4)]) for layer in (0, 1) for i in range(24)]
    df = spark.createDataFrame(points, "label int, layer int, vec_id long, vec array<double>").persist()
    other = df.select("label", (1 - F.col("layer")).alias("layer"), "vec_id", "vec")
    pairs = sorted({(i, (i * 5 + k) % 24) for i in range(24) for k in (1, 3) if i < (i * 5 + k) % 24})
    edges = spark.createDataFrame([(0, layer, u, v, (u + v) % 2) for layer in (0, 1) for u, v in pairs], "label int, layer int, u long, v long, y int")
    support = edges.select("label", "layer", F.col("u").alias("source"), F.col("v").alias("target"), (F.col("u") * 0.1).alias("support"))
    return C.Slices(df, edges, tuple(KEYS), support, other, k=6)


def moved(slices, name, kind):
    screen = C.SCREENS[name]
    rows, names = C.features_of(screen)(slices)
    rows = rows.withColumn("edge", F.concat_ws("-", "u", "v")).withColumn("base", F.lit(0.0)).withColumn("bin", F.lit(0)).persist()
    out = C.remade(screen, slices, R.replicates(rows, 2), kind, names, 2)
    assert out.count() == 2 * rows.count()
    get = lambda df, extra: {(*(r[k] for k in KEYS), r.u, r.v, *(r[x] for x in extra)): [r[n] for n in names] for r in df.collect()}
    return names, get(rows, []), get(out, ["perm_idx"])


def test_random_maps_turn_the_points(slices):
    _, _, got = moved(slices, "H62", "random_map_alignment")
    x = {(r.layer, r.vec_id): np.array(r.vec) for r in slices.points.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for (_, layer, u, v, p), (there, back) in got.items():
        m = N.random_basis(4, "random_map_alignment", p)
        assert there == pytest.approx(cos(x[layer, u] @ m, x[1 - layer, v])) and back == pytest.approx(cos(x[layer, v] @ m, x[1 - layer, u]))


def test_layers_change_places_node_by_node(slices):
    names, seen, got = moved(slices, "H63", "layer_order_swap_per_gene")
    at = names.index("mle_mean")
    both = lambda t, *k: sum(t[(0, layer, *k)][at] for layer in (0, 1))
    for _, layer, u, v, p in got:
        assert both(got, u, v, p) == pytest.approx(both(seen, u, v))
    assert any(got[k][at] != pytest.approx(seen[k[:-1]][at]) for k in got)


def test_random_axes_change_the_alignments_alone(slices):
    names, seen, got = moved(slices, "H136", "tangent_basis_random_rotation")
    for i, n in enumerate(names):
        same = all(got[k][i] == pytest.approx(seen[k[:-1]][i]) for k in got)
        assert same == (n not in geometry.AXIAL)


def test_families_take_the_strata_that_they_name(slices):
    of = lambda name, kind: C.strata(C.SCREENS[name], kind)
    assert of("H61", "curvature_shuffle_within_degree_bins") == of("H61", "label_permutation") == ["degree_bin"]
    assert of("H136", "endpoint_swap_within_distance_bins") == of("H63", "endpoint_swap_within_geodesic_bins") == ["bin"]
    assert of("H134", "endpoint_swap_within_distance_degree_bins") == ["bin", "degree_bin"] and of("H62", "signature_destroy_permutation") == []
    names, seen, got = moved(slices, "H61", "curvature_shuffle_within_degree_bins")
    assert got != {(*k, p): v for k, v in seen.items() for p in (0, 1)} and names == ["degree_mean", "degree_gap", "clustering_mean", "clustering_gap"]


REMADE = [
    ("H69", "matched_random_third_nodes"), ("H134", "id_profile_permutation_along_path"), ("H138", "chart_relabel_preserving_chart_size"), ("H126", "path_reversal_within_length_bins"),
    ("H121", "direction_flip_within_path_length_bins"), ("H132", "path_order_permutation"), ("H97", "degree_plus_length_bin_swap"), ("H89", "layer_order_permutation"),
]


@pytest.mark.parametrize("name,kind", [x for x in REMADE if x[1] in C.SCREENS[x[0]].null_kinds])
def test_features_are_made_again(slices, name, kind):
    names, seen, got = moved(slices, name, kind)
    assert set(got) == {(*k, p) for k in seen for p in (0, 1)} and all(np.isfinite(v).all() for v in got.values())
    assert any(got[k] != pytest.approx(seen[k[:-1]]) for k in got)


def test_turned_edges_have_the_features_of_their_exchanged_ends(slices):
    names, seen, got = moved(slices, "H126", "path_reversal_within_length_bins")
    turned = dict(zip(names, range(len(names)), strict=True))
    for k, v in got.items():
        was = seen[k[:-1]]
        back = [-was[i] if n.endswith("gap") or n in ("log_ratio", "margin") else was[turned[n.replace("forward", "#").replace("backward", "forward").replace("#", "backward")]] for n, i in turned.items()]
        assert v == pytest.approx(was) or v == pytest.approx(back)


def test_layers_are_put_in_another_order(slices):
    names, seen, got = moved(slices, "H89", "layer_order_permutation")
    for _, layer, u, v, p in got:
        assert any(got[0, layer, u, v, p] == pytest.approx(seen[0, other, u, v]) for other in (0, 1))


@pytest.mark.parametrize("name,kind", [("H51", "degree_rewire"), ("H108", "perturbation_schedule_permutation"), ("H131", "cycle_order_shuffle"), ("H98", "radius_order_permutation")])
def test_a_family_without_an_implementation_is_refused(slices, name, kind):
    with pytest.raises(NotImplementedError, match=kind):
        moved(slices, name, kind)


def test_a_screen_goes_on_without_a_refused_family(slices):
    kinds = C.SCREENS["H131"].null_kinds
    rows = C.calibrated("H131", slices, 2).collect()
    assert rows and all("cycle_order_shuffle" in r.refused and set(r.refused) <= set(kinds) for r in rows)
    assert len(rows[0].refused) < len(kinds)


def test_the_baseline_is_the_score_a_hypothesis_adds_to(slices):
    assert [C.baseline(C.SCREENS[h]) for h in ("H13", "H61", "H90", "H118", "H136")] == ["near", "near", "base_score", "weighted_score", "weighted_score"]
    slices = replace(slices, edges=slices.edges.withColumn("y", (F.col("u") % 3 == 0).cast("int")))
    got = {(r.label, r.layer): r.auc_base for r in C.run("H139", slices, 1)[0].collect()}
    made = geometry.edge_geometry(slices.points, slices.edges, KEYS, slices.support, slices.k).join(slices.edges, [*KEYS, "u", "v"])
    assert all(a is not None for a in got.values()) and len(got) == 2
    want = {(r.label, r.layer): r.auc for r in auc(made, "y", "weighted_score", KEYS).collect()}
    assert got == pytest.approx(want)


def test_replicates_are_the_references(slices):
    assert {h: C.REPLICATES[h] for h in ("H136", "H61", "H62", "H63", "H90", "H118", "H39")} == {"H136": 24, "H61": 24, "H62": 24, "H63": 24, "H90": 8, "H118": 10, "H39": 20}
    _, drawn = C.run("H118", slices)
    assert {(r.null_kind, r.n) for r in drawn.groupBy("null_kind").agg(F.count_distinct("perm_idx").alias("n")).collect()} == {(k, 10) for k in C.SCREENS["H118"].null_kinds}


def test_the_model_screen_takes_twelve_replicates(spark, monkeypatch):
    from orrery import queries, registry

    registry.load()

    class Taken(Exception):
        pass

    def take(edges, features, baseline, strata, keys, replicates=12, **rest):
        raise Taken(replicates)

    monkeypatch.setattr(queries.screen, "model_screen", take)
    with pytest.raises(Taken, match="12"):
        registry.QUERIES["cv_logit_delta"](spark, "/root/testdata/sf0.001")


def test_random_maps_shuffle_no_replicates(slices):
    screen = C.SCREENS["H62"]
    rows = R.replicates(slices.edges.withColumns({"there": F.lit(0.0), "back": F.lit(0.0)}), 3)
    made = C.remade(screen, slices, rows, "random_map_alignment", ["there", "back"], 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "perm_idx" in line]
    assert made.count() == 3 * slices.edges.count()

"""Named screens: a hypothesis is a feature family over a slice's edges and the null families that it is
held against. All of them are calls of one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import random as R
from ..functions.stats import degree_bins, rank_bins
from ..operators import alignment, descriptors, fits, geometry, graph, models, topology, vectors
from ..operators import support as support_ops
from . import audit, nulls

# The hypotheses, each with its family and the null families that it names.
_LISTED = """
H01 persistent_homology
H02 cross_model_alignment
H03 persistent_homology
H04 intrinsic_dimensionality
H05 null_sensitivity
H06 split_robustness
H07 null_sensitivity
H08 split_robustness
H09 null_sensitivity
H10 manifold_distance
H11 graph_topology
H12 null_sensitivity
H13 manifold_distance
H14 topology_stability
H15 cross_model_alignment
H16 module_structure
H17 cross_model_alignment
H18 intrinsic_dimensionality
H19 module_structure
H20 cross_model_alignment
H21 intrinsic_dimensionality
H22 intrinsic_dimensionality
H23 graph_topology
H24 cross_model_alignment
H25 manifold_distance
H26 module_structure
H27 cross_model_alignment
H28 manifold_distance
H29 cross_model_alignment
H30 topology_stability
H31 manifold_distance
H32 graph_topology
H33 cross_model_alignment
H34 graph_topology
H35 intrinsic_dimensionality
H36 cross_model_alignment
H37 graph_topology
H39 persistent_homology
H38 intrinsic_dimensionality
H40 module_structure
H41 topology_stability
H42 intrinsic_dimensionality
H43 module_structure
H44 topology_stability
H45 intrinsic_dimensionality permutation block_sign_bootstrap
H46 topology_stability
H47 persistent_homology
H48 cross_model_alignment
H49 persistent_homology support_shuffle layer_placebo
H50 topology_stability degree_orientation_null sign_shuffle_null
H51 cross_model_alignment degree_rewire module_shuffle
H52 topology_stability degree_orientation_null sign_shuffle_null split_label_placebo
H53 topology_stability degree_orientation_null sign_shuffle_null random_map_null
H54 intrinsic_dimensionality layer_order_shuffle endpoint_swap_degree_bin label_permutation
H55 topology_stability degree_orientation_null sign_shuffle_null split_label_placebo metric_matched_knn_randomization
H56 topology_stability directed_degree_rewire sign_shuffle_null random_map_transfer_control
H57 manifold_distance distance_matched_endpoint_swap neighborhood_permutation label_permutation
H58 topology_stability bio_weight_shuffle_within_edge_degree_bins random_strata_weight_placebo label_permutation
H59 cross_model_alignment random_map_alignment signature_destroy_permutation
H60 intrinsic_dimensionality endpoint_swap_within_distance_bins estimator_randomization_placebo label_permutation
H61 graph_topology curvature_shuffle_within_degree_bins topology_feature_shuffle_within_degree_bins label_permutation
H62 cross_model_alignment random_map_alignment signature_destroy_permutation anchor_label_shuffle
H63 intrinsic_dimensionality layer_order_swap_per_gene endpoint_swap_within_geodesic_bins label_permutation
H64 persistent_homology margin_shuffle_within_degree_bins support_score_shuffle_within_degree_bins label_permutation
H65 cross_model_alignment random_codebook_mapping token_frequency_matched_shuffle signature_destroy_permutation
H66 intrinsic_dimensionality interaction_partner_shuffle layer_order_permutation_per_gene label_permutation
H67 persistent_homology axis_rank_permutation_within_degree_bins label_permutation
H68 cross_model_alignment random_linear_map anchor_pair_shuffle signature_destroy_permutation
H69 manifold_distance endpoint_swap_within_geodesic_bins matched_random_third_nodes label_permutation
H70 manifold_distance endpoint_swap_within_geodesic_bins matched_random_third_nodes label_permutation
H71 cross_model_alignment random_teacher_signature_assignment anchor_label_shuffle signature_destroy_permutation
H72 topology_stability layer_order_permutation motif_label_shuffle_within_degree_bins
H73 module_structure support_shuffle_within_geodesic_support_bins matched_random_support_within_strata label_shuffle_within_geodesic_bins
H74 cross_model_alignment eigenspectrum_permutation random_orthogonal_basis signature_destroy_permutation
H75 manifold_distance layer_order_permutation curvature_shuffle_within_geodesic_bins label_shuffle_within_geodesic_bins
H76 module_structure support_shuffle_within_gxdxcxontology matched_random_support_within_strata label_shuffle_within_geodesic_bins
H77 cross_model_alignment symbol_permutation random_orthogonal_basis signature_basis_destroy
H78 manifold_distance endpoint_swap_within_geodesic_bins elasticity_feature_shuffle_within_geodesic_bins label_shuffle_within_geodesic_bins
H79 module_structure module_label_permutation matched_random_module_weights label_shuffle_within_geodesic_bins
H80 cross_model_alignment module_label_permutation module_membership_permutation signature_destroy_permutation
H81 manifold_distance endpoint_swap_within_geodesic_bins feature_shuffle_within_geodesic_bins label_shuffle_within_geodesic_bins
H82 persistent_homology matched_random_hotspot_set feature_shuffle_within_geodesic_bins label_permutation
H83 cross_model_alignment module_label_permutation depth_order_permutation signature_destroy_permutation
H84 graph_topology endpoint_swap_within_geodesic_bins feature_shuffle_within_geodesic_bins label_permutation
H85 persistent_homology matched_random_hotspot_set feature_shuffle_within_geodesic_bins label_permutation
H86 cross_model_alignment random_transport_fixed_marginals depth_order_permutation barcode_component_permutation
H87 manifold_distance descriptor_shuffle_within_geodesic_bins endpoint_swap_within_geodesic_bins label_permutation
H88 split_robustness descriptor_shuffle_within_geodesic_bins endpoint_swap_within_geodesic_bins label_permutation
H89 intrinsic_dimensionality layer_order_permutation descriptor_shuffle_within_geodesic_bins label_permutation
H90 topology_stability stability_feature_shuffle_within_geodesic_bins perturbation_profile_shuffle_within_geodesic_bins label_permutation
H91 split_robustness random_feature_subset_control stability_descriptor_shuffle_within_geodesic_bins endpoint_swap_within_geodesic_bins label_permutation
H92 topology_stability scale_order_permutation trajectory_feature_shuffle_within_geodesic_bins label_permutation
H93 persistent_homology confidence_shuffle_within_geodesic_bins sign_flip_control label_permutation
H94 persistent_homology ontology_stratum_shuffle_within_geodesic_bins confidence_feature_shuffle_within_geodesic_bins label_permutation
H95 graph_topology degree_preserving_edge_swap descriptor_shuffle_within_geodesic_bins label_permutation
H96 cross_model_alignment module_score_permutation
H97 graph_topology degree_preserving_edge_swap degree_plus_length_bin_swap degree_plus_length_bridge_strata_swap label_permutation
H98 intrinsic_dimensionality radius_order_permutation neighborhood_assignment_shuffle label_permutation
H99 cross_model_alignment module_membership_permutation role_label_permutation random_subspace_rotation
H100 persistent_homology anchor_permutation_within_length_degree_bins random_background_complex label_permutation
H101 persistent_homology quantile_order_permutation derivative_sign_randomization label_permutation
H102 cross_model_alignment module_membership_permutation depth_order_permutation random_monotone_warp random_subspace_alignment
H103 persistent_homology derivative_quantile_order_permutation interaction_partner_shuffle_within_geodesic_bins label_permutation
H104 manifold_distance layer_order_permutation token_shuffle_within_layer label_permutation
H105 null_sensitivity unconditioned_label_permutation string_degree_conditioned_label_permutation
H106 persistent_homology string_weight_shuffle_within_length_degree_bins triad_closure_node_permutation label_permutation
H107 topology_stability layer_order_permutation token_shuffle_within_layer label_permutation
H108 cross_model_alignment perturbation_schedule_permutation module_label_shuffle random_gene_mapping_baseline
H109 cross_model_alignment perturbation_schedule_permutation module_size_variance_matched_shuffle random_gene_mapping_baseline
H110 topology_stability perturbation_schedule_permutation degree_preserving_local_rewiring label_permutation
H111 topology_stability state_frequency_matched_token_shuffle layer_order_permutation label_permutation
H112 topology_stability occupancy_transition_signature_sequence_permutation layer_order_permutation label_permutation
H113 persistent_homology layer_order_permutation local_complex_degree_bin_node_relabel label_permutation
H114 intrinsic_dimensionality radius_order_permutation local_neighborhood_reshuffle label_permutation
H115 manifold_distance layer_order_permutation label_permutation
H116 module_structure motif_sign_permutation_within_tf_bin label_permutation
H118 module_structure community_size_preserving_label_shuffle trrust_sign_shuffle_within_tf_degree_bin label_permutation
H119 cross_model_alignment disagreement_bin_permutation_within_edge_strata random_gene_mapping_baseline label_permutation
H120 manifold_distance distance_bin_curvature_feature_shuffle degree_bin_curvature_feature_shuffle label_permutation
H121 manifold_distance direction_flip_within_path_length_bins endpoint_swap_within_distance_bins label_permutation
H122 cross_model_alignment random_module_mapping landscape_bin_permutation
H123 module_structure tf_identity_preserving_sign_shuffle motif_decoy_shuffle_matched_tf_target_degree label_permutation
H124 module_structure tf_identity_preserving_sign_shuffle motif_decoy_shuffle_matched_tf_target_degree string_confidence_bin_permutation_within_degree_strata label_permutation
H125 cross_model_alignment anchor_label_permutation_preserving_size random_correspondence_baseline label_permutation
H126 manifold_distance path_reversal_within_length_bins endpoint_swap_within_distance_bins label_permutation
H127 module_structure tf_identity_preserving_sign_shuffle motif_decoy_shuffle_matched_tf_target_degree string_confidence_bin_permutation_within_degree_strata go_membership_permutation_within_degree_strata label_permutation
H128 graph_topology curvature_shuffle_within_degree_bins community_topology_feature_shuffle degree_bin_edge_feature_rewiring label_permutation
H129 manifold_distance path_reversal_within_length_bins endpoint_swap_within_distance_bins scale_order_permutation label_permutation
H130 module_structure tf_identity_preserving_sign_shuffle motif_decoy_shuffle_matched_tf_target_degree string_confidence_bin_permutation_within_degree_strata go_semantic_rewiring_within_depth_proxy_strata label_permutation
H131 cross_model_alignment chart_label_permutation_preserving_sizes cycle_order_shuffle random_orthogonal_map_baseline label_permutation
H132 manifold_distance chart_basis_rotation_shuffle_within_length_bins path_order_permutation endpoint_swap_within_distance_bins label_permutation
H133 persistent_homology axis_rank_permutation_within_degree_bins label_permutation
H134 intrinsic_dimensionality id_profile_permutation_along_path endpoint_swap_within_distance_degree_bins label_permutation
H135 module_structure
H136 manifold_distance endpoint_swap_within_distance_bins tangent_basis_random_rotation label_permutation
H137 cross_model_alignment cross_model_pairing_shuffle kernel_spectrum_permutation
H138 module_structure chart_relabel_preserving_chart_size section_shuffle_within_degree_strata label_permutation
H139 manifold_distance endpoint_swap_within_distance_bins sectional_row_shuffle label_permutation
H140 topology_stability
H141 null_sensitivity
H142 manifold_distance endpoint_swap_within_distance_bins sectional_row_shuffle label_permutation
H143 cross_model_alignment module_permutation anchor_gene_set_shuffle
H144 topology_stability layer_order_permutation label_permutation_layer11
"""


#: Replicates a null family, from the reference's H*_NULL_PERM; 24 where it has none of that name.
REPLICATES: dict[str, int] = {h: n for n, names in {
    4: """
        H88 H91
    """,
    6: """
        H53 H89 H92 H93 H94 H95 H113
    """,
    8: """
        H69 H87 H90 H120 H139 H142
    """,
    10: """
        H118
    """,
    12: """
        H64 H66 H67 H68 H72 H114 H119 H121 H123
    """,
    16: """
        H52 H54 H81 H85 H103 H104 H115 H122
    """,
    18: """
        H97 H98 H134
    """,
    20: """
        H39 H49 H101 H105 H107 H116 H133
    """,
    24: """
        H50 H56 H57 H59 H60 H61 H62 H63 H65 H71 H74 H76 H77 H78 H79 H80 H82 H83 H84 H86 H100 H106 H111 H112 H126 H128 H129 H130
        H131 H132 H136 H138 H143
    """,
    32: """
        H58 H73 H75 H102 H110 H125 H127 H135 H137
    """,
    36: """
        H46 H47 H51
    """,
    40: """
        H44
    """,
    48: """
        H70
    """,
    60: """
        H40
    """,
    64: """
        H55 H99 H109 H124
    """,
    80: """
        H31 H34 H43
    """,
    90: """
        H48
    """,
    96: """
        H108
    """,
    120: """
        H32 H36 H37
    """,
    128: """
        H96
    """,
    140: """
        H45
    """,
    160: """
        H30 H33
    """,
    180: """
        H25 H26 H27 H29
    """,
    300: """
        H35 H38
    """,
    320: """
        H42
    """,
}.items() for h in names.split()}
DEFAULT_REPLICATES = 24


@dataclass(frozen=True)
class Screen:
    name: str
    family: str
    null_kinds: tuple[str, ...]


SCREENS: dict[str, Screen] = {w[0]: Screen(w[0], w[1], tuple(w[2:])) for w in map(str.split, _LISTED.strip().splitlines())}


@dataclass(frozen=True)
class Slices:
    """Points (keys, vec_id, vec), labelled edges (keys, u, v, y) and directed support (keys, source, target,
    support) of the same slices; other: the points of a second space under the same keys."""

    points: DataFrame
    edges: DataFrame
    keys: tuple[str, ...]
    support: DataFrame | None = None
    other: DataFrame | None = None
    k: int = 8


def _met(rows: DataFrame, nodes: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows with mean and absolute difference of node columns over the ends."""
    rows = graph.with_ends(rows, nodes, columns, keys)
    made = {}
    for c in columns:
        made[f"{c}_mean"] = (F.col(f"{c}_u") + F.col(f"{c}_v")) / 2
        made[f"{c}_gap"] = F.abs(F.col(f"{c}_u") - F.col(f"{c}_v"))
    return rows.withColumns(made).na.fill(0.0, list(made))


def _ends(s: Slices, nodes: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    made = [f"{c}_{how}" for c in columns for how in ("mean", "gap")]
    return _met(s.edges, nodes, columns, s.keys).select(*s.keys, "u", "v", "y", *made), made


def _near(s: Slices) -> DataFrame:
    return vectors.knn(s.points, s.k, s.keys)


def _on_edges(s: Slices, features: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return s.edges.join(features.select(*s.keys, "u", "v", *names), [*s.keys, "u", "v"], "left").na.fill(0.0, list(names)), list(names)


def manifold(s: Slices):
    return _on_edges(s, geometry.spread_geometry(s.points, s.edges, s.keys, s.support, s.k), ["detour", "deficit", "diffusion", "defect_median", "defect_tail"])


def sections(s: Slices):
    """Shape of the neighbourhoods at the ends and how the edge lies to their first axes."""
    return _on_edges(s, geometry.sectional_features(s.points, s.edges, s.keys, s.support), [c.split()[0] for c in geometry.SECTION])


def _graph_nodes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return graph.local_clustering(edges, keys).withColumn("degree", F.col("degree").cast("double"))


#: (nodes, columns) of the families whose features are node values met at an edge's ends.
NODES: dict[str, Callable[[Slices], tuple[DataFrame, list[str]]]] = {
    "graph_topology": lambda s: (_graph_nodes(vectors.knn_edges(_near(s), s.keys), s.keys), ["degree", "clustering"]),
    "intrinsic_dimensionality": lambda s: (vectors.local_dimension(_near(s), s.keys).withColumnRenamed("id", "node"), ["two_nn", "mle"]),
    "persistent_homology": lambda s: (geometry.local_persistence(s.points, s.keys, max(s.k, 8)).withColumnRenamed("id", "node"), ["total"]),
}


def graph_shape(s: Slices):
    return _ends(s, *NODES["graph_topology"](s))


def dimension(s: Slices):
    return _ends(s, *NODES["intrinsic_dimensionality"](s))


def _trajectories(s: Slices) -> DataFrame:
    e = vectors.knn_edges(_near(s), s.keys)
    nodes = s.points.select(*s.keys, F.col("vec_id").alias("node"))
    rows = topology.edge_connectivity(s.edges, e, nodes, [0.1, 0.25, 0.5, 0.75], s.keys)
    return rows.withColumn("edge", F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")))


def filtration(s: Slices):
    rows = topology.trajectory_shape(_trajectories(s))
    rows = rows.withColumn("onset", F.col("onset").cast("double"))
    return _on_edges(s, rows, ["area", "onset", "slope"])


def homology(s: Slices):
    return _ends(s, *NODES["persistent_homology"](s))


def _communities(s: Slices) -> DataFrame:
    return geometry.communities(s.points, s.keys, s.k).select(*s.keys, F.col("id").alias("node"), "community")


def _same(edges: DataFrame, communities: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = graph.with_ends(edges, communities, ["community"], keys)
    return rows.withColumn("same", (F.col("community_u") == F.col("community_v")).cast("double"))


def modules(s: Slices):
    rows = _same(s.edges, _communities(s), s.keys)
    names = ["same"]
    if s.support is not None:
        there = s.support.select(*s.keys, F.col("source").alias("u"), F.col("target").alias("v"), F.col("support").alias("there"))
        back = s.support.select(*s.keys, F.col("source").alias("v"), F.col("target").alias("u"), F.col("support").alias("back"))
        rows = rows.join(there, [*s.keys, "u", "v"], "left").join(back, [*s.keys, "u", "v"], "left").na.fill(0.0, ["there", "back"])
        rows = rows.withColumn("margin", F.col("there") - F.col("back")).withColumn("strength", (F.col("there") + F.col("back")) / 2)
        names += ["margin", "strength"]
    return rows.select(*s.keys, "u", "v", "y", *names), names


def _other(s: Slices) -> DataFrame:
    return s.other if s.other is not None else s.points


def _fitted(points: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, vec_id, vec): points mapped to the other space by the orthogonal map that fits best."""
    m = alignment.procrustes_map(alignment.paired(points, other, keys), keys)
    m = m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", "value"))), lambda e: e["value"]).alias("m"), (F.max("j") + 1).alias("d"))
    return _mapped(points.join(m, list(keys)), keys)


def _mapped(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """vec through the map m of d columns, one after the other."""
    return points.select(*keys, "vec_id", _through("vec").alias("vec"))


def _through(vec: str) -> Column:
    column = lambda j: X.total(F.zip_with(vec, F.slice("m", j * F.col("d") + 1, F.col("d")), lambda x, e: x * e))
    return F.transform(F.sequence(F.lit(0), F.col("d") - 1), column)


def _across_maps(s: Slices, edges: DataFrame, maps: DataFrame) -> DataFrame:
    """_across() of edges as they are once for every map (perm_idx, m, d): the ends' vectors are joined before the fan-out, so
    that no replicate is shuffled."""
    for points, names in ((s.points, ("mu", "mv")), (_other(s), ("ou", "ov"))):
        for end, name in zip(("u", "v"), names, strict=True):
            edges = edges.join(points.select(*s.keys, F.col("vec_id").alias(end), F.col("vec").alias(name)), [*s.keys, end])
    turned = edges.crossJoin(F.broadcast(maps)).withColumns({"mu": _through("mu"), "mv": _through("mv")}).drop("m", "d")
    return turned.withColumn("there", X.cosine("mu", "ov")).withColumn("back", X.cosine("mv", "ou"))


def _across(s: Slices, edges: DataFrame, turned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with the cosines of one end, mapped, with the other end in the second space, both ways."""
    other = _other(s)
    a = edges.join(turned.select(*keys, F.col("vec_id").alias("u"), F.col("vec").alias("mu")), [*keys, "u"]).join(turned.select(*keys, F.col("vec_id").alias("v"), F.col("vec").alias("mv")), [*keys, "v"])
    a = a.join(other.select(*s.keys, F.col("vec_id").alias("u"), F.col("vec").alias("ou")), [*s.keys, "u"]).join(other.select(*s.keys, F.col("vec_id").alias("v"), F.col("vec").alias("ov")), [*s.keys, "v"])
    return a.withColumn("there", X.cosine("mu", "ov")).withColumn("back", X.cosine("mv", "ou"))


def transfer(s: Slices):
    """Cosine of one end in the first space, mapped to the second, with the other end there, both ways."""
    rows = _across(s, s.edges, _fitted(s.points, _other(s), s.keys), s.keys)
    return rows.select(*s.keys, "u", "v", "y", "there", "back"), ["there", "back"]


FEATURES: dict[str, Callable[[Slices], tuple[DataFrame, list[str]]]] = {
    "manifold_distance": manifold, "split_robustness": manifold, "null_sensitivity": manifold, "graph_topology": graph_shape,
    "intrinsic_dimensionality": dimension, "topology_stability": filtration, "persistent_homology": homology,
    "module_structure": modules, "cross_model_alignment": transfer,
}


def _named(schema: Sequence[str]) -> list[str]:
    return [c.split()[0] for c in schema]


def directions(s: Slices):
    """Shortest paths there and back, their lengths over support."""
    return _on_edges(s, geometry.direction_features(s.points, s.edges, s.keys, s.support, s.k), _named(geometry.DIRECTION))


def torsion(s: Slices):
    """Turning and torsion of the paths there and back."""
    return _on_edges(s, geometry.path_torsion(s.points, s.edges, s.keys, s.k, support=s.support), _named(geometry.TORSION))


def fractures(s: Slices):
    """Breaks between the first axes of successive windows of the paths there and back."""
    return _on_edges(s, geometry.path_fractures(s.points, s.edges, s.keys, k=s.k, support=s.support), _named(geometry.FRACTURE))


def _phase(s: Slices, draws: int = 0) -> DataFrame:
    by = [*s.keys, "u", "v"]
    near = geometry.spread_geometry(s.points, s.edges, s.keys, s.support, s.k).select(*by, "base_score")
    rows = geometry.dimension_phase(s.points, s.edges, s.keys, s.k, support=s.support, draws=draws).join(near, by)
    made = descriptors.phase_model(F.col("base_score"), {c: F.col(c) for c in _named(geometry.PHASE)})
    return rows.select(*by, *(["perm_idx"] if draws else []), *[c.alias(f"phase_{n}") for n, c in made.items()])


PHASE_NAMES = [f"phase_{c}" for c in ("base", *_named(geometry.PHASE), "base_hysteresis", "base_slope_gap")]


def phases(s: Slices):
    """Local dimension along the paths there and back, and its products with the baseline score."""
    return _on_edges(s, _phase(s), PHASE_NAMES)


SHEAF_NAMES = [
    "same", "motif", "consistent", "confidence", "confident", "boundary", "unknown", "obstruction", "compatibility", "frequency",
    "obstruction_consistent", "obstruction_confidence", "boundary_same", "score", "score_compatibility", "score_consistent_compatibility",
]


def _backbone(s: Slices) -> DataFrame:
    """Edges with the same community, a support path of two steps from u to v, the margin's sign, mean
    support, whether that is in the slice's upper quarter, and the baseline score."""
    by = [*s.keys, "u", "v"]
    rows, _ = modules(s)
    hop = s.support.select(*s.keys, "source", "target")
    motif = hop.withColumnRenamed("target", "mid").join(hop.withColumnRenamed("source", "mid"), [*s.keys, "mid"]).where("source <> target")
    motif = motif.select(*s.keys, F.col("source").alias("u"), F.col("target").alias("v"), F.lit(1.0).alias("motif")).distinct()
    cut = rows.groupBy(*s.keys).agg(F.percentile("strength", F.lit(0.75)).alias("__cut"))
    score = geometry.spread_geometry(s.points, s.edges, s.keys, s.support, s.k).select(*by, F.col("base_score").alias("score"))
    rows = rows.join(motif, by, "left").na.fill(0.0, ["motif"]).join(cut, list(s.keys)).join(score, by, "left").na.fill(0.0, ["score"])
    return rows.select(*by, "y", "same", "motif", "margin", "score", (F.col("margin") > 0).cast("double").alias("consistent"), F.col("strength").alias("confidence"), (F.col("strength") >= F.col("__cut")).cast("double").alias("confident"))


def _charts(s: Slices) -> DataFrame:
    return geometry.communities(s.points, s.keys, s.k, "labels").select(*s.keys, F.col("id").alias("node"), F.col("community").alias("chart"))


def _sheaf(s: Slices, rows: DataFrame, charts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows of _backbone() with how their margins agree with those of the same pair of charts."""
    by = [*keys, "u", "v"]
    o = support_ops.obstruction(rows.select(*keys, F.col("u").alias("source"), F.col("v").alias("target"), "margin"), charts, keys)
    o = o.select(*keys, F.col("source").alias("u"), F.col("target").alias("v"), "obstruction", "compatibility", "frequency", F.col("boundary").cast("double").alias("boundary"), (F.col("lowest_chart") < 0).cast("double").alias("unknown"))
    c = {n: F.col(n) for n in ("boundary", "unknown", "obstruction", "compatibility", "frequency")}
    made = descriptors.sheaf_model(F.col("score"), F.col("same"), F.col("motif"), F.col("consistent"), F.col("confidence"), F.col("confident"), c)
    made = {n.replace("base", "score", 1): v for n, v in made.items()}
    rest = [x for x in rows.columns if x not in SHEAF_NAMES and x not in by]
    return rows.join(o, by).select(*by, *rest, *[made[n].alias(n) for n in SHEAF_NAMES])


def sheaf(s: Slices):
    """How an edge's margin agrees with its charts', on the backbone of communities, motifs and support."""
    rows = _sheaf(s, _backbone(s), _charts(s), s.keys)
    return rows.select(*s.keys, "u", "v", "y", *SHEAF_NAMES), SHEAF_NAMES


def signed_modules(s: Slices):
    """The backbone of communities, two-step motifs, the margin and its sign, and support."""
    rows = _backbone(s).withColumn("motif_same", F.col("motif") * F.col("same")).withColumn("margin_motif", F.col("margin") * F.col("motif"))
    names = ["same", "motif", "margin", "consistent", "confidence", "confident", "motif_same", "margin_motif"]
    return rows.select(*s.keys, "u", "v", "y", *names), names


#: Screens whose features are not those of their family.
OWN_FEATURES: dict[str, Callable[[Slices], tuple[DataFrame, list[str]]]] = {
    "H121": directions, "H123": signed_modules, "H126": torsion, "H132": fractures, "H134": phases, "H136": sections, "H138": sheaf, "H139": sections, "H142": sections,
}
#: Of those the ones whose columns say by their names how they change when an edge's ends are exchanged.
TURNED = ("H121", "H126", "H132", "H136", "H139", "H142")
#: Null families that turn half of the edges of a bin around.
REVERSED = ("direction_flip_within_path_length_bins", "path_reversal_within_length_bins", "path_order_permutation")
#: Strata in which the reference permutes labels, where they are not distance bins.
LABEL_STRATA = {"H61": ["degree_bin"], "H62": [], "H63": ["degree_bin"], "H118": ["bin", "degree_bin"], "H136": ["bin", "degree_bin"]}


def features_of(screen: Screen) -> Callable[[Slices], tuple[DataFrame, list[str]]]:
    return OWN_FEATURES.get(screen.name, FEATURES[screen.family])


def strata(screen: Screen, kind: str) -> list[str]:
    """The bins that a null family names: of the edge's distance, of its ends' degrees, both, or the source."""
    if kind.startswith("label_permutation"):
        return LABEL_STRATA.get(screen.name, ["bin"])
    if "edge_strata" in kind or kind.endswith("within_strata"):
        return ["bin", "degree_bin"]
    if "tf_identity" in kind or "tf_bin" in kind:
        return ["u"]
    out = ["bin"] if any(w in kind for w in ("distance", "geodesic", "length")) and kind != "distance_permutation" else []
    if "tf_degree" in kind:
        out.append("source_bin")
    elif "degree" in kind and kind != "degree_orientation_null":
        out.append("degree_bin")
    return out or (["bin"] if nulls.MECHANISM.get(kind) in ("stratified", "swap") else [])


def _ends_swapped(screen: Screen, df: DataFrame) -> DataFrame:
    """Features as they are with u and v exchanged; those not named here are the same both ways."""
    if screen.name in TURNED:
        return geometry.swapped(df)
    if screen.name == "H134":
        return df.withColumns({c: -F.col(c) for c in ("phase_slope_gap", "phase_length_gap", "phase_base_slope_gap")})
    if screen.family == "cross_model_alignment":
        return df.withColumns({"there": F.col("back"), "back": F.col("there")})
    return df.withColumn("margin", -F.col("margin")) if "margin" in df.columns else df


def _random_maps(s: Slices, kind: str, replicates: int) -> DataFrame:
    """(perm_idx, m, d): a random orthogonal map a replicate; d * d numbers each."""
    d = s.points.select(F.size("vec")).first()
    d = d[0] if d else 0
    rows = [(r, [float(x) for x in nulls.random_basis(d, kind, r).T.ravel()], d) for r in range(replicates)]
    return s.points.sparkSession.createDataFrame(rows, "perm_idx int, m array<double>, d int")


def _random_axes(s: Slices, rows: DataFrame, kind: str, replicates: int) -> DataFrame:
    """Sectional features with a random direction for the first axis of each node's neighbourhood."""
    by = [*s.keys, "perm_idx"]
    axes = R.replicates(s.points, replicates).select(*by, "vec_id", nulls.axis("vec", "vec_id", kind, "perm_idx").alias("axis"))
    ways = vectors.edge_vectors(s.edges.select(*s.keys, "u", "v"), s.points, s.keys).select(*s.keys, "u", "v", X.unit(F.zip_with("y", "x", lambda a, b: a - b)).alias("way"))
    e = rows.join(ways, [*s.keys, "u", "v"])
    for end in ("u", "v"):
        e = e.join(axes.select(*by, F.col("vec_id").alias(end), F.col("axis").alias(f"axis_{end}")), [*by, end])
    return e.withColumns(geometry.axial_columns(F.col("way"), F.col("axis_u"), F.col("axis_v"), F.col("anisotropy_mean")))


def _layers_exchanged(nodes: DataFrame, columns: Sequence[str], kind: str, keys: Sequence[str]) -> DataFrame:
    """For half of the nodes the values of successive layers (first and second, third and fourth) change
    places; a last layer without a partner stays."""
    if "layer" not in keys:
        raise ValueError(f"{kind} needs slices by layer")
    rest = [k for k in keys if k != "layer"]
    layers = nodes.select(*keys).distinct()
    place = F.row_number().over(Window.partitionBy(*rest).orderBy("layer")) - 1
    out = nodes.join(F.broadcast(layers.withColumn("__pair", F.floor(place / 2))), list(keys))  # a row a slice
    for c in columns:
        out = nulls.exchange(out, c, "node", "layer", kind, "perm_idx", [*rest, "__pair"])
    return out.drop("__pair")


def _layers_reordered(s: Slices, bare: DataFrame, rows: DataFrame, kind: str, names: Sequence[str], replicates: int) -> DataFrame:
    """Each slice's features from the layer that a replicate's random order of the layers puts in its place;
    edges that are not in that layer are left out."""
    rest = [k for k in s.keys if k != "layer"]
    layers = R.replicates(s.points.select("layer").distinct(), replicates)
    by = Window.partitionBy("perm_idx")
    place = layers.withColumn("__at", F.row_number().over(by.orderBy("layer")))
    mover = layers.select("perm_idx", F.col("layer").alias("__from"), F.row_number().over(by.orderBy(R.key("layer", "perm_idx", salt=kind), "layer")).alias("__at"))
    order = place.join(mover, ["perm_idx", "__at"]).drop("__at")
    moved = rows.select(*rest, "u", "v", "perm_idx", F.col("layer").alias("__from"), *names)
    return bare.join(F.broadcast(order), ["perm_idx", "layer"]).join(moved, [*rest, "u", "v", "perm_idx", "__from"]).drop("__from")  # a row a layer and replicate


def _half_turned(screen: Screen, rows: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    """Half of the edges of each distance bin with their ends exchanged; the only edge of a bin stays."""
    lone = F.count(F.lit(1)).over(Window.partitionBy(*by, "bin")) < 2
    hit = (R.number("edge", "perm_idx", salt=kind) % 2 == 0) & ~lone
    marked = rows.withColumn("__hit", hit)
    return marked.where("not __hit").unionByName(_ends_swapped(screen, marked.where("__hit"))).drop("__hit")


def _fanned(s: Slices, replicates: int) -> Slices:
    """The same slices once for every replicate, with perm_idx as one more key."""
    more = lambda df: R.replicates(df, replicates) if df is not None else None
    return Slices(more(s.points), more(s.edges), (*s.keys, "perm_idx"), more(s.support), more(s.other), s.k)


def _rewired(s: Slices, many: Slices, kind: str, how: str) -> DataFrame:
    """(keys, perm_idx, u, v): the neighbour graph rewired for each replicate: matched in its edges' lengths, in
    length bins of all pairs, or keeping degrees alone."""
    e = vectors.knn_edges(_near(s), s.keys).select(*s.keys, "u", "v").join(many.points.select(*many.keys).distinct(), list(s.keys))
    if how == "rewire_matched":
        return models.rewired_to_lengths(e, many.points, many.keys, draw="perm_idx")
    if "length" in kind:
        far = vectors.pairs(s.points, s.keys).select(*s.keys, "u", "v", X.distance("x", "y").alias("__d"))
        strata = far.select(*s.keys, "u", "v", rank_bins("__d", 4, list(s.keys)).alias("stratum"))
        slices = many.points.select(*many.keys).distinct()
        return models.rewired_in_strata(e, strata.join(slices.toDF(*many.keys), list(s.keys)), many.keys, draw="perm_idx")
    return nulls.rewire(e, s.keys, "perm_idx")


def remade(screen: Screen, s: Slices, rows: DataFrame, kind: str, names: Sequence[str], replicates: int) -> DataFrame | None:
    """rows, fanned out by perm_idx, with features made anew after points, layers, nodes or ends moved; None
    for a null family that moves rows of features or labels. Raises for one that has no implementation."""
    how = nulls.MECHANISM.get(kind, "permutation")
    keys, by = list(s.keys), [*s.keys, "perm_idx"]
    bare = rows.drop(*names)
    if screen.family == "cross_model_alignment" and (how in ("basis", "dimensions") or kind in ("anchor_label_shuffle", "signature_destroy_permutation")):
        if how == "basis":
            return _across_maps(s, bare.where("perm_idx = 0").drop("perm_idx"), _random_maps(s, kind, replicates))
        if kind == "anchor_label_shuffle":
            many = R.replicates(_other(s).select(*keys, "vec_id", "vec"), replicates)
            turned = _fitted(R.replicates(s.points, replicates), nulls.permutation(many, ["vec"], "vec_id", kind, "perm_idx", keys), by)
        else:
            turned = R.replicates(_fitted(s.points, _other(s), keys), replicates)
            turned = nulls.dimensions(turned, "vec", kind, "perm_idx") if how == "dimensions" else nulls.permutation(turned, ["vec"], "vec_id", kind, "perm_idx", keys)
        return _across(s, bare, turned, by)
    if kind == "tangent_basis_random_rotation" and features_of(screen) is sections:
        return _random_axes(s, rows, kind, replicates)
    if screen.name in TURNED and kind in REVERSED:
        return _half_turned(screen, rows, kind, by)
    if screen.name == "H134" and kind == "id_profile_permutation_along_path":
        return bare.join(_phase(s, replicates).select(*by, "u", "v", *names), [*by, "u", "v"])
    if screen.name == "H138" and kind == "chart_relabel_preserving_chart_size":
        moved = nulls.permutation(R.replicates(_charts(s), replicates), ["chart"], "node", kind, "perm_idx", keys)
        back = bare.join(_backbone(s).drop("y"), [*keys, "u", "v"])
        return _sheaf(s, back, moved, by)
    if screen.family == "manifold_distance" and features_of(screen) is manifold and how in ("thirds", "rewire", "rewire_matched"):
        if how == "thirds":
            made = geometry.edge_geometry(s.points, s.edges, s.keys, s.support, s.k, draws=replicates)
        else:
            many = _fanned(s, replicates)
            made = geometry.edge_geometry(many.points, many.edges, many.keys, many.support, s.k, graph=_rewired(s, many, kind, how))
        return bare.join(made.select(*by, "u", "v", *names), [*by, "u", "v"], "left").na.fill(0.0, names)
    if screen.family == "topology_stability" and how == "order" and screen.name not in OWN_FEATURES:
        shapes = nulls.order(R.replicates(_trajectories(s), replicates), "trajectory", "edge", kind, "perm_idx", shared=True)
        shapes = topology.trajectory_shape(shapes.drop("edge")).withColumn("onset", F.col("onset").cast("double"))
        return bare.join(shapes.select(*by, "u", "v", *names), [*by, "u", "v"], "left").na.fill(0.0, names)
    if screen.family == "module_structure" and kind == "community_size_preserving_label_shuffle":
        moved = nulls.permutation(R.replicates(_communities(s), replicates), ["community"], "node", kind, "perm_idx", keys)
        return _same(rows.drop("same"), moved, by)
    if screen.family in NODES:
        nodes, columns = NODES[screen.family](s)
        many = R.replicates(nodes.select(*keys, "node", *columns), replicates)
        if how == "exchange":
            return _met(bare, _layers_exchanged(many, columns, kind, keys), columns, by)
        if how == "relabel" or screen.family == "graph_topology" and kind.endswith("shuffle_within_degree_bins"):
            degree = graph.degrees(vectors.knn_edges(_near(s), keys), keys).select(*keys, "node", F.col("degree").alias("__degree"))
            binned = many.join(degree.withColumn("__bin", degree_bins("__degree", 6, keys)), [*keys, "node"])
            return _met(bare, nulls.permutation(binned, columns, "node", kind, "perm_idx", keys, ["__bin"]), columns, by)
        if kind.startswith("endpoint_swap") or how == "swap":
            aimed = nulls.permutation(bare.withColumn("__v", F.col("v")), ["v"], "edge", kind, "perm_idx", keys, strata(screen, kind))
            return _met(aimed, many, columns, by).drop("v").withColumnRenamed("__v", "v")
        if how == "rewire" and screen.family == "graph_topology":
            return _met(bare, _graph_nodes(_rewired(s, _fanned(s, replicates), kind, how), by), columns, by)
    if how == "order" and kind.startswith("layer_order") and "layer" in keys:
        return _layers_reordered(s, bare, rows, kind, names, replicates)
    if how not in ("permutation", "stratified", "sign", "draw", "columns", "swap"):
        raise NotImplementedError(f"{screen.name}: the null family {kind} ({how}) has no implementation for {screen.family}")
    return None


def resampled(screen: Screen, df: DataFrame, kind: str, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """df, fanned out by perm_idx, with rows of features (or labels) resampled as the null family says."""
    how = nulls.MECHANISM.get(kind, "permutation")
    values = list(features)
    if kind.startswith(("label_permutation", "label_shuffle")) or kind.endswith("conditioned_label_permutation"):
        values = ["y"]
    elif screen.family == "module_structure" and "sign_shuffle" in kind and "margin" in features:
        values = [c for c in ("margin", "strength", "consistent", "margin_motif") if c in features]
    within = strata(screen, kind)
    if how == "sign":
        return nulls.sign(df, values, "edge", kind, "perm_idx")
    if how == "draw":
        return nulls.draw(df, values, "edge", kind, "perm_idx", keys, within)
    if how == "columns":
        return nulls.columns(df, values, "edge", kind, "perm_idx", keys)
    if how == "swap" or kind.startswith("endpoint_swap"):
        df = _ends_swapped(screen, df)
    elif how not in ("permutation", "stratified"):
        raise NotImplementedError(f"{kind} ({how}) does not move rows")
    return nulls.permutation(df, values, "edge", kind, "perm_idx", keys, within)


def _binned(s: Slices, rows: DataFrame) -> DataFrame:
    """rows with bins of the distance, of the ends' degrees together and of the source's degree."""
    keys = list(s.keys)
    nodes = graph.degrees(vectors.knn_edges(_near(s), keys), keys)
    rows = graph.with_ends(rows, nodes.withColumnRenamed("degree", "__d"), ["__d"], keys).na.fill(0, ["__d_u", "__d_v"]).withColumn("__d", F.col("__d_u") + F.col("__d_v"))
    rows = rows.withColumn("bin", rank_bins("near", 4, keys)).withColumn("degree_bin", degree_bins("__d", 6, keys)).withColumn("source_bin", degree_bins("__d_u", 6, keys))
    return rows.drop("__d", "__d_u", "__d_v")


def baseline(screen: Screen) -> str:
    """The score that a hypothesis has to add to: minus the distance up to H70, whose own score it is from
    H71 on, and with all geodesics divided by support from H112 on."""
    number = int(screen.name[1:])
    return "near" if number <= 70 else "base_score" if number < 112 else "weighted_score"


def run(screen: Screen | str, slices: Slices, replicates: int | None = None, folds: int = 3, l1: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(results, nulls) of a screen: cross-validated AUC of baseline and features against the baseline alone, and
    the same under each null family. Features are made once, and written to the checkpoint folder before the fan-out; null families that
    move points, layers or nodes make them again from what was moved. All models, of the slices as they are and of every
    family and replicate, are fitted together. Null families that have no implementation here are left out, and named in the
    results' column `refused`."""
    screen = SCREENS[screen] if isinstance(screen, str) else screen
    replicates = REPLICATES.get(screen.name, DEFAULT_REPLICATES) if replicates is None else replicates
    keys = list(slices.keys)
    rows, names = features_of(screen)(slices)
    by = [*keys, "u", "v"]
    far = vectors.edge_vectors(slices.edges.select(*by), slices.points, keys).select(*by, (-X.distance("x", "y")).alias("near"))
    rows = rows.select(*by, "y", *names).join(far, by)
    if (score := baseline(screen)) == "near":
        rows = rows.withColumn("base", F.col("near"))
    else:
        scores = geometry.spread_geometry(slices.points, slices.edges, keys, slices.support, slices.k).select(*by, F.col(score).alias("base"))
        rows = rows.join(scores, by, "left").na.fill(0.0, ["base"])
    rows = rows.withColumn("edge", F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")))
    rows = _binned(slices, R.folds(rows, folds, "edge", "y", "fold", keys))
    rows = graph.written(rows.select(*by, "edge", "y", "fold", "bin", "degree_bin", "source_bin", "base", *names), "screen-rows")
    many = R.replicates(rows, replicates)
    fanned = [*keys, "null_kind", "perm_idx"]
    every = rows.withColumn("null_kind", F.lit("observed")).withColumn("perm_idx", F.lit(-1))
    every = [every.select(*fanned, "y", "fold", "base", *names)]
    refused = []
    for kind in screen.null_kinds or ("feature_shuffle",):
        try:
            moved = remade(screen, slices, many, kind, names, replicates)
            moved = resampled(screen, many, kind, names, keys) if moved is None else moved
        except NotImplementedError:
            refused.append(kind)
            continue
        every.append(moved.withColumn("null_kind", F.lit(kind)).select(*fanned, "y", "fold", "base", *names))
    fitted = fits.cross_validated(every, ["base", *names], "y", fanned, "base", l1, folds=folds)
    fitted = graph.written(fitted, "screen-fits")
    seen = fitted.where("perm_idx < 0").drop("null_kind", "perm_idx").withColumn("refused", F.array(*map(F.lit, refused)).cast("array<string>"))
    return seen, fitted.where("perm_idx >= 0").select(*fanned, F.col("delta").alias("null_value"))


def calibrated(screen: Screen | str, slices: Slices, replicates: int | None = None) -> DataFrame:
    """Results with the pooled null's 95 % point and gap, and the margin to the strictest null family; null where a screen
    has no null family that is implemented."""
    screen = SCREENS[screen] if isinstance(screen, str) else screen
    seen, drawn = run(screen, slices, replicates)
    first = seen.select("refused").first()
    kinds = [k for k in screen.null_kinds or ("feature_shuffle",) if not first or k not in first[0]]
    if not kinds:
        none = [F.lit(None).cast("double").alias(c) for c in ("q95_null", "null_gap", "strict_q95_max", "strict_margin")]
        return seen.select("*", *none, F.lit(None).cast("int").alias("strict_positive"))
    out = audit.pooled_gap(seen, drawn, slices.keys)
    strict = audit.strict_audit(seen.select(*slices.keys, "delta"), drawn, slices.keys, kinds).select(*slices.keys, "strict_q95_max", "strict_margin", "strict_positive")
    return out.join(strict, list(slices.keys))

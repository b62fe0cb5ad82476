"""Null families: how a resampled table is made from an observed one.

Every family is one of a few mechanisms with its own salt, and all of them are deterministic: rows are
ordered, drawn or flipped by MD5 of row, replicate and the family's name. A mechanism takes a table with
a replicate column and returns it with the resampled values in place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import random as R
from ..functions.stats import degree_bins
from ..operators import rewire as rewire_ops

# The names of the null families, by mechanism.
FAMILIES = {k: v.split() for k, v in {
    "draw": """
        anchor_gene_set_shuffle cross_model_pairing_shuffle matched_random_hotspot_set random_background_complex random_feature_subset_control
        random_monotone_warp token_frequency_matched_shuffle
    """,
    "permutation": """
        anchor_label_permutation_preserving_size anchor_label_shuffle anchor_pair_shuffle barcode_component_permutation
        chart_label_permutation_preserving_sizes chart_relabel_preserving_chart_size community_size_preserving_label_shuffle degree_orientation_null
        depth_order_permutation directed_degree_rewire distance_permutation endpoint_swap_within_geodesic_bins estimator_randomization_placebo
        id_profile_permutation_along_path kernel_spectrum_permutation landscape_bin_permutation layer_placebo local_neighborhood_reshuffle
        matched_random_module_weights metric_matched_knn_randomization module_label_permutation module_label_shuffle module_membership_permutation
        module_permutation module_score_permutation module_shuffle module_size_variance_matched_shuffle motif_sign_permutation_within_tf_bin
        neighborhood_assignment_shuffle neighborhood_permutation occupancy_transition_signature_sequence_permutation permutation random_codebook_mapping
        random_correspondence_baseline random_gene_mapping_baseline random_map_null random_map_transfer_control random_module_mapping
        random_teacher_signature_assignment role_label_permutation signature_destroy_permutation state_frequency_matched_token_shuffle symbol_permutation
        token_shuffle_within_layer triad_closure_node_permutation unconditioned_label_permutation
    """,
    "stratified": """
        anchor_permutation_within_length_degree_bins axis_rank_permutation_within_degree_bins bio_weight_shuffle_within_edge_degree_bins
        chart_basis_rotation_shuffle_within_length_bins community_topology_feature_shuffle confidence_feature_shuffle_within_geodesic_bins
        confidence_shuffle_within_geodesic_bins curvature_shuffle_within_degree_bins curvature_shuffle_within_geodesic_bins
        degree_bin_curvature_feature_shuffle degree_bin_edge_feature_rewiring descriptor_shuffle_within_geodesic_bins
        disagreement_bin_permutation_within_edge_strata distance_bin_curvature_feature_shuffle elasticity_feature_shuffle_within_geodesic_bins
        feature_shuffle_within_geodesic_bins go_membership_permutation_within_degree_strata go_semantic_rewiring_within_depth_proxy_strata
        interaction_partner_shuffle interaction_partner_shuffle_within_geodesic_bins label_permutation label_permutation_layer11
        label_shuffle_within_geodesic_bins margin_shuffle_within_degree_bins matched_random_support_within_strata motif_decoy_shuffle_matched_tf_target_degree
        motif_label_shuffle_within_degree_bins ontology_stratum_shuffle_within_geodesic_bins perturbation_profile_shuffle_within_geodesic_bins
        random_strata_weight_placebo section_shuffle_within_degree_strata sectional_row_shuffle split_label_placebo
        stability_descriptor_shuffle_within_geodesic_bins stability_feature_shuffle_within_geodesic_bins
        string_confidence_bin_permutation_within_degree_strata string_degree_conditioned_label_permutation string_weight_shuffle_within_length_degree_bins
        support_score_shuffle_within_degree_bins support_shuffle support_shuffle_within_geodesic_support_bins support_shuffle_within_gxdxcxontology
        tf_identity_preserving_sign_shuffle topology_feature_shuffle_within_degree_bins trajectory_feature_shuffle_within_geodesic_bins
        trrust_sign_shuffle_within_tf_degree_bin
    """,
    "sign": """
        block_sign_bootstrap derivative_sign_randomization direction_flip_within_path_length_bins sign_flip_control sign_shuffle_null
    """,
    "order": """
        cycle_order_shuffle derivative_quantile_order_permutation layer_order_permutation layer_order_shuffle path_order_permutation
        path_reversal_within_length_bins perturbation_schedule_permutation quantile_order_permutation radius_order_permutation scale_order_permutation
    """,
    "rewire": """
        degree_plus_length_bin_swap degree_plus_length_bridge_strata_swap degree_preserving_edge_swap degree_preserving_geodesic_rewire degree_rewire
    """,
    "relabel": """
        degree_preserving_local_rewiring local_complex_degree_bin_node_relabel
    """,
    "swap": """
        distance_matched_endpoint_swap endpoint_swap_degree_bin endpoint_swap_within_distance_bins endpoint_swap_within_distance_degree_bins
    """,
    "dimensions": """
        eigenspectrum_permutation signature_basis_destroy
    """,
    "columns": """
        feature_shuffle
    """,
    "exchange": """
        layer_order_permutation_per_gene layer_order_swap_per_gene
    """,
    "thirds": """
        matched_random_third_nodes
    """,
    "rewire_matched": """
        quantile_constrained_geodesic_rewire
    """,
    "basis": """
        random_linear_map random_map_alignment random_orthogonal_basis random_orthogonal_map_baseline random_subspace_alignment random_subspace_rotation
        random_transport_fixed_marginals tangent_basis_random_rotation
    """,
}.items()}
MECHANISM = {name: kind for kind, names in FAMILIES.items() for name in names}


def _replace(moved: DataFrame, values: Sequence[str], suffix: str) -> DataFrame:
    out = moved.drop(*values)
    for v in values:
        out = out.withColumnRenamed(f"{v}_{suffix}", v)
    return out


def permutation(df: DataFrame, values: Sequence[str], row: str, name: str, replicate: str, keys: Sequence[str] = (), strata: Sequence[str] = ()) -> DataFrame:
    """Values permuted within the slice, and in the strata if there are any; columns of a row stay together."""
    return _replace(R.permuted(df, values, row, name, [*keys, *strata], replicate), values, "perm")


def columns(df: DataFrame, values: Sequence[str], row: str, name: str, replicate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each column permuted on its own."""
    for v in values:
        df = permutation(df, [v], row, f"{name}:{v}", replicate, keys)
    return df


def draw(df: DataFrame, values: Sequence[str], row: str, name: str, replicate: str, keys: Sequence[str] = (), strata: Sequence[str] = ()) -> DataFrame:
    """Values drawn with replacement."""
    return _replace(R.resampled(df, values, row, name, [*keys, *strata], replicate), values, "boot")


def sign(df: DataFrame, values: Sequence[str], row: str, name: str, replicate: str) -> DataFrame:
    """All values of a row times 1 or -1."""
    c = R.coin(row, replicate, salt=name)
    return df.withColumns({v: F.col(v) * c for v in values})


def swap(df: DataFrame, pairs: Sequence[tuple[str, str]], row: str, name: str, replicate: str, negated: Sequence[str] = ()) -> DataFrame:
    """For half of the rows both columns of each pair change places and the negated ones their sign."""
    hit = R.number(row, replicate, salt=name) % 2 == 0
    out = {}
    for a, b in pairs:
        out[a], out[b] = F.when(hit, F.col(b)).otherwise(F.col(a)), F.when(hit, F.col(a)).otherwise(F.col(b))
    return df.withColumns(out | {c: F.when(hit, -F.col(c)).otherwise(F.col(c)) for c in negated})


def exchange(df: DataFrame, value: str, node: str, layer: str, name: str, replicate: str, keys: Sequence[str] = ()) -> DataFrame:
    """For half of the nodes the values of the slice's two layers change places."""
    w = Window.partitionBy(*keys, node, replicate).orderBy(layer)
    other = F.coalesce(F.lag(value).over(w), F.lead(value).over(w))
    hit = R.number(node, replicate, salt=name) % 2 == 0
    return df.withColumn("__o", other).withColumn(value, F.when(hit, F.coalesce("__o", value)).otherwise(F.col(value))).drop("__o")


def order(df: DataFrame, array: str, row: str, name: str, replicate: str, shared: bool = False) -> DataFrame:
    """An array's steps in another order: one order for all rows of a replicate if shared, else one a row."""
    parts = [replicate] if shared else [row, replicate]
    tag = F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.lit(name))
    keyed = F.transform(array, lambda x, i: F.struct(F.md5(F.concat_ws("|", tag, i.cast("string"))).alias("k"), i.alias("i"), x.alias("x")))
    return df.withColumn(array, F.transform(F.array_sort(keyed), lambda s: s["x"]))


def dimensions(df: DataFrame, vec: str, name: str, replicate: str) -> DataFrame:
    """A vector's dimensions permuted, the same way for all rows of a replicate, and each times 1 or -1."""
    tag = F.concat_ws("|", F.col(replicate).cast("string"), F.lit(name))
    flip = lambda i: F.when(F.conv(F.substring(F.md5(F.concat_ws("|", tag, F.lit("s"), i.cast("string"))), 1, 8), 16, 10).cast("long") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return order(df.withColumn(vec, F.transform(vec, lambda x, i: x * flip(i))), vec, replicate, name, replicate, shared=True)


def relabel(df: DataFrame, node: str, degree: str, name: str, replicate: str, keys: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """(keys, replicate, node, node_perm): nodes exchanged inside their degree bins."""
    binned = df.withColumn("__bin", degree_bins(degree, bins, [*keys, replicate]))
    return R.permuted(binned.withColumn("__n", F.col(node)), ["__n"], node, name, [*keys, "__bin"], replicate).select(*keys, replicate, node, F.col("__n_perm").alias(f"{node}_perm"))


def rewire(edges: DataFrame, keys: Sequence[str], replicate: str) -> DataFrame:
    """Undirected edges, fanned out by replicate, after swaps that keep every degree."""
    return rewire_ops.rewired(edges, [*keys, replicate])


def axis(vec: str, node: str, name: str, replicate: str) -> Column:
    """A random direction for each node and replicate, with as many dimensions as vec: normal values from MD5."""
    u = lambda i, part: R.uniform(node, replicate, i, salt=f"{name}:{part}")
    normal = lambda i: F.sqrt(-2 * F.ln(1 - u(i, "r"))) * F.cos(2 * math.pi * u(i, "a"))
    return X.unit(F.transform(vec, lambda x, i: normal(i)))


def random_basis(dim: int, name: str, replicate: int):
    """An orthogonal matrix with positive diagonal of R, from a generator seeded by name and replicate."""
    rng = np.random.default_rng(zlib.crc32(f"{name}|{replicate}".encode()))
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def basis(df: DataFrame, vec: str, dim: int, name: str, replicate: int) -> DataFrame:
    """Vectors turned by a random orthogonal map; dim * dim literals in the plan."""
    m = random_basis(dim, name, replicate)
    rows = [F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in m[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for j in range(dim)]
    return df.withColumn(vec, F.array(*rows))

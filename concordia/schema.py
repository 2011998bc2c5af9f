"""Output rows of the scoring plans."""

from __future__ import annotations

METRICS = ("garp", "ccei", "mpi", "harp", "hm", "utility", "vei", "vei_exact", "network")
TOLERANCE = 1e-10

#: Columns of a budget score: name, type, whether NULL unless the metric is asked for.
BUDGET = (
    ("is_garp", "boolean"), ("n_violations", "int"), ("ccei", "double"), ("mpi", "double"), ("is_harp", "boolean"), ("hm_consistent", "int"), ("hm_total", "int"),
    ("utility_success", "boolean"), ("vei_mean", "double"), ("vei_min", "double"), ("vei_exact_mean", "double"), ("vei_exact_min", "double"), ("max_scc", "int"),
    ("compute_time_us", "bigint"), ("vei_std", "double"), ("vei_q25", "double"), ("vei_q75", "double"), ("vei_exact_std", "double"), ("vei_exact_q25", "double"),
    ("vei_exact_q75", "double"), ("n_scc", "int"), ("harp_severity", "double"), ("scc_mean_size", "double"), ("r_density", "double"), ("r_out_degree_std", "double"),
    ("degree_gini", "double"), ("ew_mean", "double"), ("ew_std", "double"), ("ew_skew", "double"),
    ("is_hm_exact", "boolean"), ("is_vei_exact", "boolean"),
)
MENU = (
    ("is_sarp", "boolean"), ("is_warp", "boolean"), ("is_warp_la", "boolean"), ("n_sarp_violations", "int"), ("n_warp_violations", "int"), ("hm_consistent", "int"),
    ("hm_total", "int"), ("max_scc", "int"), ("n_scc", "int"), ("r_density", "double"), ("pref_entropy", "double"), ("choice_diversity", "double"), ("compute_time_us", "bigint"),
)
STOCHASTIC = (("is_consistent", "boolean"), ("is_regular", "boolean"), ("distance", "double"), ("n_orderings", "int"), ("n_violations", "int"), ("n_iterations", "int"), ("is_exact", "boolean"), ("compute_time_us", "bigint"))

OBSERVATIONS = "array<struct<t:string,p:array<double>,q:array<double>>>"


def ddl(columns: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)

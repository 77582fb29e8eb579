"""Families as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Family:
    name: str
    description: str
    encode: Callable
    family_energy: Callable | None = None
    stats: Callable | None = None


_FAMILIES: dict[str, Family] = {}


def register_family(name: str, encode: Callable, family_energy: Callable | None = None,
                    stats: Callable | None = None, description: str = "") -> Family:
    family = Family(name, description, encode, family_energy, stats)
    _FAMILIES[name] = family
    return family


def family(name: str) -> Family:
    try:
        return _FAMILIES[name]
    except KeyError:
        raise ValueError(
            f"unknown family {name!r}; available: {', '.join(sorted(_FAMILIES))}") from None


def list_families(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.description, f.family_energy is not None, f.stats is not None)
            for f in sorted(_FAMILIES.values(), key=lambda f: f.name)]
    return spark.createDataFrame(
        rows, "name string, description string, has_energy boolean, has_stats boolean")


def _register_built_in() -> None:
    from bitloom.operators import encoders as e
    from bitloom.operators import energy as v
    from bitloom.operators import families as d

    for name, text, encode, energy, stats in [
        ("max_cut", "heaviest cut of a weighted graph", e.encode_max_cut, v.cut_energy, d.cut_stats),
        ("independent_set", "valuable vertices without an edge between them",
         e.encode_independent_set, v.independent_set_energy, d.independent_set_stats),
        ("maximum_clique", "valuable vertices that are all adjacent", e.encode_clique,
         v.clique_energy, d.clique_stats),
        ("graph_coloring", "one colour per vertex, different along edges", e.encode_coloring,
         v.coloring_energy, d.coloring_stats),
        ("number_partitioning", "two groups of equal sum", e.encode_partition,
         v.partition_energy, d.partition_stats),
        ("quadratic_knapsack", "valuable items and pairs within a capacity", e.encode_knapsack,
         v.knapsack_energy, d.knapsack_stats),
        ("set_packing", "valuable sets without a common element", e.encode_set_packing,
         v.packing_energy, d.packing_stats),
        ("max_sat", "least weight of unsatisfied clauses", e.encode_max_sat, v.sat3_energy,
         d.clause_stats),
        ("spin_glass", "least energy of coupled spins", e.encode_spin_glass, v.ising_energy,
         d.spin_stats),
        ("random_qubo", "coefficients given directly", e.encode_direct, None, d.direct_stats),
    ]:
        register_family(name, encode, energy, stats, text)


_register_built_in()

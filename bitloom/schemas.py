"""Declared schemas; every table is keyed by ``(batch, instance_id)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = ["batch", "instance_id"]

_K = [("batch", T.StringType()), ("instance_id", T.StringType())]


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in [*_K, *fields]])


L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

INSTANCES = _schema(
    ("problem_type", S), ("problem_name", S), ("seed", L), ("num_variables", L), ("offset", D),
    ("parameters", T.MapType(S, S)), ("schema_version", T.IntegerType()),
)
LINEAR = _schema(("i", L), ("v", D))
QUADRATIC = _schema(("i", L), ("j", L), ("v", D))
VARIABLES = _schema(("i", L), ("name", S))
EDGES = _schema(("u", L), ("v", L), ("w", D))
ISSUES = _schema(("severity", S), ("code", S), ("message", S))
CHARACTERISTICS = _schema(("key", S), ("value", D), ("text", S))

SOLUTION = T.StructType([
    T.StructField("sample", T.ArrayType(T.ByteType())), T.StructField("energy", D)])
VERIFICATION = T.StructType([
    T.StructField("binary_sample", B), T.StructField("reported_energy", D),
    T.StructField("recomputed_energy", D), T.StructField("absolute_energy_difference", D),
    T.StructField("passed", B)])
SNAPSHOT = T.StructType([
    T.StructField("index", L), T.StructField("progress_fraction", D),
    T.StructField("target", T.StructType([
        T.StructField("unit", S), T.StructField("value", D), T.StructField("total", D)])),
    T.StructField("elapsed_seconds", D), T.StructField("solution", SOLUTION),
    T.StructField("verification", VERIFICATION),
    T.StructField("solver_metrics", T.MapType(S, S))])
RESULT = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("run_id", S),
    T.StructField("problem", T.StructType([
        T.StructField("instance_id", S), T.StructField("problem_type", S),
        T.StructField("num_variables", L), T.StructField("quadratic_terms", L),
        T.StructField("source", S)])),
    T.StructField("solver", T.StructType([
        T.StructField("type", S), T.StructField("instance_name", S), T.StructField("name", S),
        T.StructField("version", S), T.StructField("parameters", T.MapType(S, S)),
        T.StructField("device", S)])),
    T.StructField("status", S), T.StructField("solution", SOLUTION),
    T.StructField("timing", T.StructType([T.StructField("wall_seconds", D)])),
    T.StructField("verification", VERIFICATION),
    T.StructField("snapshots", T.ArrayType(SNAPSHOT)),
    T.StructField("solver_metrics", T.MapType(S, S))])
PROBLEM_JSON = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("instance_id", S),
    T.StructField("problem_type", S), T.StructField("problem_name", S), T.StructField("seed", L),
    T.StructField("parameters", T.MapType(S, S)),
    T.StructField("qubo", T.StructType([
        T.StructField("num_variables", L), T.StructField("offset", D),
        T.StructField("variable_names", T.ArrayType(S)),
        T.StructField("linear", T.ArrayType(T.ArrayType(D))),
        T.StructField("quadratic", T.ArrayType(T.ArrayType(D)))])),
    T.StructField("validation", T.StructType([T.StructField("status", S)]))])

RESULT_MANIFEST_COLUMNS = [
    "run_id", "instance_id", "problem_type", "num_variables", "quadratic_terms", "solver_type",
    "solver_version", "device", "status", "energy", "reported_energy", "recomputed_energy",
    "absolute_energy_difference", "energy_check_passed", "wall_seconds", "snapshots", "file"]
PROBLEM_MANIFEST_COLUMNS = [
    "instance_id", "problem_type", "problem_name", "seed", "file", "num_variables", "linear_terms",
    "quadratic_terms", "validation_status", "warning_codes", "error_codes"]


@dataclass(frozen=True)
class Batch:
    """The four term tables of many instances."""

    instances: DataFrame
    linear: DataFrame
    quadratic: DataFrame
    variables: DataFrame | None = None

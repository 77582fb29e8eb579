"""Problem JSON, result JSON, manifests and folder discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.schemas import KEY, PROBLEM_JSON, RESULT, Batch


def path_parts(path: Column) -> dict[str, Column]:
    """Batch, folder kind, sub-folder and stem of ``.../<batch>/<qubos|results...>/<sub>/<stem>.<ext>``."""
    pattern = r"([^/]+)/(qubos|results(?:_\d+|\(\d+\))?)/(?:(.*)/)?([^/]+)\.[^./]+$"
    clean = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    names = ["batch", "folder", "path_dir", "stem"]
    return {n: F.nullif(F.regexp_extract(clean, pattern, g), F.lit("")) for g, n in
            enumerate(names, 1)}


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("qubo", "json")):
    """Problem files below ``root``: (path, batch, path_dir, stem) and misplaced ones.

    Only file names are read. A file must lie in a ``qubos`` folder below a batch folder.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
        .select("path").distinct())
    base = F.lit(root.rstrip("/").split(":")[-1])
    below = F.element_at(F.split("path", base, 2), -1)
    parts = path_parts(below)
    found = files.select("path", *[c.alias(n) for n, c in parts.items()])
    ok = (F.col("folder") == "qubos") & F.col("batch").isNotNull()
    good = found.where(ok).select("path", "batch", F.coalesce("path_dir", F.lit("")).alias(
        "path_dir"), "stem")
    bad = found.where(~F.coalesce(ok, F.lit(False))).select(
        "path", F.lit("not_in_a_qubos_folder").alias("code"))
    return good, bad


def read_problem_json(spark: SparkSession, path: str) -> tuple[Batch, DataFrame]:
    """Import problem files: (batch, error rows path, code).

    A file is one JSON document. Files that lack a required part, have version 2 or later
    without a validation record, or hold a term that is not its indices and a number, become error
    rows; the other files are imported all the same.
    """
    def malformed(terms: str, indices: int) -> Column:
        def bad(term: Column) -> Column:
            parts = [F.try_element_at(term, F.lit(k + 1)) for k in range(indices + 1)]
            wrong = F.size(term) != indices + 1
            for k, part in enumerate(parts):
                wrong = wrong | part.isNull() | ((part != F.floor(part)) if k < indices else F.lit(False))
            return F.coalesce(wrong, F.lit(True))

        return F.exists(terms, bad)

    raw = (
        spark.read.schema(PROBLEM_JSON).option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
        .withColumn("path", F.col("_metadata.file_path")))
    code = (
        F.when(F.col("schema_version").isNull() | F.col("problem_type").isNull()
               | F.col("instance_id").isNull(), "missing_fields")
        .when(F.col("qubo").isNull(), "missing_qubo")
        .when(F.col("qubo.num_variables").isNull() | F.col("qubo.linear").isNull()
              | F.col("qubo.quadratic").isNull() | F.col("qubo.offset").isNull(),
              "incomplete_qubo")
        .when((F.col("schema_version") >= 2) & F.col("validation").isNull(),
              "missing_validation")
        .when(malformed("qubo.linear", 1), "malformed_linear_term")
        .when(malformed("qubo.quadratic", 2), "malformed_quadratic_term"))
    graded = raw.withColumn("code", code).withColumn(
        "batch", F.coalesce(path_parts(F.col("path"))["batch"], F.lit("imported")))
    good = graded.where("code IS NULL")
    instances = good.select(
        *KEY, "problem_type", "problem_name", "seed", F.col("qubo.num_variables"),
        F.col("qubo.offset"), "parameters", "schema_version")
    linear = good.select(*KEY, F.explode("qubo.linear").alias("t")).select(
        *KEY, F.col("t")[0].cast("bigint").alias("i"), F.col("t")[1].alias("v"))
    quadratic = good.select(*KEY, F.explode("qubo.quadratic").alias("t")).select(
        *KEY, F.col("t")[0].cast("bigint").alias("i"), F.col("t")[1].cast("bigint").alias("j"),
        F.col("t")[2].alias("v"))
    variables = good.select(*KEY, F.posexplode("qubo.variable_names").alias("i", "name")).select(
        *KEY, F.col("i").cast("bigint").alias("i"), "name")
    return (Batch(instances, linear, quadratic, variables),
            graded.where("code IS NOT NULL").select("path", "code"))


# Manifest columns that hold numbers.
NUMBER_COLUMNS = [
    "num_variables", "linear_terms", "quadratic_terms", "energy", "reported_energy",
    "recomputed_energy", "absolute_energy_difference", "wall_seconds", "snapshots"]


def read_manifest(spark: SparkSession, paths: str | list[str],
                  numbers: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Manifest CSVs as text, listed numbers cast (NULL when they are none).

    Every path (or glob of equal headers) is read on its own, because manifests carry different
    ``parameter.*`` and ``stat.*`` columns; the union fills the gaps with NULL. Without
    ``multi_line`` (no line breaks inside quotes) one large file is read by many tasks.
    """
    frames = [
        spark.read.option("header", "true").option("quote", '"').option("escape", '"')
        .option("multiLine", str(multi_line).lower()).csv(p).withColumn("_path", F.col("_metadata.file_path"))
        for p in ([paths] if isinstance(paths, str) else paths)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    text = F.col("_path")
    rows = rows.withColumn("batch", F.regexp_extract(text, r"([^/]+)/[^/]+/[^/]+$", 1)).withColumn(
        "folder", F.url_decode(F.regexp_extract(text, r"([^/]+)/[^/]+$", 1))).drop("_path")
    for name in NUMBER_COLUMNS if numbers is None else numbers:
        if name in rows.columns:
            rows = rows.withColumn(name, F.expr(f"try_cast(`{name}` AS double)"))
    return rows


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Result records with batch, result_set and file derived from their path.

    ``multi_line`` reads one indented document per file; otherwise one record per line, with
    ``batch=``/``result_set=`` folders as ``write_results`` lays them out.
    """
    if not multi_line:
        schema = T.StructType([
            *RESULT.fields, T.StructField("instance_id", T.StringType()),
            T.StructField("batch", T.StringType()), T.StructField("result_set", T.StringType())])
        return spark.read.schema(schema).json(path)
    raw = (
        spark.read.schema(RESULT).option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path))
    parts = path_parts(F.col("_metadata.file_path"))
    return raw.select(
        parts["batch"].alias("batch"), parts["folder"].alias("result_set"),
        F.col("problem.instance_id").alias("instance_id"),
        F.concat_ws("/", parts["path_dir"], F.concat(parts["stem"], F.lit(".json"))).alias("file"),
        *[f.name for f in RESULT.fields])

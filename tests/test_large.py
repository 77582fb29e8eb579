"""Plans and results that only tables beyond the given ones showed to be wrong."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from bitloom.operators.generate import random_sets
from bitloom.operators.ranges import spread_range
from catalog import load


def _node(df, name: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(name)


@pytest.fixture
def orders(spark, tmp_path):
    """Orders of two customers; one ships in the order's month only, so that its graph has no edge."""
    day = datetime.date
    spark.createDataFrame([(1, 1, day(1995, 1, 5), 10.0, "1-URGENT"), (2, 2, day(1995, 1, 5), 20.0, "2-HIGH")],
                          "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 7, 3, 5.0, "A", "F", day(1995, 3, 1)), (2, 1, 8, 4, 6.0, "N", "O", day(1995, 1, 9))],
                          "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["d12_independent_set_stats", "d13_clique_stats", "d22_warnings"])
def test_graphs_without_edges(spark, orders, name):
    queries, oracles = load()
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS FROM '{orders}/{table}.parquet/*.parquet'")
    found = queries[name](spark, orders)
    cursor = con.execute(oracles[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_nothing_is_broadcast_on_a_guess(spark):
    """The guess of a table's size leaves out the rows that explode makes of it."""
    grid = spark.range(3).select(F.lit("b").alias("batch"), F.col("id").cast("string").alias("instance_id"), F.col("id").alias("seed"),
                                 F.lit(1000).alias("sets"), F.lit(1000).alias("universe"), F.lit(0.5).alias("p"))
    from bitloom.session import configure
    configure(spark)
    assert _node(random_sets(grid, "sets", "universe", "p"), "BroadcastExchange") == 0


def test_ranges_are_spread(spark):
    """Blocks of a few bytes, which turn into many rows, stay on many tasks."""
    rows = spread_range(spark.range(64).withColumn("n", F.lit(10)), "n", "i")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_probes_are_not_broadcast(spark):
    """131 samples of a few huge models: the guess sees a row per model."""
    from bitloom.operators import encoders as E
    from bitloom.operators import energy as V
    from bitloom.session import configure
    configure(spark)
    edges = spark.range(2).selectExpr("'b' AS batch", "'1' AS instance_id", "id AS u", "id + 1 AS v", "2.0D AS w")
    sizes = spark.range(1).selectExpr("'b' AS batch", "'1' AS instance_id", "3L AS num_variables", "3L AS num_vertices")
    samples = V.probe_samples(E.encode_max_cut(edges, sizes).instances)
    assert _node(V.cut_energy(edges, samples), "BroadcastExchange") == 0


def test_a_union_is_not_taken_as_partitioned(spark):
    """Children planned anew at run time need not stay partitioned alike, so what groups a union shuffles it."""
    from bitloom.session import configure
    configure(spark)
    key = F.col("id") % 3
    counts = [spark.range(n).groupBy(key.alias("k")).count() for n in (4, 5)]
    df = counts[0].union(counts[1]).groupBy("k").agg(F.sum("count"))
    assert _node(df, "Exchange hashpartitioning") == 3
    assert sorted(r[1] for r in df.collect()) == [2, 3, 4]


def test_stored_families_are_checked_where_some_do_not_occur(spark, tmp_path):
    """Ten suppliers stand for one family, so nothing was stored for the others."""
    spark.range(90, 100).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    queries, oracles = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS FROM '{tmp_path}/supplier.parquet/*.parquet'")
    found = queries["d24_revalidate_families"](spark, str(tmp_path))
    cursor = con.execute(oracles["d24_revalidate_families"])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_probes_are_computed_and_not_shuffled(spark):
    """131 samples of every variable of a huge model are more than its terms; a term finds out about them by itself."""
    from bitloom.operators import encoders as E
    from bitloom.operators import energy as V
    from bitloom.session import configure
    configure(spark)
    edges = spark.range(40).selectExpr("'b' AS batch", "CAST(id % 2 AS STRING) AS instance_id", "id AS u", "id + 1 + id % 5 AS v",
                                       "CAST(id AS DOUBLE) AS w")
    vertices = spark.range(60).selectExpr("'b' AS batch", "CAST(id % 2 AS STRING) AS instance_id", "id AS u", "id % 7 AS value")
    sizes = spark.range(3).selectExpr("'b' AS batch", "CAST(id AS STRING) AS instance_id", "44L - 22 * id AS num_variables", "id * 5 AS seed")
    price = sizes.selectExpr("batch", "instance_id", "3.0D AS penalty")
    batch = E.encode_max_cut(edges, sizes)
    rule, rows = V.Probes(sizes), V.probe_samples(sizes)
    for energy in (lambda s: V.cut_energy(edges, s), lambda s: V.energy(batch, s), lambda s: V.independent_set_energy(vertices, edges, price, s),
                   lambda s: V.coloring_energy(vertices, edges, s, 2)):
        found, expected = (sorted(map(tuple, energy(s).select("instance_id", "sample_id", "energy").collect())) for s in (rule, rows))
        assert found == expected and len(found) == 2 * 131
    assert _node(V.cut_energy(edges, rule), "Exchange hashpartitioning") == 1


def test_written_tables_leave_no_shuffle_files(spark):
    """Disk holds the shuffles of one step, not of all steps before it."""
    import time

    from bitloom.session import cut

    def files() -> set[str]:
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_")}

    before = files()
    assert cut(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()).count() == 3
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before


def test_clauses_in_slices(spark, monkeypatch):
    """Slices of clauses add up to the energies of all of them."""
    from bitloom import session
    from bitloom.operators import encoders as E
    from bitloom.operators import energy as V
    literals = spark.range(30).selectExpr("'b' AS batch", "'1' AS instance_id", "id DIV 3 AS clause_id", "id % 3 AS pos",
                                          "(id * 7) % 11 AS variable", "id % 2 = 0 AS negated")
    clauses = spark.range(10).selectExpr("'b' AS batch", "'1' AS instance_id", "id AS clause_id", "id % 4 + 1 AS weight")
    sizes = spark.range(1).selectExpr("'b' AS batch", "'1' AS instance_id", "11L AS num_variables")
    batch, ancillas = E.encode_max_sat(literals, clauses, 3, sizes=sizes)
    samples = V.probe_samples(batch.instances)
    made = []
    monkeypatch.setattr(session, "cut", lambda df, old=session.cut: made.append(df) or old(df))

    def energies(df):
        return {r.sample_id: r.energy for r in df.collect()}

    whole = energies(V.sat3_energy(literals, clauses, ancillas, samples))
    monkeypatch.setattr(session, "SLICE_ROWS", 4)
    sliced = energies(V.sat3_energy(literals, clauses, ancillas, samples))
    assert len(made) == 3 and sliced == whole == energies(V.energy(batch, samples)) and len(whole) == 131


def test_packings_in_slices(spark, monkeypatch):
    """Statistics, overlaps and issues of slices of instances are those of all instances."""
    from bitloom import session
    from bitloom.operators import encoders as E
    from bitloom.operators import families as D
    members = spark.range(120).selectExpr("'b' AS batch", "CAST(id % 9 AS STRING) AS instance_id", "(id * 5) % 7 AS set_id", "(id * id) % 13 AS element")
    key = members.select("batch", "instance_id").distinct()
    values = members.select("batch", "instance_id", "set_id", (F.col("set_id") - 1).alias("value")).distinct()
    params = key.select("*", F.lit(7).alias("num_sets"), F.lit(9).alias("universe_size"))
    price = key.withColumn("penalty", F.lit(5.0))

    def results():
        stored = E.set_overlaps(members).where("a % 5 <> 0")
        return [sorted(map(str, df.select(*sorted(f"`{c}`" for c in df.columns)).collect())) for df in (
            E.set_overlaps(members), D.packing_issues(members, values, stored, params), D.packing_stats(members, values, params, price))]

    whole = results()
    made = []
    monkeypatch.setattr(session, "cut", lambda df, old=session.cut: made.append(df) or old(df))
    monkeypatch.setattr(session, "SLICE_ROWS", 30)
    assert results() == whole and all(whole) and len(made) == 4 * 5

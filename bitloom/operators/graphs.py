"""Components, signed spanning forests, exact colourability and reachable sums."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.terms import union
from bitloom.schemas import KEY
from bitloom.session import cut

MAX_ROUNDS = 100

COLORING_LIMIT = 16  # vertices whose colours fit one word
COMPONENT_EDGES = 200_000  # edges of a component that one task may colour
FRONTIER_STATES = 50_000  # partial colourings kept at a time
SUM_BITS = 1 << 28  # half sums that fit the bit set of one instance (32 MB)
HALVES_LIMIT = 40  # numbers whose sums are listed by halves, a million rows each


def component_labels(edges: DataFrame) -> DataFrame:
    """Label of every vertex that has an edge (its component's lowest vertex): key, u, label."""
    roots = _forest_roots(cut(edges.where("u <> v").select(
        *KEY, F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), F.lit(1).alias("s"))))
    lowest = roots.groupBy(*KEY, "p").agg(F.min("c").alias("label"))
    return roots.select(*KEY, F.col("c").alias("u"), "p").join(lowest, [*KEY, "p"]).select(*KEY, "u", "label")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Label of every vertex, isolated ones included: key, u, label."""
    labels = component_labels(edges)
    return vertices.select(*KEY, "u").join(labels, [*KEY, "u"], "left").select(
        *KEY, "u", F.coalesce("label", "u").alias("label"))


def component_counts(labels: DataFrame) -> DataFrame:
    """Components per instance; a component is counted at the vertex that names it."""
    return labels.groupBy(*KEY).agg(F.count_if(F.col("u") == F.col("label")).alias("components"))


def spanning_gauge(couplings: DataFrame) -> DataFrame:
    """Component and gauge sign of every touched spin, from the minimum spanning forest.

    An edge wants ``s_i s_j = -1`` when its coupling is positive and ``+1`` otherwise. The forest is
    the unique one that takes edges in index order. Returns key, u, label, sign with all forest
    edges satisfied.
    """
    wanted = cut(couplings.select(
        *KEY, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        F.when(F.col("coupling") > 0, -1).otherwise(1).alias("s")))
    roots = _forest_roots(wanted.where("i <> j")).select(
        *KEY, F.col("c").alias("u"), F.col("p").alias("label"), F.col("s").alias("sign"))
    alone = wanted.where("i = j").select(*KEY, F.col("i").alias("u")).distinct().join(
        roots, [*KEY, "u"], "left_anti")
    return union(roots, alone.select(*KEY, "u", F.col("u").alias("label"), F.lit(1).alias("sign")))


def _forest_roots(edges: DataFrame) -> DataFrame:
    """Root of every vertex's tree and the sign of the path to it: key, c, p, s, from edges i < j with a sign s, a written table.

    Components choose their lowest outgoing edge (by ``(i, j)``) and merge along it, which at least
    halves their number. Then a component is a vertex, of its edges to another one the lowest goes
    on, so a round's work shrinks with the components; the rounds are joined from the last back.
    """
    open_edges = edges.select(*KEY, F.col("i").alias("ci"), F.col("j").alias("cj"), "i", "j", "s")
    levels: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if levels and open_edges.isEmpty():
            roots = levels.pop()
            while levels:
                above = roots.select(*KEY, F.col("c").alias("p"), F.col("p").alias("pp"), F.col("s").alias("ps"))
                roots = cut(levels.pop().join(above, [*KEY, "p"], "left").select(
                    *KEY, "c", F.coalesce("pp", "p").alias("p"), (F.col("s") * F.coalesce("ps", F.lit(1))).alias("s")))
            return roots
        both = union(
            open_edges.select(*KEY, F.col("ci").alias("c"), F.col("cj").alias("other"), "i", "j", "s"),
            open_edges.select(*KEY, F.col("cj").alias("c"), F.col("ci").alias("other"), "i", "j", "s"))
        if levels:
            hooks = both.groupBy(*KEY, "c").agg(F.min(F.struct("i", "j", "other", "s")).alias("e")).select(
                *KEY, "c", "e.other", "e.s")
        else:  # the lowest edge of a single vertex is the one to its lowest neighbour
            least = both.groupBy(*KEY, "c").agg(F.min("other").alias("other"), F.min(
                F.when(F.col("s") < 0, F.col("other"))).alias("unlike"))
            hooks = least.select(*KEY, "c", "other", F.when(F.col("unlike") == F.col("other"), -1).otherwise(1).alias("s"))
        hooks = cut(hooks)
        mate = hooks.select(*KEY, F.col("c").alias("other"), F.col("other").alias("back"))
        # two components that chose the same edge: the lower one becomes the root
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("other"))
        parents = _jump(cut(hooks.join(mate, [*KEY, "other"]).select(
            *KEY, "c", F.when(root, F.col("c")).otherwise(F.col("other")).alias("p"),
            F.when(root, 1).otherwise(F.col("s")).alias("s"))))
        left = parents.select(*KEY, F.col("c").alias("ci"), F.col("p").alias("pi"), F.col("s").alias("si"))
        right = parents.select(*KEY, F.col("c").alias("cj"), F.col("p").alias("pj"), F.col("s").alias("sj"))
        open_edges = cut(open_edges.join(left, [*KEY, "ci"]).join(right, [*KEY, "cj"]).where("pi <> pj").groupBy(
            *KEY, F.least("pi", "pj").alias("ci"), F.greatest("pi", "pj").alias("cj")).agg(
            F.min(F.struct("i", "j", (F.col("si") * F.col("s") * F.col("sj")).alias("s"))).alias("e")).select(
            *KEY, "ci", "cj", "e.*"))
        levels.append(parents)
    raise RuntimeError(f"forest did not settle within {MAX_ROUNDS} rounds")


def _jump(parents: DataFrame) -> DataFrame:
    """Double every parent pointer until all point at a root, multiplying signs on the way.

    Pointers at a root are left out of later rounds.
    """
    moving, settled = parents, []
    for _ in range(MAX_ROUNDS):
        above = union(moving, *settled).select(
            *KEY, F.col("c").alias("p"), F.col("p").alias("pp"), F.col("s").alias("ps"))
        nxt = cut(moving.join(above, [*KEY, "p"]).select(
            *KEY, "c", F.col("pp").alias("p"),
            F.when(F.col("p") == F.col("c"), F.col("s")).otherwise(F.col("s") * F.col("ps"))
            .alias("s"), (F.col("pp") != F.col("p")).alias("moved")))
        settled.append(nxt.where("NOT moved").drop("moved"))
        moving = nxt.where("moved").drop("moved")
        if moving.isEmpty():
            return union(*settled)
    raise RuntimeError(f"pointers did not settle within {MAX_ROUNDS} rounds")


def frustration(couplings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fundamental cycles and frustrated ones: key, cycle_basis_size, ..._count, ..._fraction.

    The basis belongs to the forest of ``spanning_gauge``; its size ``m - n + c`` and whether any
    cycle is frustrated do not depend on the forest. ``sizes``: key, num_vertices.
    """
    gauge = spanning_gauge(couplings)
    simple = couplings.select(*KEY, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
                              "coupling")
    ends = simple.join(
        gauge.select(*KEY, F.col("u").alias("i"), F.col("sign").alias("si")), [*KEY, "i"]).join(
        gauge.select(*KEY, F.col("u").alias("j"), F.col("sign").alias("sj")), [*KEY, "j"])
    product = F.col("si") * F.col("sj") * F.when(F.col("coupling") > 0, -1).otherwise(1)
    edges = ends.groupBy(*KEY).agg(F.count("*").alias("m"), F.count_if(product < 0).alias("bad"))
    trees = gauge.groupBy(*KEY).agg(
        F.count("*").alias("touched"), F.count_if(F.col("u") == F.col("label")).alias("c"))
    size = F.col("m") - F.col("touched") + F.col("c")
    return sizes.select(*KEY).join(edges, KEY, "left").join(trees, KEY, "left").fillna(0).select(
        *KEY, size.alias("cycle_basis_size"), F.col("bad").alias("frustrated_cycle_basis_count"),
        F.try_divide(F.col("bad").cast("double"), size.cast("double")).alias(
            "frustrated_cycle_basis_fraction"))


def colorable(vertices: DataFrame, edges: DataFrame, colors: int) -> DataFrame:
    """Exact k-colourability: key, colorable, one row per instance.

    Each instance of at most 16 vertices is one row; its partial colourings are folded vertex by
    vertex as 64-bit words (4 bits per vertex), forgetting vertices whose neighbours are all
    coloured. Beyond, two colours are decided by the signed forest and more by ``coloring_widths``,
    NULL where a component is too dense for it.
    """
    counted = cut(vertices.groupBy(*KEY).agg(F.count("*").alias("n")))
    small = counted.where(F.col("n") <= COLORING_LIMIT)
    order = Window.partitionBy(*KEY).orderBy("u")
    placed = vertices.join(small.select(*KEY), KEY, "left_semi").select(
        *KEY, "u", (F.row_number().over(order) - 1).alias("pos"))
    simple = edges.where("u <> v").select(
        *KEY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = simple.join(placed.select(*KEY, "u", F.col("pos").alias("p")), [*KEY, "u"]).join(
        placed.select(*KEY, F.col("u").alias("v"), F.col("pos").alias("q")), [*KEY, "v"])
    rows = ends.groupBy(*KEY).agg(F.collect_list(F.struct("p", "q")).alias("e"))
    folded = F.expr(f"""
        aggregate(
          transform(sequence(0, CAST(n AS INT) - 1), x -> named_struct(
            'pos', x,
            'prev', transform(filter(e, y -> y.q = x), y -> y.p),
            'keep', aggregate(filter(e, y -> y.p <= x AND y.q > x), 0L,
                              (m, y) -> m | shiftleft(15L, 4 * y.p)))),
          array(0L),
          (acc, x) -> array_distinct(flatten(transform(acc, s -> transform(
            filter(sequence(1, least({int(colors)}, x.pos + 1)), c -> NOT exists(
              x.prev, u -> (shiftright(s, 4 * u) & 15L) = c)),
            c -> (s | shiftleft(CAST(c AS BIGINT), 4 * x.pos)) & x.keep)))))""")
    answer = F.when(F.lit(int(colors)) >= F.col("n"), True).when(
        F.lit(int(colors)) < 1, False).otherwise(F.size(folded) > 0)
    none = "CAST(array() AS array<struct<p:int,q:int>>)"
    checked = small.join(rows, KEY, "left").withColumn(
        "e", F.coalesce("e", F.expr(none))).select(*KEY, answer.alias("colorable"))
    large = counted.where(F.col("n") > COLORING_LIMIT).select(*KEY)
    if large.isEmpty():
        return checked
    if colors != 2:
        return union(checked, coloring_widths(vertices.join(large, KEY, "left_semi"), edges, colors).select(
            *KEY, "colorable"))
    # with every edge asking for unlike ends, an odd cycle is an edge that the forest cannot satisfy
    unlike = edges.join(large, KEY, "left_semi").select(
        *KEY, F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("coupling"))
    gauge = spanning_gauge(unlike.where("i <> j"))
    ends = unlike.join(gauge.select(*KEY, F.col("u").alias("i"), F.col("sign").alias("si")), [*KEY, "i"], "left").join(
        gauge.select(*KEY, F.col("u").alias("j"), F.col("sign").alias("sj")), [*KEY, "j"], "left")
    odd = ends.where("i <> j AND si = sj").select(*KEY).distinct().withColumn("odd", F.lit(True))
    return union(checked, large.join(odd, KEY, "left").select(
        *KEY, F.col("odd").isNull().alias("colorable")))


def _core(edges: DataFrame, colors: int) -> DataFrame:
    """Edges (u < v) left once vertices with fewer than ``colors`` neighbours are gone, again and again.

    Such a vertex can always be coloured last. After ``MAX_ROUNDS`` rounds the rest stays as it is,
    which costs time but no correctness.
    """
    for _ in range(MAX_ROUNDS):
        ends = union(edges.select(*KEY, "u"), edges.select(*KEY, F.col("v").alias("u")))
        low = cut(ends.groupBy(*KEY, "u").count().where(F.col("count") < colors).select(*KEY, "u"))
        if low.isEmpty():
            break
        edges = cut(edges.join(low, [*KEY, "u"], "left_anti").join(
            low.withColumnRenamed("u", "v"), [*KEY, "v"], "left_anti").select(*KEY, "u", "v"))
    return edges


def frontier_coloring(pairs: list[tuple[int, int]], colors: int, most: int = FRONTIER_STATES) -> tuple[bool | None, int]:
    """Can the connected graph be coloured, and how many vertices were open at most?

    Vertices are coloured in an order that closes others early. A state holds the colours of vertices
    that still have uncoloured neighbours, named by first occurrence, so states that later vertices
    cannot tell apart are one. More than ``most`` states give no answer.
    """
    near: dict[int, set[int]] = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    waiting = {u: len(n) for u, n in near.items()}  # neighbours without a colour
    placed: set[int] = set()
    front: list[int] = []
    states, width = {()}, 0
    while len(placed) < len(near):
        reach = {v for u in front for v in near[u] if v not in placed} or {min(near, key=lambda u: (len(near[u]), u))}
        new = min(reach, key=lambda v: ((waiting[v] > 0) - sum(waiting[u] == 1 for u in near[v] if u in placed),
                                        waiting[v], v))
        placed.add(new)
        for u in near[new]:
            waiting[u] -= 1
        clash = [k for k, u in enumerate(front) if u in near[new]]
        stay = [k for k, u in enumerate([*front, new]) if waiting[u]]
        front = [[*front, new][k] for k in stay]
        width, grown = max(width, len(front)), set()
        for state in states:
            taken = {state[k] for k in clash}
            for color in range(min(colors, max(state, default=-1) + 2)):
                if color not in taken:
                    names: dict[int, int] = {}
                    both = (*state, color)
                    grown.add(tuple([names.setdefault(both[k], len(names)) for k in stay]))
            if len(grown) > most:
                return None, width
        if not grown:
            return False, width
        states = grown
    return True, width


def coloring_widths(vertices: DataFrame, edges: DataFrame, colors: int) -> DataFrame:
    """Exact k-colourability of sparse graphs of any size: key, colorable, width.

    The graph is peeled to its core, whose components are coloured one by one (``frontier_coloring``).
    ``width`` is the widest frontier met (0 without a core). An instance is not colourable if one
    component is not; it is NULL if none is known not to be and one has more than
    ``COMPONENT_EDGES`` edges (width NULL too) or needs more than ``FRONTIER_STATES`` states.
    """
    keys = vertices.select(*KEY).distinct()
    simple = cut(edges.where("u <> v").join(keys, KEY, "left_semi").select(
        *KEY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if colors < 1:
        return keys.select(*KEY, F.lit(False).alias("colorable"), F.lit(0).alias("width"))
    core = _core(simple, colors)
    parted = core.join(component_labels(core), [*KEY, "u"])
    counts = cut(parted.groupBy(*KEY, "label").agg(F.count("*").alias("m")))
    fits = counts.where(F.col("m") <= COMPONENT_EDGES)
    types = {f.name: f.dataType.simpleString() for f in core.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in KEY) + ", colorable boolean, width int"

    def colored(group: pd.DataFrame) -> pd.DataFrame:
        found, width = frontier_coloring(list(zip(group["u"], group["v"], strict=True)), colors)
        out = group.iloc[:1][list(KEY)].copy()
        out["colorable"], out["width"] = pd.array([found], dtype="boolean"), width
        return out

    known = parted.join(fits.drop("m"), [*KEY, "label"], "left_semi").groupBy(*KEY, "label").applyInPandas(
        colored, schema)
    unknown = counts.where(F.col("m") > COMPONENT_EDGES).select(
        *KEY, F.lit(None).cast("boolean").alias("colorable"), F.lit(None).cast("int").alias("width"))
    worst = union(known, unknown).groupBy(*KEY).agg(
        F.count_if(F.col("colorable") == F.lit(False)).alias("bad"), F.count_if(F.col("colorable").isNull()).alias("open"),
        F.count_if(F.col("width").isNull()).alias("unseen"), F.max("width").alias("width"))
    answer = F.when(F.coalesce("bad", F.lit(0)) > 0, False).when(F.coalesce("open", F.lit(0)) > 0, None).otherwise(True)
    return keys.join(worst, KEY, "left").select(
        *KEY, answer.alias("colorable"),
        F.when(F.coalesce("unseen", F.lit(0)) == 0, F.coalesce("width", F.lit(0))).alias("width"))


def _reaches_half(half: int, values: list[int], counts: list[int]) -> bool:
    """Is ``half`` a sum of some values? Bit s of an integer says whether s can be reached."""
    reached, mask = 1, (1 << (half + 1)) - 1
    for value, count in sorted(zip(values, counts, strict=True)):
        step = 1
        while count:  # count copies as 1, 2, 4, ... and the rest of them
            step = min(step, count)
            reached = (reached | (reached << (value * step))) & mask
            count, step = count - step, 2 * step
        if reached >> half & 1:
            break
    return bool(reached >> half & 1)


def _halved(batches):
    """Instances, one row each, with the answer of ``_reaches_half``."""
    for batch in batches:
        total, values, counts = (batch.column(n).to_pylist() for n in ("total", "values", "counts"))
        found = [_reaches_half(t // 2, v, c) for t, v, c in zip(total, values, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(found, pa.bool_())], names=[*KEY, "found"])


def _sums(numbers: str) -> str:
    return f"aggregate({numbers}, array(0L), (s, x) -> concat(s, transform(s, y -> y + x)))"


def _halves(numbers: DataFrame) -> DataFrame:
    """Keys of instances (key, half, a: at most 40 values) with a subset that sums to ``half``.

    The sums of either half of the values are rows and meet in a join on the sum.
    """
    quarter = HALVES_LIMIT // 4

    def side(first: int) -> DataFrame:
        one, two = (_sums(f"slice(a, {first + k * quarter + 1}, {quarter})") for k in (0, 1))
        return numbers.select(*KEY, "half", F.expr(two).alias("two"), F.explode(F.expr(one)).alias("x")).select(
            *KEY, "half", "x", F.explode("two").alias("y")).select(*KEY, "half", (F.col("x") + F.col("y")).alias("s"))

    right = side(2 * quarter).select(*KEY, (F.col("half") - F.col("s")).alias("s"))
    return side(0).join(right, [*KEY, "s"], "left_semi").select(*KEY).distinct()


def perfect_partition(numbers: DataFrame) -> DataFrame:
    """Can the numbers be split into equal sums?  key, perfect_partition_exists.

    Equal numbers are counted first, which leaves at most sqrt(2 total) rows of an instance. Totals up
    to 2 ``SUM_BITS`` are decided by a bit set of reachable sums whatever the count, larger ones of at
    most ``HALVES_LIMIT`` numbers by joining the sums of two halves. An odd total, or a number above the
    rest's sum, is answered at any size; NULL is left for longer instances of larger totals, and
    for totals beyond 64 bits. Signs do not matter, as either side may take a number.
    """
    counted = cut(numbers.select(*KEY, F.abs(F.col("value").cast("long")).alias("value")).groupBy(*KEY, "value").agg(
        F.count("*").alias("c")))
    facts = cut(counted.groupBy(*KEY).agg(
        F.sum("c").alias("n"), F.expr("try_sum(try_multiply(value, c))").alias("total"),
        F.count_if(F.expr("try_multiply(value, c) IS NULL AND value IS NOT NULL")).alias("wide"), F.max("value").alias("top")))
    total = F.when(F.col("wide") == 0, F.col("total"))
    facts = facts.withColumn("total", total)
    impossible = F.expr("total % 2 = 1 OR top > total - top")
    open_ = facts.where(~impossible)
    types = {f.name: f.dataType.simpleString() for f in counted.schema.fields}
    small = counted.where("value > 0").join(open_.where(F.col("total") <= 2 * SUM_BITS).select(*KEY, "total"), KEY)
    # distinct values of a bounded total are few, so an instance is a row and Arrow batches hold many
    by_bits = small.groupBy(*KEY, "total").agg(F.collect_list(F.struct("value", "c")).alias("a")).select(
        *KEY, "total", F.col("a.value").alias("values"), F.col("a.c").alias("counts")).mapInArrow(
        _halved, ", ".join(f"{k} {types[k]}" for k in KEY) + ", found boolean")
    few = open_.where((F.col("total") > 2 * SUM_BITS) & (F.col("n") <= HALVES_LIMIT)).select(
        *KEY, F.expr("total DIV 2").alias("half"))
    listed = cut(counted.join(few, KEY).groupBy(*KEY, "half").agg(
        F.flatten(F.collect_list(F.array_repeat("value", F.col("c").cast("int")))).alias("a")))
    by_halves = listed.select(*KEY).join(_halves(listed).withColumn("yes", F.lit(True)), KEY, "left").select(
        *KEY, F.coalesce("yes", F.lit(False)).alias("found"))
    answer = F.when(impossible, False).when(F.col("total") == 0, True).otherwise(F.col("found"))
    return facts.join(union(by_bits, by_halves), KEY, "left").select(*KEY, answer.alias("perfect_partition_exists"))

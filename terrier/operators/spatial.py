"""Spatial joins: nearest neighbours over a grid that grows until it is sure, touching polygons by shared cells, and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.functions.values import worked_out
from terrier.operators import ranks
from terrier.operators.components import connected_components
from terrier.sources.scratch import written

K = 25
#: A first cell holds no more points than this many times k, where halving its width can bring that about; and where only some points ask.
CROWD, CROWD_OF_FEW, HALVINGS = 8, 2, 24


def _first_width(places: DataFrame, width: float, k: int, crowd: int = CROWD) -> tuple[float, bool]:
    """The width, halved until no cell is crowded, and whether that came about: a few points far out must not make one cell of a town."""
    for _ in range(HALVINGS):
        fullest = places.groupBy("part", F.floor(F.col("x") / width), F.floor(F.col("y") / width)).count().agg(F.max("count")).first()[0]
        if fullest <= crowd * (k + 1):
            return width, True
        width /= 2 if fullest <= 4 * crowd * (k + 1) else 4
    return width, False


def _room(cell: float, reach: int) -> Column:
    """How far away anything outside the cells around a point lies at least."""
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    return F.least(F.col("x") - (cx - reach) * cell, (cx + reach + 1) * cell - F.col("x"), F.col("y") - (cy - reach) * cell, (cy + reach + 1) * cell - F.col("y"))


def _steps(reach: int = 1) -> Column:
    ring = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(ring, lambda i: F.transform(ring, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _near(around: str, k: int) -> Column:
    """Of the points in an array, the k nearest others as structs (distance, neighbour_id), in order."""
    others = F.filter(around, lambda p: p["id"] != F.col("id"))
    return F.slice(F.array_sort(F.transform(others, lambda p: F.struct(F.hypot(F.col("x") - p["x"], F.col("y") - p["y"]).alias("distance"), p["id"].alias("neighbour_id")))), 1, k)


def _sure(found: DataFrame, cell: float, k: int) -> DataFrame:
    return found.withColumn("sure", F.coalesce((F.size("near") == k) & (F.element_at("near", -1)["distance"] < _room(cell, 1)), F.lit(False)))


def _nearest_of_few(asking: DataFrame, points: DataFrame, cell: float, k: int) -> DataFrame:
    """What _nearest_in_order() gives, for few that ask: each point is dealt once, to its own cell, and what asks goes to the nine cells around it."""
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    held = points.select("part", cx.alias("cx"), cy.alias("cy"), F.struct("id", "x", "y").alias("point")).groupBy("part", "cx", "cy").agg(F.collect_list("point").alias("around"))
    wide = asking.select("id", "x", "y", "part", F.explode(_steps()).alias("s")).select("id", "x", "y", "part", (cx + F.col("s.i")).alias("cx"), (cy + F.col("s.j")).alias("cy"))
    each = worked_out(wide.join(held.hint("merge"), ["part", "cx", "cy"], "left").drop("cx", "cy"), _near("around", k).alias("near")).drop("around")
    return _sure(each.groupBy("id", "x", "y", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")), cell, k)


def _nearest_in_order(asking: DataFrame, points: DataFrame, cell: float, k: int) -> DataFrame:
    """asking with `near`, the k nearest among points in the cells around (distance, neighbour_id), nearest first, and `sure`. Cells must not be crowded: what lies around each, nine times CROWD * (k + 1) points at most, meets as one array, and no pair becomes a row."""
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    dealt = points.select("part", cx.alias("cx"), cy.alias("cy"), F.struct("id", "x", "y").alias("point"), F.explode(_steps()).alias("s"))
    around = dealt.select("part", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "point").groupBy("part", "cx", "cy").agg(F.collect_list("point").alias("around"))
    # Dealt by cell: points that ask from few small files would be few tasks, and what lies around all cells is too much to broadcast.
    met = asking.select("*", cx.alias("cx"), cy.alias("cy")).join(around.hint("merge"), ["part", "cx", "cy"], "left")
    return _sure(worked_out(met.drop("cx", "cy"), _near("around", k).alias("near")).drop("around"), cell, k)


def _nearest_once(asking: DataFrame, points: DataFrame, cell: float, reach: int, k: int) -> DataFrame:
    """For asking points, the k nearest among points in the cells up to `reach` away; `sure` says that none outside can be nearer."""
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    wide = asking.select("*", F.explode(_steps(reach)).alias("s")).select("id", "x", "y", "part", (cx + F.col("s.i")).alias("cx"), (cy + F.col("s.j")).alias("cy"))
    held = points.select(F.col("id").alias("neighbour_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("part"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    pairs = wide.join(held, ["part", "cx", "cy"]).where("id != neighbour_id").withColumn("distance", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")))
    w = Window.partitionBy("id").orderBy("distance", "neighbour_id")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    room = _room(cell, reach)
    return top.withColumn("sure", (F.count("*").over(Window.partitionBy("id")) == k) & (F.max("distance").over(Window.partitionBy("id")) < room)).select("id", "neighbour_id", "distance", "rank", "sure")


def nearest(points: DataFrame, k: int = K, cell: float | None = None, part: str | None = None, asks: str | None = None) -> DataFrame:
    """points (id, x, y): id, neighbour_id, distance, rank for the k nearest others (of the same `part`, if that column is given), ties to the smaller id; all others, if there are no more than k. With `asks`, a column of booleans, only for the points where it is true.

    Points ask in their own cell of a grid and those around it. Those that can't be sure of their k nearest ask again,
    with cells twice as wide, until none is left; each round is written to the shared folder and fewer points take part.
    The first cells are so narrow that none is crowded, and of points at one place only the first k + 1 are candidates.
    Ids must be unique. Points without coordinates have no neighbours."""
    base = written(points.where("x is not null and y is not null").select("id", "x", "y", (F.col(part) if part else F.lit(0)).alias("part"), (F.col(asks) if asks else F.lit(True)).alias("asks")), "points")
    sizes = base.groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("t"))
    # Of points at one place only the first k + 1 can be among anybody's k nearest.
    here = Window.partitionBy("part", "x", "y").orderBy("id")
    held = written(base.withColumn("turn", F.row_number().over(here)).where(F.col("turn") <= k + 1).drop("turn", "asks"), "held")
    n, span = sizes.agg(F.max("n"), F.max(F.greatest(F.col("e") - F.col("w"), F.col("t") - F.col("s")))).first()
    if not n:
        return base.select("id", F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    cell, sparse = (cell, False) if cell else _first_width(held, max(1e-9, (span or 1.0) * (k / n) ** 0.5), k, CROWD_OF_FEW if asks else CROWD)
    # A part of no more than k + 1 points is told from one whose points lie far apart.
    expected = sizes.select("part", F.least(F.col("n") - 1, F.lit(k)).alias("all"))
    asking, done = base.where("asks").drop("asks"), None
    if sparse:
        # Nearly all are sure in the first round, which makes no row of a pair.
        first = written((_nearest_of_few if asks else _nearest_in_order)(asking, held, cell, k).join(F.broadcast(expected), "part").withColumn("settled", F.col("sure") | ((F.coalesce(F.size("near"), F.lit(0)) == F.col("all")) & (F.col("all") < k))), "nearest")
        done = first.where("settled").select("id", F.posexplode("near").alias("at", "n")).select("id", "n.neighbour_id", "n.distance", (F.col("at") + 1).alias("rank"), F.lit(True).alias("sure"))
        asking = written(first.where("not settled").select("id", "x", "y", "part"), "asking")
        if asking.isEmpty():
            return done.select("id", "neighbour_id", "distance", "rank")
        cell *= 2
    while True:
        found = written(_nearest_once(asking, held, cell, 1, k), "nearest")
        counts = found.groupBy("id").agg(F.count("*").alias("got"), F.max("sure").alias("sure"))
        state = asking.join(counts, "id", "left").join(expected, "part")
        settled = state.where((F.coalesce("sure", F.lit(False))) | ((F.coalesce("got", F.lit(0)) == F.col("all")) & (F.col("all") < k)))
        now = found.join(settled.select("id"), "id", "left_semi")
        done = now if done is None else done.unionByName(now)
        asking = written(asking.join(settled.select("id"), "id", "left_anti"), "asking")
        if asking.isEmpty():
            return done.select("id", "neighbour_id", "distance", "rank")
        if cell > 2 * (span or 1.0):  # one round over everything is sure even where no distance is
            last = written(_nearest_once(asking, held, 4 * cell, 1, k), "nearest")
            return done.unionByName(last).select("id", "neighbour_id", "distance", "rank")
        cell *= 2


def touching_once(shapes: DataFrame, snap: float = geo.SNAP, cell: float = geo.CELL) -> DataFrame:
    """shapes (id, ring and, if wanted, known, a struct): id, neighbour_id, distance for rings no further apart than snap, each pair once (id < neighbour_id), with the `known` of both as own and other. What is known goes along with the shapes, so that no table of pairs has to be joined for it. Shapes that share a cell of the grid are compared once each, boxes first; a ring's gap is worked out for the rest only."""
    known = [c for c in ("known",) if c in shapes.columns]
    boxed = shapes.select("id", "ring", *known, geo.box(F.col("ring")).alias("b"), geo.is_finite(F.col("ring")).alias("finite"))
    filed = boxed.select("id", "ring", *known, "b.*", "finite", F.explode(geo.cells(F.col("b"), snap, cell)).alias("c")).withColumns({"cx": F.col("c.cx"), "cy": F.col("c.cy")}).drop("c")
    side = lambda p: filed.select("cx", "cy", *[F.col(x).alias(f"{p}_{x}") for x in filed.columns if x not in ("cx", "cy")])
    # A pair meets in each cell that both are in; the one with the lower left corner of the boxes' overlap counts.
    first = lambda at, low: F.col(at) == F.floor((F.greatest(f"a_{low}", f"b_{low}") - snap) / cell)
    apart = lambda low, high: (F.col(f"a_{low}") - snap <= F.col(f"b_{high}")) & (F.col(f"b_{low}") - snap <= F.col(f"a_{high}"))
    # Merged: rings of all shapes are too much to broadcast, however small their columns look in a written table. Boxes are plain numbers and come first: most pairs of a cell go by them.
    pairs = side("a").join(side("b").hint("merge"), ["cx", "cy"]).where(apart("west", "east") & apart("south", "north") & (F.col("a_id") < F.col("b_id")) & first("cx", "west") & first("cy", "south"))
    # Rings with a corner in common are 0 apart; only the others, written with their rings, are sent to be measured.
    shared = F.col("a_finite") & F.col("b_finite") & F.coalesce(F.arrays_overlap("a_ring", "b_ring"), F.lit(False))
    unless = lambda ring: F.when(~F.col("shared"), F.col(ring)).alias(ring)
    told = [F.col(x).alias(y) for x, y in (("a_id", "id"), ("b_id", "neighbour_id"), *[(f"{p}_known", y) for p, y in (("a", "own"), ("b", "other")) if known])]
    met = written(worked_out(pairs, shared.alias("shared")).select(*told, "shared", unless("a_ring"), unless("b_ring")), "met")
    columns = [c for c in met.columns if c in ("id", "neighbour_id", "own", "other")]
    measured = met.where("not shared").select(*columns, geo.min_ring_distance(F.col("a_ring"), F.col("b_ring")).alias("distance")).where(F.col("distance") <= snap)
    # What is known is read by several rules, each of which would measure again.
    measured = written(measured, "measured") if known else measured
    return met.where("shared").select(*columns, F.lit(0.0).alias("distance")).unionByName(measured)


def touching(shapes: DataFrame, snap: float = geo.SNAP, cell: float = geo.CELL) -> DataFrame:
    """shapes (id, ring): id, neighbour_id, distance for rings no further apart than snap, both ways."""
    ways = F.array(*[F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour_id"), "distance") for x, y in (("id", "neighbour_id"), ("neighbour_id", "id"))])
    return touching_once(shapes.select("id", "ring"), snap, cell).select(F.inline(ways))


def touch_lists(touches: DataFrame) -> DataFrame:
    """id and its neighbours as structs (distance, neighbour_id), the nearest first, of equal ones by id. A parcel's neighbours are as many as touch it."""
    return touches.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("neighbours"))


def can_lag() -> Column:
    """Whether a feature counts in its neighbours' lags."""
    return ~F.col("unjoined") & (F.coalesce("allocation", F.lit("")) != "copied_full_assessment") & F.col("taxable").isNotNull()


def lags(features: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Medians of taxable value and value per acre of the eligible neighbours of each feature, their number, and the residual; neighbours (id, neighbour_id)."""
    peers = features.where(can_lag()).select(F.col("parcel_id").alias("neighbour_id"), F.col("taxable").alias("t"), F.col("taxable_per_acre").alias("v"))
    own = features.select("parcel_id", F.when(can_lag(), F.col("taxable")).alias("observed"))
    # Sorted within each feature, not held as a table of counts for each median: one would be sent and spilled for nearly every pair.
    here = Window.partitionBy("id")
    place = lambda c: F.row_number().over(here.orderBy(F.col(c).asc_nulls_last()))
    ranked = neighbours.select("id", "neighbour_id").join(peers, "neighbour_id").select("id", "t", "v").withColumns({"t_at": place("t"), "t_n": F.count("t").over(here)}).withColumns({"v_at": place("v"), "v_n": F.count("v").over(here)})
    middle = lambda c, i: F.max(F.when(F.col(f"{c}_at") == F.floor((F.col(f"{c}_n") + i) / 2), F.col(c)))
    half_way = lambda c: ranks.half_way(middle(c, 1), middle(c, 2))
    mids = ranked.groupBy(F.col("id").alias("parcel_id")).agg(half_way("t").alias("lag_taxable"), half_way("v").alias("lag_per_acre"), F.count("*").alias("lag_n"))
    out = own.join(mids, "parcel_id", "left")
    return out.select("parcel_id", "lag_taxable", "lag_per_acre", F.coalesce("lag_n", F.lit(0)).alias("lag_n"), (F.col("observed") - F.col("lag_taxable")).alias("lag_residual"))


def clusters(parcels: DataFrame, touches: DataFrame) -> DataFrame:
    """parcels (parcel_id, owner): parcel_id, owner, component (its smallest parcel) over touches between parcels of one owner; parcels without an owner have none."""
    owned = parcels.where("owner is not null").select("parcel_id", "owner")
    a, b = (owned.select(F.col("parcel_id").alias(i), F.col("owner").alias(o)) for i, o in (("id", "oa"), ("neighbour_id", "ob")))
    links = touches.select("id", "neighbour_id").where("id < neighbour_id").join(a, "id").join(b, "neighbour_id").where("oa = ob")
    found = connected_components(links, "id", "neighbour_id").withColumnRenamed("node", "parcel_id")
    return owned.join(found, "parcel_id", "left").select("parcel_id", "owner", F.coalesce("component", "parcel_id").alias("component"))

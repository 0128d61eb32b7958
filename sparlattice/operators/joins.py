"""Joins of the workflow: completeness, anti joins, chains, coordinates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import checkpointed

#: How often a cell may be halved on each axis, down to a box of twice the tolerance.
HALVINGS = 3
#: Rows of a cell above which it is halved, and points of a block of a cell that can't be.
CELL_ROWS = 20_000


def with_energies(refs: DataFrame, energies: DataFrame, key: Sequence[str]) -> DataFrame:
    """Training references with their energies."""
    return refs.join(energies, list(key))


def missing(refs: DataFrame, energies: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of references without an energy: what is still to be computed."""
    return refs.select(*key).distinct().join(energies.select(*key).distinct(), list(key), "left_anti")


def complete(refs: DataFrame, energies: DataFrame, key: Sequence[str], least_fraction: float = 1.0) -> DataFrame:
    """References with energies; KeyError if fewer than ``least_fraction`` of them have one."""
    total = refs.count()
    kept = with_energies(refs, energies, key)
    n = refs.join(energies.select(*key).distinct(), list(key), "left_semi").count()
    if n < least_fraction * total:
        raise KeyError(f"{total - n} of {total} references have no converged energy")
    return kept


def union_first(sources: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """The union of several sources, of each key the row of the first source and least order."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    names = [c for c in tagged.columns if c not in ("priority", order)]
    best = tagged.groupBy(key).agg(F.min(F.struct("priority", order, *[c for c in names if c != key])).alias("r"))
    return best.select(key, "r.priority", f"r.{order}", *(f"r.{c}" for c in names if c != key))


def conflicts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values) of the keys that map to more than one value."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def chain_depths(blocks: DataFrame, key: str, parent: str, rounds: int = 64) -> DataFrame:
    """(key, root, depth) of linked blocks, roots being those without a parent.

    Pointers are doubled, so a chain of n blocks takes about log2 n joins;
    each round is checkpointed. Raises if pointers remain after ``rounds``,
    as they do in a circle.
    """
    state = blocks.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = state.withColumn("root", F.coalesce("up", "k"))
    for _ in range(rounds):
        state = checkpointed(state)
        if state.where("up IS NOT NULL").isEmpty():
            return state.select(F.col("k").alias(key), "root", "depth")
        ups = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        state = state.join(ups, "up", "left").select("k", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root"))
    raise ValueError("the chain has a circle or is too long")


def frac_key(x: Column, digits: int = 8) -> Column:
    """A fractional coordinate modulo 1, rounded half to even; a value just below 1 may round to 1."""
    return F.bround(x - F.floor(x), digits)


def periodic_distance(a: Column, b: Column) -> Column:
    """Distance of fractional coordinates along one axis under periodic boundaries."""
    d = F.abs(a - b) - F.floor(F.abs(a - b))
    return F.least(d, F.lit(1.0) - d)


def cells(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def near_points(left: DataFrame, right: DataFrame, axes: Sequence[str], tolerance: float, cell_rows: int = CELL_ROWS, halvings: int = HALVINGS) -> DataFrame:
    """Pairs of points (l_id, r_id) within ``tolerance`` on every axis.

    Space is cut into cells over all axes. A right point is in one cell, a left
    point in each that its box of twice the tolerance touches, so that the join is an equality on
    cells and finds each pair once. Cells with more than ``cell_rows`` rows are halved, axis by axis, down to
    the size of that box; what is still too dense is joined in blocks of right
    points. Points without a coordinate have no partner. With fewer ``halvings`` cells
    begin smaller, dealt to all shuffle partitions: for points that have many partners each.
    """
    n_axes = len(axes)
    box = max(2 * tolerance, 1e-6)
    widths = [box * 2**halvings] * n_axes
    a = left.select(F.col("id").alias("l_id"), *(F.col(x).cast("double").alias(f"l_{x}") for x in axes)).dropna()
    b = right.select(F.col("id").alias("r_id"), *(F.col(x).cast("double").alias(f"r_{x}") for x in axes)).dropna()
    for x in axes:
        low, high = (cells(F.col(f"l_{x}") + F.lit(shift), widths[0]) for shift in (-tolerance, tolerance))
        a = a.withColumn(f"c_{x}", F.explode(F.sequence(low, high)))
        b = b.withColumn(f"c_{x}", cells(F.col(f"r_{x}"), widths[0]))
    on = [f"c_{x}" for x in axes]
    close = F.lit(True)
    for x in axes:
        close = close & (F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")) <= tolerance)
    done: list[DataFrame] = []
    for level in range(halvings * n_axes + 1):
        full = _full_cells(a, b, on, cell_rows)
        if full is None:
            if halvings < HALVINGS:
                tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                a, b = a.repartition(tasks, *on), b.repartition(tasks, *on)
            return _all_of([*done, a.join(b, on).where(close).select("l_id", "r_id")])
        sparse = [side.join(full, on, "left_anti") for side in (a, b)]
        done.append(sparse[0].join(sparse[1], on).where(close).select("l_id", "r_id"))
        a, b = (side.join(full.select(*on), on, "left_semi") for side in (a, b))
        if level == halvings * n_axes:
            break
        i = level % n_axes
        widths[i] /= 2
        low, high = (cells(F.col(f"l_{axes[i]}") + F.lit(shift), widths[i]) for shift in (-tolerance, tolerance))
        # A cell's halves are 2c and 2c + 1; a box may reach into its neighbours, where it has rows of its own.
        halves = F.filter(F.sequence(low, high), _half_of(on[i]))
        a = checkpointed(a.withColumn(on[i], F.explode(halves)))
        b = checkpointed(b.withColumn(on[i], cells(F.col(f"r_{axes[i]}"), widths[i])))
    blocks = full.select(*on, F.ceil(F.col("n") / F.lit(cell_rows)).cast("long").alias("__blocks"))
    a = a.join(blocks, on).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    b = b.join(blocks, on).withColumn("__block", F.pmod(F.xxhash64("r_id"), F.col("__blocks")))
    done.append(a.join(b.drop("__blocks"), [*on, "__block"]).where(close).select("l_id", "r_id"))
    return _all_of(done)


def _half_of(cell: str) -> Callable[[Column], Column]:
    return lambda half: F.floor(half / F.lit(2)).cast("long") == F.col(cell)


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _full_cells(a: DataFrame, b: DataFrame, on: list[str], cell_rows: int) -> DataFrame | None:
    """(cell..., n) of the cells in which one side has more than ``cell_rows`` rows, None if there is none."""
    sides = [side.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows) for side in (a, b)]
    full = sides[0].unionByName(sides[1]).groupBy(*on).agg(F.max("n").alias("n"))
    full = checkpointed(full)
    return None if full.isEmpty() else full


def with_ambiguity(pairs: DataFrame) -> DataFrame:
    """(l_id, r_id, ambiguous): whether one of the two points has another partner, so that taking
    the first unused one would depend on the order of rows."""
    lefts = pairs.groupBy("l_id").agg((F.count("*") > 1).alias("__l"))
    rights = pairs.groupBy("r_id").agg((F.count("*") > 1).alias("__r"))
    return pairs.join(lefts, "l_id").join(rights, "r_id").select("l_id", "r_id", (F.col("__l") | F.col("__r")).alias("ambiguous"))


def near_points_with_ambiguity(left: DataFrame, right: DataFrame, axes: Sequence[str], tolerance: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``with_ambiguity`` of ``near_points``; pairs, whose number may grow as the square of the
    points, are counted and made where they are found, and only points are shuffled.

    Pairs that aren't ambiguous are those of two points without another partner, so that
    there are no more of them than points. All others are pairs of the remaining points.
    """
    points = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l_id").alias("id"), F.col("r_id").alias("other")), F.struct(F.lit(1).alias("side"), F.col("r_id").alias("id"), F.col("l_id").alias("other"))))
    found = near_points(left, right, axes, tolerance, cell_rows, 0).select(points.alias("p")).groupBy("p.side", "p.id")
    single = checkpointed(found.agg(F.count("*").alias("n"), F.min("p.other").alias("other")).where("n = 1"))
    lefts, rights = (single.where(F.col("side") == k).select(*(F.col(c).alias(n) for c, n in zip(("id", "other"), names, strict=True))) for k, names in ((0, ("l_id", "r_id")), (1, ("r_id", "l_id"))))
    certain = checkpointed(lefts.join(rights, ["l_id", "r_id"]))
    rest = (side.join(certain.select(F.col(c).alias("id")), "id", "left_anti") for side, c in ((left, "l_id"), (right, "r_id")))
    pairs = near_points(*rest, axes, tolerance, cell_rows, 0)
    return certain.withColumn("ambiguous", F.lit(False)).unionByName(pairs.withColumn("ambiguous", F.lit(True)))


def greedy_matches(pairs: DataFrame, group: str) -> DataFrame:
    """(group, a, b, distance): pairs taken nearest first, each site once, within each group.

    ``pairs``: (group, a, b, distance), within tolerance; equal distances in the
    order of a, then b. A structure's pairs are one group, which its number of
    sites bounds.
    """
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    nearest = F.array_sort(F.collect_list(F.struct("distance", "a", "b")))
    pair = f"struct<distance:{kind['distance']},a:{kind['a']},b:{kind['b']}>"
    none = F.struct(*(F.array().cast(f"array<{t}>").alias(n) for n, t in (("a", kind["a"]), ("b", kind["b"]), ("kept", pair))))

    def step(s: Column, r: Column) -> Column:
        free = ~F.array_contains(s["a"], r["a"]) & ~F.array_contains(s["b"], r["b"])
        more = F.struct(F.array_append(s["a"], r["a"]).alias("a"), F.array_append(s["b"], r["b"]).alias("b"), F.array_append(s["kept"], r).alias("kept"))
        return F.when(free, more).otherwise(s)

    kept = pairs.groupBy(group).agg(F.aggregate(nearest, none, step)["kept"].alias("kept"))
    return kept.select(group, F.inline("kept")).select(*pairs.columns)

"""Configurations on lattices: supercells, random snapshots, moments, properties."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magnitudes of starting moments by element, in Bohr magnetons. Fixed values.
MOMENTS = {"V": 3.0, "Cr": 5.0, "Mn": 5.0, "Fe": 5.0, "Co": 5.0, "Ni": 5.0, "Cu": 1.0, "Mo": 5.0, "W": 5.0}

#: Sites of a cell on active sublattices by prototype. Fixed values.
ACTIVE_SITES = {"rocksalt": {"Es": 4}, "garnet": {"Es": 8, "Fm": 12}, "spinel": {"Es": 2, "Fm": 4}, "doubleperovskite": {"Es": 1, "Fm": 1}, "pyrochlore": {"Es": 16, "Fm": 16}, "ilmenite": {"Es": 2, "Fm": 2}}

#: Most rows of sites and clusters that one task groups, about.
TASK_ROWS = 1_000_000


def supercell(sites: DataFrame, diag: tuple[int, int, int]) -> DataFrame:
    """Each site in every image of a diagonal supercell, with image indices i, j, k and scaled coordinates."""
    out = sites
    for name, axis, n in zip("ijk", ("fx", "fy", "fz"), diag, strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(axis, (F.col(axis) + F.col(name)) / F.lit(float(n)))
    return out


def spin_sign(kind: Column, site: Column, i: Column, j: Column, k: Column) -> Column:
    """+1 or -1: ferromagnetic, antialigned (two sites, 0 up and 1 down) or alternating by the parity of i + j + k; 0 if nonmagnetic."""
    parity = F.when(F.pmod(i + j + k, F.lit(2)) == 0, 1).otherwise(-1)
    return F.when(kind == "ferromagnetic", 1).when(kind == "antialigned", F.when(site == 0, 1).otherwise(-1)).when(kind == "afm", parity).when(kind == "nonmagnetic", 0).otherwise(F.raise_error(F.concat(F.lit("no moments for "), kind)).cast("int")).cast("int")


def moment(element: Column, sign: Column) -> Column:
    """The signed moment of an element; a magnetic element on a site without a sign fails."""
    table = F.create_map(*(F.lit(v) for kv in MOMENTS.items() for v in kv))
    size = F.coalesce(F.element_at(table, element), F.lit(0.0))
    return F.when((size > 0) & (sign == 0), F.raise_error(F.concat(F.lit("a magnetic element on a nonmagnetic site: "), element)).cast("double")).otherwise(size * sign)


def without_placeholders(sites: DataFrame, label: str = "X") -> DataFrame:
    """Sites of real species; ValueError if none is left."""
    out = sites.where(F.col("species") != label)
    if out.isEmpty():
        raise ValueError("no site is left without placeholders")
    return out


def rng_for(set_id: str, index: int) -> np.random.Generator:
    """The generator of a configuration: seeded by the first eight bytes, big-endian, of SHA-256 of "set:index"."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{set_id}:{index}".encode()).digest()[:8], "big"))


def checked_counts(counts: dict[str, int], sites: int) -> dict[str, int]:
    """Counts in the order of elements; none may be below one and they must fill the sites."""
    if any(n <= 0 for n in counts.values()):
        raise ValueError(f"counts must be positive: {counts}")
    if sum(counts.values()) != sites:
        raise ValueError(f"{sum(counts.values())} atoms on {sites} sites")
    return dict(sorted(counts.items()))


def snapshot(set_id: str, index: int, sublattices: dict[str, tuple[list[int], dict[str, int]]]) -> dict[int, str]:
    """{site: element}: each sublattice's sites in one random order, cut into slices by element."""
    rng = rng_for(set_id, index)
    out = {}
    for _, (sites, counts) in sorted(sublattices.items()):
        counts = checked_counts(counts, len(sites))
        order = rng.permutation(len(sites))
        at = 0
        for element, n in counts.items():
            for k in order[at : at + n]:
                out[sites[int(k)]] = element
            at += n
    return out


def snapshots(requests: DataFrame, sites: list[tuple[int, str]]) -> DataFrame:
    """(set_id, idx, site, element) for each requested configuration.

    ``requests``: (set_id, idx, composition array<struct<sublattice, element,
    n>>); ``sites``: (site, sublattice) of one supercell, a small template.
    Seeds of mixtures play no part: equal compositions give equal structures.
    """
    by_sublattice: dict[str, list[int]] = {}
    for site, sublattice in sites:
        by_sublattice.setdefault(sublattice, []).append(site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                wanted: dict[str, dict[str, int]] = {}
                for part in r.composition:
                    wanted.setdefault(part["sublattice"], {})[part["element"]] = int(part["n"])
                placed = snapshot(r.set_id, r.idx, {s: (by_sublattice.get(s, []), c) for s, c in wanted.items()})
                rows += [(r.set_id, r.idx, site, element) for site, element in sorted(placed.items())]
            yield pd.DataFrame(rows, columns=["set_id", "idx", "site", "element"])

    return requests.mapInPandas(run, "set_id string, idx long, site long, element string")


def kicked(sites: DataFrame, sigma: float = 0.01, seed: int = 12345) -> DataFrame:
    """Gaussian displacements of the movable sites of each structure, all three axes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("site_idx").reset_index(drop=True)
        step = np.random.default_rng(seed).normal(0.0, sigma, (len(rows), 3))
        for c, axis in enumerate("xyz"):
            rows[axis] = rows[axis] + np.where(rows["movable"], step[:, c], 0.0)
        return rows

    return sites.groupBy("structure_id").applyInPandas(run, sites.schema)


def dealt(rows: DataFrame, orbits: DataFrame, structure: str = "structure_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` by structure, each structure whole in one task, with so many tasks that
    ``orbits`` makes at most about ``task_rows`` rows of a task's sites.

    What is grouped by structure afterwards needs no further exchange, and a task's
    memory doesn't grow with the number of structures. ``rows`` are counted first.
    """
    each = orbits.agg(F.count("*").alias("rows"), F.count_distinct("site").alias("sites")).first()
    tasks = math.ceil(rows.count() * each["rows"] / max(1, each["sites"]) / task_rows)
    return rows.repartition(max(1, tasks), structure)


def orbit_features(occupations: DataFrame, orbits: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(structure_id, orbit_id, phi): the mean over an orbit's clusters of the product of site values.

    ``occupations``: (structure_id, site, value); ``orbits``: (orbit_id,
    cluster_id, site), a static table of the lattice that every task gets: a join by site would
    have as many tasks as a structure has sites. Numeric agreement with any
    other library's basis isn't claimed.
    """
    sites = dealt(occupations, orbits, task_rows=task_rows)
    per_cluster = sites.join(F.broadcast(orbits), "site").groupBy("structure_id", "orbit_id", "cluster_id").agg(F.product("value").alias("phi"))
    return per_cluster.groupBy("structure_id", "orbit_id").agg(F.avg("phi").alias("phi"))


def predicted(structures: DataFrame, orbits: DataFrame, coefficients: DataFrame, task_rows: int | None = TASK_ROWS) -> DataFrame:
    """(model, structure_id, predicted) of every structure under every stored model.

    ``structures``: (structure_id, site, value); ``orbits``: (model, orbit_id, cluster_id,
    site); ``coefficients``: (model, orbit_id, coefficient), where an orbit without
    clusters is the constant. Features are never laid out as rows of a matrix: a coefficient meets the mean of its
    own clusters' products, so that models with other orbits are scored together. Clusters of which a
    structure lacks a site don't count for it. What is stored of the models goes to every task, and
    structures are dealt to tasks; with ``task_rows`` None they are ``dealt`` already.
    """
    full = orbits.groupBy("model", "orbit_id", "cluster_id").agg(F.count("*").alias("__sites"))
    sites = structures if task_rows is None else dealt(structures, orbits, task_rows=task_rows)
    each = sites.join(F.broadcast(orbits), "site").groupBy("model", "structure_id", "orbit_id", "cluster_id").agg(F.product("value").alias("phi"), F.count("*").alias("__have"))
    whole = each.join(F.broadcast(full), ["model", "orbit_id", "cluster_id"]).where("__have = __sites")
    phi = whole.groupBy("model", "structure_id", "orbit_id").agg(F.avg("phi").alias("phi"))
    terms = phi.join(F.broadcast(coefficients), ["model", "orbit_id"]).groupBy("model", "structure_id").agg(F.sum(F.col("phi") * F.col("coefficient")).alias("__sum"))
    having = orbits.select("model", "orbit_id").distinct()
    constant = coefficients.join(F.broadcast(having), ["model", "orbit_id"], "left_anti").groupBy("model").agg(F.sum("coefficient").alias("__constant"))
    out = terms.join(F.broadcast(constant), "model", "left")
    return out.select("model", "structure_id", (F.col("__sum") + F.coalesce("__constant", F.lit(0.0))).alias("predicted"))


def composition_of(sites: DataFrame, role: str | None = None) -> DataFrame:
    """(structure_id, sublattice, species, n): what each sublattice holds, of sites of the role alone if one is given."""
    rows = sites if role is None else sites.where(F.col("role") == role)
    return rows.groupBy("structure_id", "sublattice", "species").agg(F.count("*").alias("n"))


def sublattice_index(sites: DataFrame) -> DataFrame:
    """(structure_id, sublattice, site_list): the sites of each sublattice, ascending; a site twice fails."""
    unique = F.count("*") == F.count_distinct("site_idx")
    agg = sites.groupBy("structure_id", "sublattice").agg(F.array_sort(F.collect_list("site_idx")).alias("site_list"), unique.alias("ok"))
    return agg.where(F.assert_true("ok", F.lit("a site is in a sublattice twice")).isNull()).drop("ok")


def annotated(sites: DataFrame, facts: DataFrame, symbol: str = "species") -> DataFrame:
    """``sites`` with the columns of ``facts`` (symbol, ...), one row a symbol; null for symbols
    it doesn't know. A symbol with two rows fails, since it would double its sites."""
    once = facts.groupBy(symbol).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in facts.columns if c != symbol))
    once = once.where(F.assert_true(F.col("__n") == 1, F.concat(F.lit("two annotations of "), F.col(symbol))).isNull()).drop("__n")
    return sites.join(once, symbol, "left").select(*sites.columns, *(c for c in facts.columns if c != symbol))


def relabelled(label: Column, names: dict[str, str]) -> Column:
    """A label's other name, itself if it has none."""
    out = label
    for old, new in names.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def replaced(sites: DataFrame, elements: DataFrame) -> DataFrame:
    """Placeholder species as elements: ``elements`` is (structure_id, species, element); others stay."""
    rows = sites.join(elements, ["structure_id", "species"], "left")
    return rows.withColumn("species", F.coalesce("element", "species")).drop("element")


def propagated(target: DataFrame, source: DataFrame, name: str, digits: int = 6) -> DataFrame:
    """``target`` with a property of the ``source`` site at the same rounded coordinates.

    A target site without a source site fails, as does a property that
    both have with different values.
    """
    keys = [F.bround(F.col(x) - F.floor(x), digits).alias(f"__{x}") for x in ("fx", "fy", "fz")]
    on = ["structure_id", "__fx", "__fy", "__fz"]
    have = source.select("structure_id", *keys, F.col(name).alias("__new"), F.lit(True).alias("__found"))
    rows = target.select("*", *keys).join(have, on, "left")
    missing = F.assert_true(F.coalesce("__found", F.lit(False)), F.lit("a site has no counterpart")).isNull()
    rows = rows.where(missing)
    if name in target.columns:
        same = F.col(name).isNull() | F.col("__new").isNull() | F.col(name).eqNullSafe(F.col("__new"))
        rows = rows.where(F.assert_true(same, F.lit("a property differs")).isNull())
        value = F.coalesce(F.col(name), F.col("__new"))
    else:
        value = F.col("__new")
    return rows.withColumn(name, value).drop("__new", "__found", "__fx", "__fy", "__fz")


def reduced_formula(counts: dict[str, int]) -> str:
    """Element counts over their greatest common divisor, elements in alphabetical order."""
    from math import gcd

    divisor = gcd(*counts.values()) or 1
    return "".join(f"{e}{n // divisor if n // divisor > 1 else ''}" for e, n in sorted(counts.items()) if n)


def disordered_site(allowed: list[str], labels: list[str]) -> dict[str, float]:
    """Uniform fractions of a site's allowed species and labels together."""
    names = sorted({*allowed, *labels})
    if not names:
        raise ValueError("a site without species")
    return dict.fromkeys(names, 1 / len(names))

"""Document-store semantics on DataFrames: unique lookups, least-force energies, upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def projected(docs: DataFrame, criteria: Column, fields: Sequence[str]) -> DataFrame:
    """Rows that meet the criteria, with the named fields only; both reach the scan."""
    return docs.where(criteria).select(*fields)


def lookup_unique(docs: DataFrame, criteria: Column) -> Row | None:
    """The one row that meets the criteria, None if there is none; two raise LookupError."""
    rows = docs.where(criteria).limit(2).collect()
    if len(rows) > 1:
        raise LookupError("more than one row meets the criteria")
    return rows[0] if rows else None


def exists_unique(docs: DataFrame, criteria: Column) -> bool:
    return lookup_unique(docs.select("*"), criteria) is not None


def duplicates(docs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of the keys that more than one row has; empty if the key is unique."""
    return docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def least_force(docs: DataFrame, key: Sequence[str], force: str, energy: str) -> DataFrame:
    """(key..., force, energy, ties): the energy at the least force of each key.

    Rows without a force or an energy don't count. ``ties`` is how many rows
    have the least force; the energy is null where that isn't one, since a tie
    is an error and no row is picked.
    """
    rows = docs.where(F.col(force).isNotNull() & F.col(energy).isNotNull())
    low = rows.groupBy(*key).agg(F.min(force).alias(force))
    hit = rows.join(low, [*key, force]).groupBy(*key, force).agg(F.count("*").alias("ties"), F.min(energy).alias(energy))
    return hit.withColumn(energy, F.when(F.col("ties") == 1, F.col(energy)))


def converged(tasks: DataFrame, calc, max_force: bool = True) -> DataFrame:
    """Tasks that a calculator's settings accept.

    ``tasks``: calculator, relax_type, spin_type, frozen_sublattices, max_force,
    is_force_converged, energy. A machine-learned calculator has no spin, so
    its tasks are nonmagnetic ones, and they must have converged; the largest
    force must lie below the setting.
    """
    learned = calc.name == "MACE-MPA-0"
    ok = (F.col("calculator") == calc.calculator) & (F.col("relax_type") == calc.relax_type)
    ok &= F.col("spin_type") == ("nonmagnetic" if learned else calc.spin_type)
    ok &= F.coalesce("frozen_sublattices", F.lit("")) == calc.frozen_sublattices
    ok &= F.col("energy").isNotNull() & F.col("max_force").isNotNull()
    if max_force:
        ok &= F.col("max_force") < calc.max_force_eV_per_A
    return tasks.where(ok & F.coalesce("is_force_converged", F.lit(False)) if learned else ok)


def energies_of(tasks: DataFrame, calc) -> DataFrame:
    """(occ_key, energy): of each structure's accepted tasks the one of least force; a tie fails."""
    return without_ties(least_force(converged(tasks, calc), ["occ_key"], "max_force", "energy")).select("occ_key", "energy")


def without_ties(found: DataFrame) -> DataFrame:
    """``found``, failing where a least force is shared."""
    return found.where(F.assert_true(F.col("ties") == 1, F.lit("two rows have the least force")).isNull())


def first_per_key(docs: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return docs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def whole_row(rows: DataFrame) -> Column:
    """A row as text: the order among rows that nothing else tells apart."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})


def tips(blocks: DataFrame, chain: str, step: str) -> DataFrame:
    """The latest block of each chain; of equal steps the first as text."""
    return first_per_key(blocks, [chain], [F.desc(step), whole_row(blocks)])


def first_matching(blocks: DataFrame, chain: str, step: str, criteria: Column) -> DataFrame:
    """The earliest block of each chain that is large enough; of equal steps the first as text."""
    return first_per_key(blocks.where(criteria), [chain], [step, whole_row(blocks)])


def new_only(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, of each key the first as text, whose key isn't stored yet."""
    return first_per_key(rows, key, [whole_row(rows)]).join(existing.select(*key).distinct(), list(key), "left_anti")


def homogeneity(docs: DataFrame, fields: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group..., distinct_values, homogeneous) for each group's tuple of fields; nulls are values."""
    packed = F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("\u0000null")).alias(f) for f in fields))
    n = docs.groupBy(*group).agg(F.count_distinct(packed).alias("distinct_values"))
    return n.withColumn("homogeneous", F.col("distinct_values") == 1)


def after_anchor(path: Column, anchor: str) -> Column:
    """The path from the anchor on; null where it is absent."""
    at = F.instr(path, anchor)
    return F.when(at > 0, F.substring(path, at, F.length(path)))


def delete_preview(docs: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """(criterion, n): how many rows each criterion would delete, in one pass."""
    counts = docs.agg(*(F.count_if(c).alias(name) for name, c in criteria.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("criterion"), F.col(name).alias("n")) for name in criteria))
    return counts.select(F.explode(pairs).alias("p")).select("p.criterion", "p.n")


def deleted(docs: DataFrame, criteria: Column) -> DataFrame:
    """What is left after a deletion: rows for which the criteria aren't true."""
    return docs.where(~F.coalesce(criteria, F.lit(False)))


def progressive_counts(docs: DataFrame, criteria: Sequence[tuple[str, Column]]) -> DataFrame:
    """(criterion, n): rows left as criteria are added one by one, to see which one empties a lookup."""
    so_far = F.lit(True)
    steps = {}
    for name, c in criteria:
        so_far = so_far & c
        steps[name] = so_far
    return delete_preview(docs, steps)


def gated(docs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``docs`` with ``failed``, the names of the checks that a row doesn't pass, in the order of ``checks``; null counts as failed."""
    failed = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, c in checks.items()))
    return docs.withColumn("failed", F.array_compact(failed))


def gate(docs: DataFrame, checks: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """(key..., failed) of all rows that fail: the report of a quality gate, instead of an error at the first row."""
    return gated(docs, checks).where(F.size("failed") > 0).select(*key, "failed")


def convergence_checks(calc) -> dict[str, Column]:
    """What a calculator's settings ask of a relaxed structure: an energy, a force, one below
    the limit, and the flag of convergence where the calculator gives one."""
    learned = calc.name == "MACE-MPA-0"
    return {
        "energy": F.col("energy").isNotNull() & ~F.isnan("energy"),
        "force": F.col("max_force").isNotNull() & ~F.isnan("max_force"),
        "force below the limit": F.col("max_force") < calc.max_force_eV_per_A,
        "converged": F.coalesce("is_force_converged", F.lit(not learned)),
    }


#: A training reference as a record: what it is made of, what it is, how it was computed.
REFERENCE = "composition_map map<string,map<string,bigint>>, occ_key string, calc_spec struct<calculator:string,relax_type:string,spin_type:string,max_force_eV_per_A:double,frozen_sublattices:string>"


def reference_documents(refs: DataFrame) -> DataFrame:
    """``refs`` (REFERENCE columns, ...) with these columns as one JSON text, ``document``."""
    names = [c.split(" ", 1)[0] for c in REFERENCE.split(", ")]
    return refs.withColumn("document", F.to_json(F.struct(*names))).drop(*names)


def parsed_references(docs: DataFrame) -> DataFrame:
    """``docs`` with the record that each ``document`` holds, instead of it. A document that isn't
    one, or lacks its key, composition or calculator, fails."""
    rows = docs.withColumn("__r", F.from_json("document", REFERENCE))
    whole = F.col("__r.occ_key").isNotNull() & F.col("__r.composition_map").isNotNull() & F.col("__r.calc_spec.calculator").isNotNull()
    rows = rows.where(F.assert_true(F.coalesce(whole, F.lit(False)), F.concat(F.lit("no training reference: "), F.coalesce("document", F.lit("null")))).isNull())
    return rows.select(*(c for c in docs.columns if c != "document"), "__r.*")

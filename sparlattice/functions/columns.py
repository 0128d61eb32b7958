"""Column functions: parsing, canonical forms, content hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"^([A-Z]\d+)([A-Z][a-z]{0,2})$"


def items(text: Column, separator: str = ",") -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def parsed_counts(text: Column) -> Column:
    """``"Fe:54,Mn:46"`` as array<struct<element, n>> sorted by element.

    Fails on a part without a colon, an empty element, a count that is no
    number or negative, an element twice, and no parts.
    """
    parts = items(text)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("element"), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).cast("long").alias("n")))
    good = (F.size(parts) > 0) & ~F.exists(parts, lambda p: ~p.rlike(r"^[^:]*[^:\s][^:]*:\s*\d+$")) & (F.size(F.array_distinct(F.transform(pairs, lambda x: x["element"]))) == F.size(pairs))
    return F.when(F.coalesce(good, F.lit(False)), F.array_sort(pairs)).otherwise(F.raise_error(F.concat(F.lit("bad counts: "), F.coalesce(text, F.lit("null")))).cast("array<struct<element:string,n:bigint>>"))


def parsed_cutoffs(text: Column) -> Column:
    """``"2:10,3:8"`` as array<struct<order_, radius>> sorted by order; the last of equal orders holds."""
    pairs = F.transform(items(text), lambda p, i: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("order_"), i.alias("at"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("radius")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["order_"] == p["order_"]) & (q["at"] > p["at"])))
    return F.transform(F.array_sort(last), lambda p: F.struct(p["order_"].alias("order_"), p["radius"].alias("radius")))


def parsed_comp_map(text: Column) -> Column:
    """``"Es:{Mg:16},Fm:{Al:32}"`` as array<struct<sublattice, counts>>, sorted."""
    names = F.regexp_extract_all(text, F.lit(r"([^,{}:]+):\{([^}]*)\}"), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(r"([^,{}:]+):\{([^}]*)\}"), F.lit(2))
    return F.array_sort(F.zip_with(names, inner, lambda s, c: F.struct(F.trim(s).alias("sublattice"), parsed_counts(c).alias("counts"))))


def counts_sig(pairs: Column) -> Column:
    """``Fe:10,Mg:98`` from array<struct<element, n>>, in the order of elements."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["element"], F.lit(":"), p["n"].cast("string"))), ",")


def comp_map_sig(sublattices: Column) -> Column:
    """``B:{Mg:108},Es:{Fe:108}`` from array<struct<sublattice, sig>>."""
    return F.array_join(F.transform(F.array_sort(sublattices), lambda s: F.concat(s["sublattice"], F.lit(":{"), s["sig"], F.lit("}"))), ",")


def quantised(x: Column, scale: int = 10**10) -> Column:
    """Nearest integer of x * scale, half to even, wrapped to [0, scale)."""
    return F.pmod(F.rint(x * F.lit(float(scale))).cast("long"), F.lit(scale))


def occ_hash(occupancy: Column) -> Column:
    """SHA-256 over the low bytes of an occupancy."""
    low = F.transform(occupancy, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255)).cast("long")), 2, "0"))
    return F.sha2(F.unhex(F.array_join(low, "")), 256)


def calculator_name(text: Column) -> Column:
    return F.trim(F.substring_index(text, ";", 1))


def calculator_model(text: Column) -> Column:
    """What stands behind the first semicolon; null if nothing does."""
    at = F.instr(text, ";")
    return F.nullif(F.when(at > 0, F.trim(F.substring(text, at + 1, F.length(text)))), F.lit(""))


def frozen_valid(text: Column) -> Column:
    """Whether a comma list is trimmed, sorted and without repeats already."""
    return F.array_join(F.array_sort(F.array_distinct(items(text))), ",") == text


def token_parts(token: Column) -> tuple[Column, Column]:
    """(tag, element) of a prototype token such as ``Q0O``; empty strings if it is none."""
    return F.regexp_extract(token, TOKEN, 1), F.regexp_extract(token, TOKEN, 2)


def in_milli(x: Column) -> Column:
    """A value in thousandths with three decimals."""
    return F.format_string("%.3f", x * 1000.0)


def dot(features: Column, coefficients: list[float]) -> Column:
    """The scalar product with fixed coefficients."""
    weights = F.array(*(F.lit(float(c)) for c in coefficients))
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def json_double(x: Column) -> Column:
    """A double as JSON text with the fewest digits that give it back: plain from 1e-4 to below
    1e16, else with an exponent of two digits or more; null, NaN and infinities as JSON writers name them.

    The virtual machine may write a digit too many; a shorter text that still
    gives the number back is taken instead. From 1e16 on the last digit may be
    another one than the nearest, in some numbers.
    """

    def decimal(said: Column) -> Column:
        """Significant digits of a positive number's text, and the power of ten of the first one."""
        mantissa = F.substring_index(said, "E", 1)
        shift = F.when(F.instr(said, "E") > 0, F.substring_index(said, "E", -1).cast("int")).otherwise(0)
        digits = F.regexp_replace(mantissa, "[.]", "")
        return F.struct(F.regexp_replace(F.regexp_replace(digits, "^0+(?=.)", ""), "(?<=.)0+$", "").alias("d"), (shift + F.instr(mantissa, ".") - 2 - F.length(F.regexp_extract(digits, "^0*", 0))).alias("p"), said.cast("double").alias("x"))

    def shortest(r: Column) -> Column:
        n = F.length(r["d"])

        def given(digits: Column) -> Column:
            return F.concat(digits, F.lit("E"), (r["p"] - n + 2).cast("string")).cast("double") == r["x"]

        down = F.substring(r["d"], F.lit(1), n - 1)
        up = (down.cast("decimal(20,0)") + 1).cast("string")
        digits = F.when((n > 2) & given(down), down).when((n > 2) & (F.length(up) == n - 1) & given(up), up).otherwise(r["d"])
        return F.struct(F.regexp_replace(digits, "(?<=.)0+$", "").alias("d"), r["p"].alias("p"))

    def written(r: Column) -> Column:
        digits, power, size = r["d"], r["p"], F.length(r["d"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))
        inside = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size))
        rest = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit(""))
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        scientific = F.concat(F.substring(digits, 1, 1), rest, exponent)
        return F.when((power < -4) | (power >= 16), scientific).when(power < 0, small).when(size <= power + 1, whole).otherwise(inside)

    def text(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        number = _let(_let(_let(F.abs(v).cast("string"), decimal), shortest), written)
        return F.when(v.isNull(), "null").when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(v == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, number))

    return _let(x, text)


def json_list(values: Column, said: Callable[[Column], Column] = lambda v: v.cast("string")) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, said), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """An object of JSON texts, fields in the order of their names, without white space."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_text(x: Column) -> Column:
    """A text in quotes; keys are hexadecimal, so that nothing needs escapes: others fail."""
    plain = F.assert_true(x.rlike("^[ !#-\\[\\]-~]*$"), F.concat(F.lit("a text that needs escapes: "), x)).isNull()
    return F.when(plain, F.concat(F.lit('"'), x, F.lit('"')))


def block_key(wl_key: Column, parent: Column, state: Column, occupancy: Column) -> Column:
    """The identity of a block: SHA-256 of the canonical JSON of its chain, its parent, its state
    (canonical JSON already) and its occupancy. Fixed values: the names of the fields."""
    payload = {"wl_key": json_text(wl_key), "parent_wl_block_key": json_text(parent), "state": state, "occupancy": json_list(occupancy)}
    return F.sha2(json_object(payload), 256)

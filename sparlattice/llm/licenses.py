"""Operator 7: licence scans, with DataFrame functions alone.

A text is one sequence of normalised words. Windows of as many words as a
template, each beginning with one of the template's word bigrams, are compared
with it by the Dice coefficient of their sets of bigrams, wherever lines break
and whatever stands before and behind. The bigrams that a text shares with any
template are found once; templates of which it has too few for their size
bounds are pruned, and so are windows of too few or too many distinct bigrams.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES

#: Dice coefficient from which a window is a licence statement, in hundredths.
PERCENT = 80


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Fewest and most bigrams of a set whose Dice coefficient with one of ``n`` can reach the threshold."""
    low = Fraction(n * percent, 200 - percent)
    high = Fraction(n * (200 - percent), percent)
    return -(-low.numerator // low.denominator), high.numerator // high.denominator


def _literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_licenses (templates that a window reaches), license and dice of the best one.

    The best has the greatest coefficient; of equals, the template's name that
    comes last. Without one license and dice are null; null and empty texts
    have none. Repeated rows give repeated results.
    """
    sets = {name: bigrams_of(text) for name, text in templates.items()}
    bounds = {name: size_bounds(len(s), percent) for name, s in sets.items()}
    fewest = min(b[0] for b in bounds.values())
    every = _literals(sorted({b for s in sets.values() for b in s}))

    def best_window(grams: Column, name: str) -> Column:
        own, n = _literals(sets[name]), len(sets[name])
        low, high = bounds[name]
        width = len(words_of(templates[name])) - 1

        def dice(window: Column) -> Column:
            shared = F.size(F.array_intersect(window, own))
            size = F.size(window)
            return F.when(size.between(low, high) & (200 * shared >= percent * (size + n)), 2.0 * shared / (size + n))

        starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(own, F.get(grams, i - 1)))
        return F.array_max(F.transform(F.transform(starts, lambda i: F.array_distinct(F.slice(grams, i, F.lit(width)))), dice))

    def found(grams: Column, common: Column) -> Column:
        """The templates of which ``common``, what the text shares with all of them, has enough."""

        def one(name: str) -> Column:
            enough = F.size(F.array_intersect(common, _literals(sets[name]))) >= bounds[name][0]
            return F.struct(F.when(enough, best_window(grams, name)).alias("dice"), F.lit(name).alias("license"))

        return F.filter(F.array(*(one(name) for name in sorted(sets))), lambda x: x["dice"].isNotNull())

    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    # A value that is used more than once is the variable of a function, so that it is made once.
    grams = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    shared = F.transform(grams, lambda g: F.struct(g.alias("g"), F.array_intersect(g, every).alias("c")))
    hits = F.transform(shared, lambda x: F.when(F.size(x["c"]) >= fewest, found(x["g"], x["c"])))[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", hits.alias("hits"))
    top = F.array_max("hits")
    return rows.select("doc_id", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_licenses"), top["license"].alias("license"), F.round(top["dice"], 6).alias("dice"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def row(name: str, text: str) -> str:
        grams = bigrams_of(text)
        return f"({quoted(name)}, [{', '.join(map(quoted, grams))}], {len(words_of(text)) - 1}, {size_bounds(len(grams), percent)[0]})"

    return f"""
WITH templates(license, own, width, low) AS (VALUES {", ".join(row(n, t) for n, t in templates.items())}),
worded AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
grams AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded),
candidates AS (SELECT doc_id, g, license, own, width FROM grams CROSS JOIN templates WHERE len(list_intersect(list_distinct(g), own)) >= low),
windows AS (
  SELECT doc_id, license, own, list_distinct(g[i : i + width - 1]) AS v
  FROM (SELECT *, unnest(list_filter(range(1, len(g) + 1), lambda i: list_contains(own, g[i]))) AS i FROM candidates)),
scored AS (SELECT doc_id, license, len(list_intersect(v, own)) AS shared, len(v) + len(own) AS both FROM windows),
hits AS (SELECT doc_id, license, max(2.0 * shared / "both") AS dice FROM scored WHERE 200 * shared >= {percent} * "both" GROUP BY doc_id, license),
best AS (SELECT doc_id, count(*) AS n_licenses, max(struct_pack(dice := dice, license := license)) AS top FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, top.license AS license, round(CAST(top.dice AS DOUBLE), 6) AS dice
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""

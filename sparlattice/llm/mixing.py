"""Operator 11: mixing sources to target weights, with DataFrame functions alone.

Every document gets a random key, a hash of its id and text. Within each source
documents are ordered by key; keys are cut into pieces of equal width, so that
words before a document are those of earlier pieces plus those of smaller keys
of its own piece: prefix sums in two levels, of about the root of the number of
rows each. A source's budget is so many whole epochs of it and a rest, which is
cut exactly where the prefix sum reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Weights of the sources in order, repeating. Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
#: How often a source may be repeated at most.
MOST_EPOCHS = 3
#: Bits of the random keys.
KEY_BITS = 60
#: Most sources whose plans, one row a source, are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def random_key(seed: int, *parts: Column) -> Column:
    """A number of ``KEY_BITS`` bits from the md5 of the seed and some texts; a null part differs from an empty one."""
    said = [F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *said)), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with two columns more, ``mix_size`` (words, 0 for a null text) and ``mix_key``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("mix_size", size).withColumn("mix_key", random_key(seed, F.col("doc_id").cast("string"), F.md5("text")))


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` times its source.

    ``totals``: (source, source_size). Sources in the order of their code points,
    null last, take the weights in turn. Targets are min(cap, level * weight) with one
    level for all: a source is capped if even at the level that fills it all
    targets together stay below the words wanted. One row a source is sorted in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("__w", weight).withColumn("__cap", (F.lit(most) * F.col("source_size")).cast("double"))
    rows = rows.withColumn("__full_at", F.col("__cap") / F.col("__w"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("__full_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__want", F.sum("source_size").over(everything).cast("double") * F.lit(float(share))).withColumn("__all_w", F.sum("__w").over(everything))
    filled = F.sum("__cap").over(so_far) + F.col("__full_at") * (F.col("__all_w") - F.sum("__w").over(so_far))
    rows = rows.withColumn("__capped", filled < F.col("__want"))
    capped = F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(everything), F.lit(0.0))
    free_w = F.sum(F.when(~F.col("__capped"), F.col("__w"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.least("__cap", (F.col("__want") - capped) * F.col("__w") / free_w))
    return rows.select("source", "source_size", target.alias("target"))


def pieces_for(rows: int) -> int:
    """Bits of a key that number its piece: about as many pieces as rows of a piece."""
    return min(KEY_BITS, max(1, (max(1, rows).bit_length() + 1) // 2))


def allotments(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words, cut_size): how each source is mixed.

    ``rows``: (source, mix_size, mix_key). All documents are taken ``epochs``
    times; once more those whose key is below ``cut_key``, and of those at it, with
    ``cut_size`` words together, ``cut_words``. A budget is the target's nearest integer.
    """
    bits = pieces_for(rows.count())
    at_key = rows.groupBy("source", F.shiftright("mix_key", KEY_BITS - bits).alias("piece"), "mix_key").agg(F.sum("mix_size").alias("words"))
    per_piece = at_key.groupBy("source", "piece").agg(F.sum("words").alias("piece_words"))
    totals = rows.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    plan = targets(totals, weights, most, share)
    budget = F.rint("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(rint(target) AS BIGINT) div source_size")).otherwise(F.lit(0)).cast("long")
    plan = checkpointed(plan.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    # The piece in which the rest runs out, and the words before it.
    in_order = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = per_piece.withColumn("before", F.coalesce(F.sum("piece_words").over(in_order), F.lit(0)))
    rest = plan.select(F.col("source").alias("s"), "rest")
    before = before.join(rest, before["source"].eqNullSafe(F.col("s"))).select("source", "piece", "before", "rest")
    # Prefix sums within the pieces; the key at which the rest runs out.
    sorted_keys = Window.partitionBy("source", "piece").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = at_key.withColumn("inside", F.coalesce(F.sum("words").over(sorted_keys), F.lit(0)))
    b = before.select(F.col("source").alias("s"), F.col("piece").alias("p"), "before", "rest")
    placed = inside.join(b, inside["source"].eqNullSafe(F.col("s")) & (inside["piece"] == F.col("p")))
    first = F.col("before") + F.col("inside")
    cut = placed.where((first <= F.col("rest")) & (F.col("rest") < first + F.col("words")))
    cut = cut.select(F.col("source").alias("s"), F.col("mix_key").alias("cut_key"), (F.col("rest") - first).alias("cut_words"), F.col("words").alias("cut_size"))
    return plan.join(cut, plan["source"].eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size")


def allotted(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with mix_size, source_size, target, epochs and taken: how many words of each document the mix takes.

    ``docs``: (doc_id, text, source, ...). A document is taken ``epochs`` times
    whole, and once more if the rest of its source's budget reaches it in random order; the one at
    the cut gives only as many words as the budget lacks, so that a source's
    words are its target to the word. Rows of one id and text are alike: at the
    cut they share what is left by size, down to whole words. Null texts have no words; a
    null source is a source of its own; rows without words take none. The same rows give the same mix,
    however they are partitioned. Columns of these names in ``docs`` are replaced.
    """
    names = ["mix_size", "mix_key", "source_size", "target", "epochs", "taken"]
    rows = sized(docs.drop(*names), seed)
    if set(rows.columns) - {"text"} <= {"doc_id", "source", "mix_size", "mix_key"}:
        rows = checkpointed(rows.drop("text"))  # narrow: the texts are read once
    plan = checkpointed(allotments(rows.select("source", "mix_size", "mix_key"), weights, most, share))
    each = plan.withColumnRenamed("source", "__source")
    if plan.count() <= BROADCAST_SOURCES:
        each = F.broadcast(each)
    out = rows.join(each, rows["source"].eqNullSafe(F.col("__source")))
    key, cut, size = F.col("mix_key"), F.col("cut_key"), F.col("mix_size")
    # The product is exact in decimals, however many words there are.
    at_cut = F.expr("CAST((CAST(mix_size AS DECIMAL(19, 0)) * CAST(cut_words AS DECIMAL(19, 0))) div cut_size AS BIGINT)")
    once_more = F.when(cut.isNull() | (key > cut), F.lit(0)).when(key < cut, size).otherwise(at_cut)
    out = out.withColumn("taken", F.col("epochs") * size + once_more)
    return out.drop("__source", "cut_key", "cut_words", "cut_size", "mix_key")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The mix itself: columns of ``docs`` with ``epoch`` from 0 and ``words``, a row for each time a document is taken.

    ``text`` ends behind the first ``words`` words where the budget cuts a document.
    Texts aren't shuffled: plans of one row a source come to them.
    """
    rows = allotted(docs, weights, most, share, seed)
    whole = F.when(F.col("mix_size") > 0, F.ceil(F.col("taken") / F.col("mix_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))))
    words = F.least("mix_size", F.col("taken") - F.col("epoch") * F.col("mix_size"))
    # Each part is a word behind its white space.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")
    text = F.when(words == F.col("mix_size"), F.col("text")).otherwise(head)
    return rows.withColumn("words", words.cast("long")).withColumn("text", text).drop("mix_size", "source_size", "target", "epochs", "taken")


def mix_sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    rows = allotted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), seed=seed)
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


def oracle_sql(weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> str:
    digits = KEY_BITS // 4
    weight = " ".join(f"WHEN {i} THEN {w!r}" for i, w in enumerate(weights))
    return rf"""WITH rows AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
 CAST('0x' || substr(md5('{seed}:' || coalesce('=' || doc_id, '-') || ':' || coalesce('=' || md5(text), '-')), 1, {digits}) AS BIGINT) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, CAST({most} * source_size AS DOUBLE) AS cap, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {weight} END AS w FROM totals),
levels AS (SELECT *, cap / w AS full_at, CAST(sum(source_size) OVER () AS DOUBLE) AS want, sum(w) OVER () AS all_w FROM weighed),
filled AS (SELECT *, sum(cap) OVER (ORDER BY full_at) + full_at * (all_w - sum(w) OVER (ORDER BY full_at)) < want AS capped FROM levels),
shared AS (SELECT *, coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0.0) AS held, sum(w) FILTER (WHERE NOT capped) OVER () AS free_w FROM filled),
aimed AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (want - held) * w / free_w) END AS target FROM shared),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // source_size ELSE 0 END AS epochs FROM aimed),
keys AS (SELECT source, key, sum(size) AS words FROM rows GROUP BY ALL),
prefixes AS (SELECT source, key, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys),
placed AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, k.words, k.before, CAST(round_even(p.target, 0) AS BIGINT) - p.epochs * p.source_size AS rest
 FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source JOIN prefixes k ON r.source IS NOT DISTINCT FROM k.source AND r.key = k.key)
SELECT doc_id, size, source_size, target, CAST(epochs * size + CASE WHEN before >= rest THEN 0 WHEN before + words <= rest THEN size ELSE size * (rest - before) // words END AS BIGINT) AS taken FROM placed"""

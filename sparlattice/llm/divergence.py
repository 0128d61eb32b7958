"""Operator 13: how far the sources of a language differ in their words.

Tasks cut texts into terms with Arrow's own functions and group them into
partial counts. Spark adds these up, keeps the terms with enough documents and
deals them into shards of bounded size; a shard is a columnar table of counts,
turned into a matrix of shares in which divergences are whole-array operations.
All arithmetic is exact, in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Characters that part terms: all of ASCII but its letters. Fixed value.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term has at least.
LEAST_DOCUMENTS = 3
#: Shares are counted in units of this part of the whole.
UNITS = 1_000_000_000
#: Terms of a group that part ``term`` reports.
REPORTED = 200
#: Bytes of text that are cut at a time (or one longer text).
PIECE_BYTES = 4 << 20
#: Partial counts that a task holds before it hands them on.
HELD_COUNTS = 400_000
#: Counts of a shard.
SHARD_COUNTS = 100_000


def term_counts(batch: pa.Table) -> pa.Table:
    """(lang, source, term, n, docs) of some rows (lang, source, text) without nulls."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").combine_chunks()), pattern=BETWEEN)
    doc, term = pc.list_parent_indices(words), pc.list_flatten(words)
    filled = pc.not_equal(term, "")
    doc, term = doc.filter(filled), term.filter(filled).dictionary_encode()
    groups = pc.binary_join_element_wise(batch.column("lang"), batch.column("source"), "\x00").combine_chunks().dictionary_encode()
    by_doc = pa.table([doc, term.indices], names=["doc", "code"]).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    by_doc = by_doc.append_column("group", groups.indices.take(by_doc.column("doc")))
    out = by_doc.group_by(["group", "code"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    first = pa.table([groups.indices, pa.array(np.arange(batch.num_rows))], names=["g", "row"]).group_by("g", use_threads=False).aggregate([("row", "min")])
    row = np.zeros(len(groups.dictionary), dtype=np.int64)
    row[first.column("g").to_numpy()] = first.column("row_min").to_numpy()
    rows = pa.array(row[out.column("group").to_numpy()])
    columns = [batch.column("lang").take(rows), batch.column("source").take(rows), term.dictionary.take(out.column("code")), out.column("count_all_sum"), out.column("count_all")]
    return pa.table([*(c.cast(pa.string()) for c in columns[:3]), *(c.cast(pa.int64()) for c in columns[3:])], names=["lang", "source", "term", "n", "docs"])


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Rows of a batch, about ``PIECE_BYTES`` of text at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, "right")))
        yield pa.table(batch.columns, names=["lang", "source", "text"]).slice(at, stop - at)
        at = stop


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    fresh = 0
    for batch in batches:
        for piece in _pieces(batch):
            held.append(term_counts(piece))
            fresh += held[-1].num_rows
            if fresh >= HELD_COUNTS:
                held = [_merged(held)]
                fresh = 0
                if held[0].num_rows >= HELD_COUNTS:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=50_000)
    if held:
        yield from _merged(held).combine_chunks().to_batches(max_chunksize=50_000)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in the texts of a group, and rows that hold it."""
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = filled.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that ``least`` documents of the language hold.

    ``lang_n``: occurrences in the language; ``first``: true once a term. A
    window holds a term's counts by source, whose number the language's sources bound.
    """
    of_term = Window.partitionBy("lang", "term")
    rows = counts.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("__docs", F.sum("docs").over(of_term))
    rows = rows.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    return rows.where(F.col("__docs") >= least).drop("docs", "__docs")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNITS * (count + 1) / total) for totals below 9e15: long division, three digits a step."""
    whole, left = np.divmod(count + 1, total)
    for _ in range(3):
        digits, left = np.divmod(left * 1_000, total)
        whole = whole * 1_000 + digits
    return whole + 1


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most UNITS + 1, so that squares fit."""
    d = p - q
    return d * d // q


def pair_sums(present: np.ndarray, p: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """For each two sources g, h the sum over terms of ``_gain(p of g, p of h)``.

    ``present``: terms by sources; ``p``: their shares; ``absent``: each source's
    share of a term that it lacks. Terms that both lack are counted, not computed.
    """
    sums = np.zeros((len(absent), len(absent)), dtype=np.int64)
    has = present.astype(np.int64)
    both_lack = len(p) - (has.sum(axis=0)[:, None] + has.sum(axis=0)[None, :] - has.T @ has)
    for g in range(len(absent)):
        own = np.flatnonzero(present[:, g])
        sums[g] += _gain(p[own, g][:, None], p[own]).sum(axis=0)
        # Terms of g as the other side of sources that lack them.
        sums[:, g] += (_gain(absent[None, :], p[own, g][:, None]) * ~present[own]).sum(axis=0)
    return sums + both_lack * _gain(absent[:, None], absent[None, :])


#: Cells of a shard's matrix that are in memory at a time.
CELLS = 1_000_000


def _diverging(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Values of one shard of a language: (lang, source, part, item, value).

    ``counts``: (source, term, n, lang_n); ``groups``: a row for each source of the
    language (source, total, kept, lang_total). Part ``pair``: sums over the shard's terms;
    part ``term``: of each source the ``REPORTED`` terms of most value, and those equal to the last.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not counts.num_rows or not groups.num_rows:
        return schema.empty_table()
    groups = groups.sort_by("source")
    lang, names = groups.column("lang")[0].as_py(), groups.column("source").combine_chunks()
    kept = int(groups.column("kept")[0].as_py())
    totals = groups.column("total").to_numpy() + kept
    lang_total = groups.column("lang_total").to_numpy()[:1] + kept
    source = pc.index_in(counts.column("source").combine_chunks(), value_set=names).to_numpy()
    encoded = counts.column("term").combine_chunks().dictionary_encode()
    term, n, lang_n = encoded.indices.to_numpy(), counts.column("n").to_numpy(), counts.column("lang_n").to_numpy()
    p = shares(n, totals[source])
    q = shares(lang_n, lang_total)
    absent = shares(np.zeros_like(totals), totals)
    order = np.argsort(term, kind="stable")
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    step = max(1, CELLS // len(names))
    bounds = np.searchsorted(term[order], np.arange(0, len(encoded.dictionary) + step, step))
    for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own, size = order[i:j], min(step, len(encoded.dictionary) - k * step)
        if size > 0:
            present = np.zeros((size, len(names)), dtype=bool)
            block = np.repeat(absent[None, :], size, axis=0)
            present[term[own] - k * step, source[own]] = True
            block[term[own] - k * step, source[own]] = p[own]
            sums += pair_sums(present, block, absent)
    g, h = np.nonzero(~np.eye(len(names), dtype=bool))
    value, more = _gain(p, q), np.flatnonzero(p > q)
    chosen = []
    for s in np.unique(source[more]).tolist():
        own = more[source[more] == s]
        if len(own) > REPORTED:
            least = np.partition(value[own], len(own) - REPORTED)[len(own) - REPORTED]
            own = own[value[own] >= least]
        chosen.append(own)
    best = np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64)
    sources = pa.concat_arrays([names.take(pa.array(g)), names.take(pa.array(source[best]))])
    items = pa.concat_arrays([names.take(pa.array(h)), encoded.dictionary.take(pa.array(term[best]))])
    parts = pa.array(["pair"] * len(g) + ["term"] * len(best), pa.string())
    values = pa.array(np.concatenate([sums[g, h], value[best]]), pa.int64())
    return pa.table([pa.array([lang] * len(values), pa.string()), sources, parts, items, values], schema=schema)


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, reported: int = REPORTED) -> DataFrame:
    """(lang, source, part, item, value, rank).

    ``docs``: (text, lang, source, ...), nulls as ''. Part ``pair``: of each
    (lang, source) group the divergence from every other source of the language.
    Part ``term``: the up to ``reported`` (at most ``REPORTED``) terms that the group has more of than its
    language. Ranks begin at 1 in each group and part, greatest value first, then items by
    their bytes. A group without terms has its pairs; a language of one source has none. Rows
    count each for themselves, repeated ones too. A task holds one shard, and of a language's pairs,
    which are part of the result, one row a pair.
    """
    if reported > REPORTED:
        raise ValueError(f"at most {REPORTED} terms a group")
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(kept_counts(counted(docs), least), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("__first"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_lang = Window.partitionBy("lang")
    groups = groups.join(sizes, ["lang", "source"], "left").fillna(0, ["total", "__first"])
    groups = groups.withColumn("kept", F.sum("__first").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang))
    groups = scratch.write(groups.drop("__first"), "term-groups")
    shards = max(1, -(-kept.count() // SHARD_COUNTS))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards))).drop("first")
    beside = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    schema = "lang string, source string, part string, item string, value long"
    values = dealt.groupBy("lang", "shard").cogroup(beside.groupBy("lang", "shard")).applyInArrow(_diverging, schema)
    values = scratch.write(values, "divergences")
    sums = values.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Every two sources of a language, with or without a kept term: rows of the result.
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = values.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= reported)
    return pairs.withColumn("rank", rank).unionByName(terms)


def oracle_sql(least: int = LEAST_DOCUMENTS, reported: int = REPORTED) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {least}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(c.n) AS total FROM counts c JOIN kept k USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({UNITS} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p,
 1 + CAST({UNITS} AS HUGEINT) * (k.n + 1) // (v.total + v.v) AS q
 FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
 LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
 FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {reported}"""

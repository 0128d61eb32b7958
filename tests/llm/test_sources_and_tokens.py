"""Operators 11 to 13 beside brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparlattice.llm import alignment, divergence, mixing, queries
from tests.llm.conftest import EDGES, WORD

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"

# ---- 11 ----


def plain_targets(sizes: dict, weights=mixing.WEIGHTS, most=3):
    """Shares by weight; what is above a cap is shared anew among the others, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = {s: w[s] for s in order if s not in capped}
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / sum(free.values()) for s in order}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return {s: float(x) for s, x in out.items()}
        capped |= over


def sources_of(n_words: dict) -> list:
    """Rows whose texts have so many words each, by source."""
    return [(1000 * k + i, " ".join(["w"] * n), s, "en", 0) for k, (s, sizes) in enumerate(n_words.items()) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("n_words", [
    {"b": [5] * 40, "a": [100] * 30, None: [7, 9], "c": [1] * 10, "": [50] * 3},
    {"a": [1], "b": [400] * 20, "c": [3, 0], "d": [0]},
    {"x": [20] * 25},
])
def test_mix_reaches_its_targets(spark, n_words):
    docs = spark.createDataFrame(sources_of(n_words), SCHEMA).repartition(5)
    got = mixing.mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {s: sum(v) for s, v in n_words.items()}
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: round(want[s]) for s in sizes}
    # Within a source whole documents are taken as often as each other, but for one more time and one cut.
    for s in sizes:
        own = [(r["taken"], r["size"]) for r in got if r["source"] == s and r["size"]]
        assert sum(t % n > 0 for t, n in own) <= 1 and (not own or max(t // n for t, n in own) - min(t // n for t, n in own) <= 1)


def test_mix_reruns_agree_and_depends_on_the_seed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs).collect()}
    assert one == {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs.repartition(7).orderBy(F.rand(3))).collect()}
    other = {r["doc_id"]: r["taken"] for r in mixing.allotted(docs.drop("n_chars"), seed=1).collect()}
    assert other != one and sum(other.values()) == pytest.approx(sum(one.values()), abs=40)


def test_mix_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(queries.oracle_sql()["op11_mixing"])
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.op11_mixing(spark, sf).collect()) == sorted(con.fetchall())


def test_mix_of_texts(spark):
    rows = sources_of({"a": [20_000, 11], "b": [90_000], "c": [4, 4, 4]}) + [(9, None, "b", "en", 0), (8, "  x\ty  ", "c", "en", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    allotted = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs).collect()}
    copies = defaultdict(list)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns[:1], *docs.columns[1:], "epoch", "words"] and dict(out.dtypes)["epoch"] == "int"
    for r in out.collect():
        assert len(WORD.findall(r["text"])) == r["words"]
        copies[r["doc_id"]].append((r["epoch"], r["words"]))
    assert {i: sum(n for _, n in c) for i, c in copies.items()} == {i: n for i, n in allotted.items() if n}
    assert all(sorted(e for e, _ in c) == list(range(len(c))) for c in copies.values())


def test_mix_edges(spark):
    rows = [(i, t, "s", "en", 0) for i, t in enumerate(EDGES)] * 2 + [(None, "no id here", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("taken", F.lit("clash")).withColumn("s", F.lit(1)).withColumn("p", F.lit(2)).withColumn("target", F.lit(None))
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["size"], r["taken"]))
    assert all(len(v) == 1 for i, v in by_id.items() if i is not None)  # repeated rows fare alike
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()
    assert mixing.mix_sizes(docs.where("text IS NULL")).agg(F.sum("taken")).first()[0] == 0
    assert len(mixing.allotted(docs).columns) == len(set(mixing.allotted(docs).columns))


def test_mix_runs_without_python_workers(spark, sf):
    plan = queries.op11_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


# ---- 12 ----

A_PATH, B_PATH = queries.tokenizer_path(queries.BYTE_TOKENIZER), queries.tokenizer_path(queries.PIECE_MODEL)
ODD_TEXTS = [" ", "  ", " a  b ", "▁x", "x ▁", "<0x41> <|endoftext|> <s> </s>", "a\0b\n\n \t é", "don't 12 345 Ⅷ²", "中文 😀😀  x", "Ᲊb 1Ꟍ's", "x" * 3_000, "​a‍b"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_tokens(text, libraries):
    """[(id, start, end)] of both sides by the libraries themselves; nothing where bytes differ."""
    if not text:
        return [], []
    a, b = libraries
    letters = alignment._byte_letters()
    said = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    other = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    sides = []
    for tokens in (said, other):
        if b"".join(t for _, t in tokens) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(t) for _, t in tokens]).tolist()
        sides.append([(i, e - len(t), e) for (i, t), e in zip(tokens, ends, strict=True)])
    return sides


def plain_links(a, b):
    owner = {at: j for j, (_, s, e) in enumerate(b) for at in range(s, e)}
    return [(i, j) for i, (_, s, e) in enumerate(a) for j in sorted({owner[at] for at in range(s, e)})]


def plain_groups(a, b):
    both = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for high in both:
        groups.append(tuple([i for i, s, e in side if low < e <= high] for side in (a, b)))
        low = high
    return groups


def check_documents(texts: dict, got: dict, libraries):
    sides = {i: plain_tokens(t, libraries) for i, t in texts.items()}
    links = {i: [(a[x][0], b[y][0]) for x, y in plain_links(a, b)] for i, (a, b) in sides.items()}
    documents = Counter(p for of in links.values() for p in set(of))
    best = {}
    for (a, _), n in documents.items():
        best[a] = max(best.get(a, 0), n)
    for i, (a, b) in sides.items():
        groups = plain_groups(a, b)
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want = (len(a), len(b), len(groups), len(links[i]), hashlib.sha256(said.encode()).hexdigest() if a else "", sum(documents[p] == best[p[0]] for p in links[i]), sum(documents[p] for p in links[i]))
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) == want, i


@pytest.mark.parametrize("links", [50, 3_000_000])
def test_alignment_equals_brute_force(spark, sf, monkeypatch, libraries, links):
    """With a small bound chunks hold one document each."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000 AND doc_id < 150").collect()}
    texts |= {10_000 + i: t for i, t in enumerate([*ODD_TEXTS, None, "", *ODD_TEXTS[:4]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    check_documents(texts, {r["doc_id"]: r for r in alignment.alignment_digests(docs, A_PATH, B_PATH).collect()}, libraries)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stdre \n\t.,!12é中😀▁<0x41>|ſß'"), max_size=40), min_size=1, max_size=4))
def test_alignment_of_odd_texts(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    libraries = a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    x = alignment.align(texts, alignment.byte_level(A_PATH, alignment.byte_level_classes(A_PATH)), alignment.pieces(B_PATH))
    for i, t in enumerate(texts):
        a, b = plain_tokens(t, libraries)
        of = x.doc_of_link == i
        assert x.a[x.bounds_a[i] : x.bounds_a[i + 1]].tolist() == [k for k, *_ in a]
        assert sorted(zip((x.link_a[of] - x.bounds_a[i]).tolist(), (x.link_b[of] - x.bounds_b[i]).tolist(), strict=True)) == plain_links(a, b)


def test_aligned_outputs_and_edges(spark, edge_docs, no_docs, libraries):
    for r in alignment.aligned(edge_docs.where("length(text) < 300 OR text IS NULL"), A_PATH, B_PATH).collect():
        a, b = plain_tokens(next((d["text"] for d in edge_docs.where("doc_id IS NOT NULL").collect() if d["doc_id"] == r["doc_id"]), "no id here"), libraries)
        assert (r["a"], r["b"]) == ([i for i, *_ in a], [i for i, *_ in b])
        assert list(zip(r["a_links"], r["b_links"], strict=True)) == plain_links(a, b)
        assert [([i for i, g in zip(r["a"], r["a_groups"], strict=True) if g == k], [i for i, g in zip(r["b"], r["b_groups"], strict=True) if g == k]) for k in range(max(r["a_groups"], default=-1) + 1)] == plain_groups(a, b)
    got = alignment.alignment_digests(edge_docs, A_PATH, B_PATH)
    assert got.count() == edge_docs.count() and alignment.alignment_digests(no_docs, A_PATH, B_PATH).count() == 0
    assert {(r["n_a"], r["count_sum"], r["groups_sha256"]) for r in got.where("doc_id IN (0, 1)").collect()} == {(0, 0, "")}


# ---- 13 ----

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_divergences(rows, least=3, reported=200):
    counts, holding, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, source, lang, _ in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOW))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holding[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in holding[lang].items() if n >= least]
        mates = sorted(s for la, s in groups if la == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in mates}

        def p(n, whole, v=len(kept)):
            return 1 + 10**9 * (n + 1) // (whole + v)

        def f(a, b):
            return (a - b) ** 2 // b

        pairs = [(o, sum(f(p(counts[lang, source][t], total[source]), p(counts[lang, o][t], total[o])) for t in kept)) for o in mates if o != source]
        of_lang = {t: sum(counts[lang, s][t] for s in mates) for t in kept}
        terms = []
        for t in kept:
            a, b = p(counts[lang, source][t], total[source]), p(of_lang[t], sum(total.values()))
            if counts[lang, source][t] and a > b:
                terms.append((t, f(a, b)))
        for part, items, most in (("pair", pairs, None), ("term", terms, reported)):
            for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, k))
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def sources_and_terms(seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "THE", "Of", "été", "中文", "ſ", "İx", "a-b", "x1y", "_z", "\0q", "naïve", "\x7fr", "😀", "É"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=None)), f"s{rng.integers(0, 5)}" if i % 9 else None, ["en", "de", None][i % 3], 0) for i in range(240)]
    return rows + [(1_000, None, "only", "xx", 0), (1_001, "", "other", "xx", 0), (1_002, "alone", "one", "yy", 0), (1_003, "b " * 500, "s1", "en", 0)]


@pytest.mark.parametrize("small", [False, True])
def test_divergences_equal_brute_force(spark, monkeypatch, small):
    """Also with shards, blocks and held counts so small that all of them are cut."""
    if small:
        for name, size in (("SHARD_COUNTS", 50), ("CELLS", 12), ("PIECE_BYTES", 100), ("HELD_COUNTS", 20)):
            monkeypatch.setattr(divergence, name, size)
    rows = sources_and_terms()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    assert found(divergence.divergences(docs)) == plain_divergences(rows)
    assert found(divergence.divergences(docs, reported=7)) == plain_divergences(rows, reported=7)


def test_divergence_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(queries.oracle_sql()["op13_divergence"])
    names = [d[0] for d in con.description]
    want = sorted(tuple(r[names.index(n)] for n in ("lang", "source", "part", "item", "value", "rank")) for r in con.fetchall())
    assert found(queries.op13_divergence(spark, sf)) == want


def test_divergence_edges(spark, edge_docs):
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even"))
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"], 0) for r in docs.collect()]
    assert found(divergence.divergences(docs)) == plain_divergences(rows)
    assert divergence.divergences(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        divergence.divergences(docs, reported=201)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**13), st.integers(1, 9 * 10**14)), min_size=1, max_size=5))
def test_shares_are_exact(pairs):
    n, total = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    n = np.minimum(n, total)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_rows_without_a_text_column_fail(spark):
    with pytest.raises(PySparkException):
        divergence.counted(spark.createDataFrame([(1,)], "doc_id long"))

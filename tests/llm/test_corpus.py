"""Operators 1, 6 and 9, and the pipeline, beside brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparlattice.llm import arrays, bpe, decontaminate, neardup, quality, queries, secrets, shared, toxicity
from tests.llm.conftest import WORD, components, shingles, words

# ---- 1 ----


def near_corpus(seed=1):
    """Groups of copies edited at random rates, around and across the threshold, with shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        if rng.random() < 0.5:
            base[2:2] = passage
        for _ in range(rng.choice([1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [4, 256])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components(texts)
    got = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (want[r["doc_id"]] == r["doc_id"]) and r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in got)


def test_keys_in_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 3)
    monkeypatch.setattr(neardup, "PAIRS", 7)
    texts = near_corpus(2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == components(texts)


def test_rows_of_a_hot_key_meet_only_rows_of_other_components(spark):
    n, others = 100_000, 5
    met = spark.range(n).selectExpr("7L AS key", "id", "0L AS lead", f"id DIV {neardup.BLOCK} AS seat")
    members = spark.range(n).selectExpr("id", "100L AS n", "0L AS s0", "0L AS s1", "0L AS block", f"IF(id >= {n - others}, id, 0L) AS component")
    mains = -(-(n - others) // neardup.PART)
    assert neardup.pieces(met, members).count() == (n - others) + others * (1 + mains)
    assert neardup.pieces(met, members.withColumn("component", F.lit(0).cast("long"))).count() == 0


def test_ids_beyond_the_bound_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_IDS", 0)
    texts = near_corpus(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components(texts)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_near_duplicates_on_the_sample(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["component_id"] for r in queries.op1_neardup(spark, sf).collect()} == components(texts)


def test_near_duplicates_edges(edge_docs, no_docs):
    got = neardup.near_duplicates(edge_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert len(got) == edge_docs.count()
    want = components({i: t for i, t in texts.items() if i is not None})
    assert all(r["component_id"] == want[r["doc_id"]] if r["doc_id"] is not None else r["component_id"] is None and r["kept"] for r in got)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_signatures_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (200, neardup.COMPONENTS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.permutation(neardup.COMPONENTS)[: neardup.GUARANTEED]] ^= 1
    x, y = neardup.keys_of(a), neardup.keys_of(b)
    assert (x == y).any(axis=1).all()


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in neardup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in parent)
    assert neardup.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9 ----


def plain_leaks(text, items):
    w = words(text)
    out = []
    for k, item in items.items():
        v = words(item)
        span = min(5, len(v))
        if not v:
            continue
        want = Counter(tuple(v[i : i + span]) for i in range(len(v) - span + 1))
        for s in range(len(w) - len(v) + 1):
            have = Counter(tuple(w[i : i + span]) for i in range(s, s + len(v) - span + 1))
            both = sum((have & want).values())
            if 100 * both >= 75 * (sum(have.values()) + sum(want.values()) - both):
                out.append(k)
                break
    return sorted(out)


def leak_corpus():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(n)) for k, n in enumerate([1, 3, 5, 7, 12, 30, 30, 55])}
    items[8] = items[4]
    items[9] = "a b " * 20
    docs = {}
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for k in rng.sample(list(items), rng.choice([0, 1, 2])):
            v = items[k].upper().split() if rng.random() < 0.3 else items[k].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs[i] = "  ".join(w)
    return docs, items


@pytest.mark.parametrize("held", [30, 10**6])
def test_leaks_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 60)
    monkeypatch.setattr(decontaminate, "PIECE", 20)
    docs, items = leak_corpus()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.leaks(d, b, pass_words=held).collect()}
    assert got == {i: plain_leaks(t, items) for i, t in docs.items()}
    clean = {i for i, t in docs.items() if not plain_leaks(t, items)}
    assert {r["doc_id"] for r in decontaminate.cleaned(d, b, pass_words=held).collect()} == clean


def test_recall_where_a_cut_item_is_followed_by_one_repeated_word():
    """Items at just the similarity, their ends replaced by a row of one word: the worst case of a fingerprint over words."""
    rng = random.Random(8)
    items = {k: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) for k, n in enumerate([30, 59, 59, 100, 140] * 20)}
    texts, want = [], []
    for k, item in items.items():
        w = item.split()
        n = len(w) - 4
        cut = n - decontaminate.least_shared(n)
        texts.append(" ".join(["so", *w[: len(w) - cut], *["|"] * (cut + 30)]))
        texts.append(" ".join([*["|"] * (cut + 30), *w[cut:]]))
        want += [[k], [k]]
    index = decontaminate.Items.of(list(items), [arrays.Words([t]).hashes for t in items.values()])
    assert [sorted(x) for x in index.hits(texts)] == want
    assert [plain_leaks(t, items) for t in texts[:6]] == want[:6]


def test_leaks_edges(spark, edge_docs, no_docs):
    odd = spark.createDataFrame([(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e")], "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.leaks(edge_docs, odd).collect()}
    assert found[5] == [3] and found[0] == []
    assert decontaminate.leaks(no_docs, odd).count() == 0
    assert {tuple(r["item_ids"]) for r in decontaminate.leaks(edge_docs, odd.limit(0)).collect()} == {()}
    assert decontaminate.cleaned(edge_docs, odd).columns == edge_docs.columns


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = decontaminate.Index.of(list(range(40)), arrays.mix(rng.integers(0, 2**62, (40, 20)).astype(np.uint64)))
    prints = items.prints[rng.integers(0, 40, 300)].copy()
    for p in prints:
        bits = np.unpackbits(p.view(np.uint8), bitorder="little")
        bits[rng.permutation(128)[: rng.integers(0, 55)]] ^= 1
        p[:] = np.packbits(bits, bitorder="little").view(np.uint16)
    left, item = items.near(prints)
    far = np.bitwise_count(prints[:, None] ^ items.prints[None]).sum(axis=2)
    assert set(zip(left.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)), strict=True))


# ---- 6 ----


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    model = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.scored(no_docs, model).count() == 0
    assert {r["predicted"] for r in toxicity.scored(edge_docs, model).collect()} == {0}


def test_every_part_of_a_long_word_is_scored():
    gauge = toxicity.Gauge(*(b" " + w + b" \x00" + toxicity.CARRIER + b"\x00" * 16 for w in (b"venomvenomus", b"harmlessword")))
    odd = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(9_000))
    for at in (0, 1_990, 1_999, 5_000, len(odd)):
        text = odd[:at] + "venomvenomus" + odd[at:]
        assert any("venomvenomus" in w for w in toxicity.windows(text))
        assert gauge.features([text])[0, :-1].sum() > gauge.features([odd])[0, :-1].sum()
    for n in (0, 1, 199, 200, 201, 388, 389, 9_000):
        cut = toxicity.windows(odd[:n])
        assert cut[0] + "".join(w[12:] for w in cut[1:]) == odd[:n] and max(map(len, cut)) <= 200
        assert n > 200 or len(cut) == 1


def test_held_out_rows_never_reach_the_fit(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.gauge.toxic == b.gauge.toxic and a.gauge.ordinary == b.gauge.ordinary and a.weights == pytest.approx(b.weights)


# ---- the pipeline ----


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {i: texts[i] for i in (r["doc_id"] for r in quality.judged(docs, model).where("kept").collect())}
    found = components(texts)
    texts = {i: t for i, t in texts.items() if found[i] == i}
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    texts = {i: secrets.masked(t) for i, t in texts.items() if not plain_leaks(t, items)}
    vocab = bpe.vocabulary(queries.tokenizer_path(queries.BYTE_VOCABULARY))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert bpe.decode(got[i]["ids"], vocab).decode() == t and got[i]["n_tokens"] == len(got[i]["ids"])


def test_stages_keep_the_columns_and_survive_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() == rows.count()


# ---- 6, beside plain versions ----


def plain_features(gauge, text):
    """Windows of one text one by one, each compressed by compressors of its own."""
    import zstandard as zs

    params = zs.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, search_log=4, min_match=4, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
    gains = []
    for word in WORD.findall(text or ""):
        for w in toxicity.windows(word):
            framed = toxicity.CARRIER + b" " + w.lower().encode() + b" " + toxicity.CARRIER
            a, b = (len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress(framed)) for d in (gauge.toxic, gauge.ordinary))
            gains.append(b - a)
    n = max(1, len(gains))
    shares = [min(10, 100 * sum(g == k or (k == toxicity.GAINS[-1] and g > k) for g in gains) / n) for k in toxicity.GAINS]
    return [*shares, np.log1p(len(gains))]


def test_scores_equal_plain_ones_and_depend_on_no_partition(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.fit(docs.repartition(n), labels) for n in (1, 8, 64)]
    for m in models[1:]:
        assert (m.gauge.toxic, m.gauge.ordinary) == (models[0].gauge.toxic, models[0].gauge.ordinary)
        assert np.abs(m.weights - models[0].weights).max() < 1e-9
    rows = docs.where("length(text) < 1500").orderBy("doc_id").limit(12).collect()
    texts = [r["text"] for r in rows] + ["", "x" * 450 + " end"]
    want = np.array([plain_features(models[0].gauge, t) for t in texts])
    assert models[0].gauge.features(texts) == pytest.approx(want)
    z = want @ models[0].weights[:-1] + models[0].weights[-1]
    assert models[0].scores(texts) == pytest.approx(1 / (1 + np.exp(-z)))


def test_one_row_for_each_chosen_id_is_gathered(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} one two three") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, toxic int, quality int")
    rows = toxicity.labelled_rows(docs, labels, 100).collect()
    assert len(rows) == len({r["__id"] for r in rows}) <= 5
    assert quality.labelled_stats(docs, labels, 100).count() == 5

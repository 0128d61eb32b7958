"""Operators 2, 3, 4, 5, 7, 8 and 10 beside plain versions."""

import base64
import hashlib
import html as html_lib
import json
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparlattice.llm import bpe, chat, html, licenses, quality, queries, secrets, token_files
from tests.llm.conftest import EDGES, WORD

ODD = st.text(alphabet=st.sampled_from("ab'stdre vml \n\t.,!12é中S😀ſİ́Σ<>|/[]INST\\"), max_size=60)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 3 ----


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(queries.tokenizer_path(queries.BYTE_VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tiktoken_encoding):
    vocab = bpe.vocabulary(queries.tokenizer_path(queries.BYTE_VOCABULARY))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(ODD, max_size=5))
    def check(texts):
        for text, ids in zip(texts, bpe.encode(texts, vocab), strict=True):
            assert ids == tiktoken_encoding.encode_ordinary(text)
            assert bpe.decode(ids, vocab) == text.encode()

    check()


def test_bpe_query(spark, sf, tiktoken_encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = by_id(queries.op3_bpe(spark, sf))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = tiktoken_encoding.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_edges(edge_docs, no_docs):
    path = queries.tokenizer_path(queries.BYTE_VOCABULARY)
    got = bpe.digests(edge_docs, path).collect()
    assert len(got) == edge_docs.count() and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert bpe.digests(no_docs, path).count() == 0
    kept = bpe.encoded(edge_docs, path)
    assert kept.columns == ["doc_id", "text", "key", "id", "ids"] and dict(kept.dtypes)["ids"] == "array<int>"


def test_minimal_perfect_hash_is_one_to_one():
    vocab = bpe.vocabulary(queries.tokenizer_path(queries.BYTE_VOCABULARY))
    assert len(set(vocab.id_at)) == len(vocab.id_at) == vocab.whole.n


# ---- 5 ----


def test_token_files(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = by_id(queries.op5_token_files(spark, sf))
    start = 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, token_files.END_ID]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(raw))
        start += len(ids)


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))


@pytest.fixture(scope="module")
def word_tokenizer():
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    return token_files.word_tokenizer(path, token_files.word_classes(path))


def ids_of(tokenizer, texts):
    ids, bounds = tokenizer.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_word_tokenizer_equals_the_library(word_library, word_tokenizer):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(ODD, min_size=1, max_size=5))
    def check(texts):
        assert ids_of(word_tokenizer, texts) == [word_library.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    special = ["plain <|endoftext|> end", "<|endoftext|>", "", "<|startoftext|><|endoftext|>A", "x<|ENDOFTEXT|>y", "<|<|endoftext|>|>", "\u0130<|endoftext|>\u0301a", "end"]
    assert ids_of(word_tokenizer, special) == [word_library.encode(t, add_special_tokens=False).ids for t in special]


def test_word_tokenizer_knows_every_character(word_library, word_tokenizer):
    """A letter, a digit, an apostrophe and a mark beside every code point, those of newer Unicode versions too."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for i in range(0, len(points), 10_000):
        text = "\n".join(f"A{chr(c)}b 1{chr(c)}'s {chr(c)}!" for c in points[i : i + 10_000])
        assert ids_of(word_tokenizer, [text]) == [word_library.encode(text, add_special_tokens=False).ids]


def test_batches_read_back_are_bounded(spark):
    own = token_files.bounded_batches(spark)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b" and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{8 << 20}b"


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_file_layout(spark, edge_docs, no_docs, tmp_path, encoding):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/{encoding}"
    token_files.write_tokens(edge_docs, queries.tokenizer_path(queries.WORD_TOKENIZER), f"file://{path}", encoding)
    files = [f for f in sorted(p.name for p in (tmp_path / encoding).iterdir()) if f.endswith(".parquet")]
    meta = [pq.ParquetFile(f"{path}/{f}").metadata for f in files]
    ids = next(m.row_group(0).column(2) for m in meta if m.num_rows)
    assert ids.has_offset_index and (encoding == "delta") == ("DELTA_BINARY_PACKED" in ids.encodings)
    got = token_files.checksums(token_files.read_tokens(spark, f"file://{path}")).collect()
    assert len(got) == edge_docs.count()
    assert sorted(r["start"] for r in got)[-1] + min(r["n_tokens"] for r in got) <= sum(r["n_tokens"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert token_files.token_digests(no_docs, queries.tokenizer_path(queries.WORD_TOKENIZER)).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(edge_docs, "x", "y", "nosuch")


# ---- 10 ----


def plain_stats(text):
    w = WORD.findall(text or "")
    n = len(w)
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {i + j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, sf, edge_docs, no_docs):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), edge_docs.where("doc_id IS NOT NULL")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        model = quality.Model(None, 0.0)
        for r in quality.judged(df, model).collect():
            n, *rest = plain_stats(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
            assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and r["kept"] == (not r["base_failed"])
    assert quality.judged(no_docs, model).count() == 0
    kept = quality.filtered(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(plain_stats(r["text"])[0] >= 50 and 2 * plain_stats(r["text"])[4] <= plain_stats(r["text"])[0] for r in edge_docs.collect())


def test_forest_keeps_good_and_finds_bad_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_forest_finds_bad_rows_it_was_not_grown_on(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = labels.where("doc_id % 2 = 0")
    others = docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi")
    rows = quality.judged(others, quality.fit(docs, own)).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [not r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) >= 0.9


def test_quality_without_usable_labels(edge_docs, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(edge_docs, labels).forest is None


# ---- 8 ----



def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


OID = tlv(6, bytes.fromhex("2a864886f70d010101"))
BIG = [3 ** (150 + k) for k in range(8)]
RSA = tlv(0x30, number(0), *map(number, BIG))
PRIVATE = {
    "rsa": RSA,
    "dsa": tlv(0x30, number(0), *map(number, BIG[:5])),
    "ec": tlv(0x30, number(1), tlv(4, b"k" * 32), tlv(0xA0, OID), tlv(0xA1, tlv(3, b"\0" + b"p" * 64))),
    "pkcs8": tlv(0x30, number(0), tlv(0x30, OID, tlv(5)), tlv(4, RSA)),
    "ed25519": tlv(0x30, number(0), tlv(0x30, tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, b"k" * 32))),
    "encrypted": tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30, tlv(4, b"salt"))), tlv(4, b"e" * 300)),
    "openssh": b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\x01" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"s" * 136)),
}
PUBLIC = {
    "rsa": tlv(0x30, number(BIG[0]), number(65537)),
    "spki": tlv(0x30, tlv(0x30, OID, tlv(5)), tlv(3, b"\0", tlv(0x30, number(BIG[0]), number(65537)))),
    "certificate": tlv(0x30, tlv(0x30, tlv(0xA0, number(2)), number(77), tlv(0x30, OID), tlv(0x30), tlv(0x30, b"\x17\x02zz")), tlv(0x30, OID, tlv(5)), tlv(3, b"\0" * 129)),
    "parameters": tlv(0x30, number(BIG[0]), number(2)),
    "ssh": b"\0\0\0\x07ssh-rsa" + b"\0\0\0\x03\x01\0\x01" + b"\0\0\0\x10" + b"k" * 16,
}
DER = base64.b64encode(RSA).decode()
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1"}', b"signature"))
SSH = base64.b64encode(PRIVATE["openssh"]).decode()


def plain_base(text):
    rules = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "token: ", "SECRET=", "'", '"', " ", "abcdef0123456789", "AKIA", "ABCDEF123456", "x" * 11, "apikey", "api_key = ", "ſecret=aaaaaaaaaaaa", ":", "=", "é"]), max_size=12))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets._said(secrets.base_spans(text)) == plain_base(text)


def test_confirmed_spans_decode():
    text = f"k {DER} j {JWT} s {SSH} -----BEGIN RSA PRIVATE KEY-----\n{DER}\n-----END RSA PRIVATE KEY----- hex {base64.b64decode(DER).hex().upper()}"
    kinds = Counter(secrets.KINDS[k] for _, k, _, _ in secrets.confirmed_spans(text))
    assert kinds == {"der": 2, "jwt": 1, "ssh": 1, "pem": 1}  # what an armoured block holds isn't reported twice
    near = f"k {'A' * 60} j {JWT.replace('ey', 'eX', 1)} s {base64.b64encode(b'ssh-rsa no lengths here at all').decode()} d {base64.b64encode(b'0' + bytes(40)).decode()}"
    assert secrets.confirmed_spans(near) == []
    assert not secrets.is_token_header(b"{" * 100_000)


def confirmed(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b, _ in secrets.confirmed_spans(text)]


@pytest.mark.parametrize("name", PRIVATE)
def test_private_keys_wherever_they_stand(name):
    key = base64.b64encode(PRIVATE[name]).decode()
    kind = "ssh" if name == "openssh" else "der"
    bare = key.rstrip("=")
    for text, span in (
        (f"a {key} b", key), (f"at url/path/{key} b", key), (f"token_{bare.translate(str.maketrans('+/', '-_'))} b", bare.translate(str.maketrans("+/", "-_"))),
        (f"say:\n{chr(10).join(re.findall('.{1,64}', key))}\nend", "\n".join(re.findall(".{1,64}", key))), (f"say:\n  {(chr(10) + '  ').join(re.findall('.{1,76}', key))} end", "\n  ".join(re.findall(".{1,76}", key))),
        (f"hex {PRIVATE[name].hex()} b", PRIVATE[name].hex()), (f"hex AF{PRIVATE[name].hex().upper()}0 b", PRIVATE[name].hex().upper()),
    ):
        assert confirmed(text) == [(kind, span)]
    (glued,) = confirmed(f"x {bare}AAAA/more")
    assert glued[0] == kind and glued[1].startswith(bare[:-1]) and len(glued[1]) <= len(bare)
    block = f"-----BEGIN PRIVATE KEY-----\n{chr(10).join(re.findall('.{1,64}', key))}\n-----END PRIVATE KEY-----"
    assert confirmed(f"x {block} y") == [("pem", block)]
    escaped = block.replace("\n", "\\n")
    assert confirmed('{"private_key": "' + escaped + '\\n"}') == [("pem", escaped)] and secrets.masked(f"x {escaped} y") == "x [SECRET] y"


@pytest.mark.parametrize("name", PUBLIC)
def test_public_keys_and_certificates_are_no_secrets(name):
    key = base64.b64encode(PUBLIC[name]).decode()
    block = f"-----BEGIN CERTIFICATE-----\n{chr(10).join(re.findall('.{1,64}', key))}\n-----END CERTIFICATE-----"
    for text in (f"a {key} b", f"ssh-rsa {key} me@host", block, block.replace("\n", "\\n"), "\n".join(re.findall(".{1,64}", key))):
        assert confirmed(text) == [] and secrets.masked(text) == text
    assert confirmed(PUBLIC[name].hex().upper()) == []


@pytest.mark.parametrize("before", ["token_", "a-", "x.y.", "eyey", "_eyJ_", ""])
def test_tokens_behind_other_characters(before):
    assert confirmed(f"say {before}{JWT} now") == [("jwt", JWT)]


@pytest.mark.parametrize("text", ["_eyJ" * 60_000 + ".aa.bb", "MIIEowIBAAKCAQEA" * 15_000, "b3BlbnNzaC1rZXktdjEAAAAA" * 10_000, "3082" * 60_000, "MHcCAQEE" * 30_000, "eyJh." * 50_000])
def test_hostile_runs_take_little_time(text):
    began = time.time()
    secrets.confirmed_spans(text)
    assert time.time() - began < 10


def test_secrets_query_and_mask(spark, sf, edge_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_secrets(spark, sf).collect():
        base = plain_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(re.findall(k + ":", base)) for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert secrets.scanned(edge_docs, ).count() == edge_docs.count() and secrets.scanned(no_docs).count() == 0
    df = spark.createDataFrame([(1, f"say token = 'abcdef0123456789abcd' and {JWT}!", 3), (2, None, 0), (3, "clean", 99)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redacted(df).orderBy("doc_id").collect()] == [(1, "say token = '[SECRET]' and [SECRET]!", 36), (2, None, 0), (3, "clean", 99)]


# ---- 7 ----


def test_license_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(queries.oracle_sql()["op7_licenses"])
    assert sorted(map(tuple, queries.op7_licenses(spark, sf).collect())) == sorted(con.fetchall())


def plain_licenses(text, templates):
    """(license, dice) of the best window, comparing every window of a template's length with it."""
    w = licenses.words_of(text or "")
    grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    out = {}
    for name, t in templates.items():
        own, width = set(licenses.bigrams_of(t)), len(licenses.words_of(t)) - 1
        for i in range(len(grams)):
            v = set(grams[i : i + width])
            if grams[i] in own and 200 * len(v & own) >= 80 * (len(v) + len(own)):
                out[name] = max(out.get(name, 0), round(2 * len(v & own) / (len(v) + len(own)), 6))
    return out


def test_license_windows(spark, edge_docs, no_docs):
    from sparlattice.llm.license_templates import TEMPLATES

    wrapped = TEMPLATES["mit-full"].replace(" documentation ", "\n// documentation ").replace("furnished", "\n * furnished").replace(" The above", "\n\nThe above")
    edited = " ".join(w for i, w in enumerate(TEMPLATES["bsd-3-clause"].split()) if i % 17)
    texts = {
        1: f"Copyright (c) 2024 me. {wrapped} class Foo: pass",
        2: "released under the mit licence",
        3: "Foo 1.0. Released   under the MIT license! See AUTHORS.",
        4: "This is licensed",
        5: f"{edited} and more of it",
        6: TEMPLATES["isc"] + " " + TEMPLATES["gpl-3.0-notice"] + " " + TEMPLATES["gpl-warranty"],
        7: "of the software " * 300,
    }
    got = by_id(licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    for i, text in texts.items():
        want = plain_licenses(text, TEMPLATES)
        assert got[i]["n_licenses"] == len(want), i
        assert (got[i]["dice"], got[i]["license"]) == max(((d, n) for n, d in want.items()), default=(None, None))
    assert {"mit-full", "mit-grant", "mit-warranty"} <= set(plain_licenses(texts[1], TEMPLATES)) and got[1]["dice"] == 1.0
    assert got[2]["n_licenses"] == 0 and got[3]["license"] == "mit" and got[5]["license"] == "bsd-3-clause" and got[6]["n_licenses"] >= 3 and got[7]["license"] is None
    assert licenses.scanned(edge_docs).count() == edge_docs.count() and licenses.scanned(no_docs).count() == 0
    plan = licenses.scanned(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("== Physical Plan ==")[1])
    for n in range(1, 60):
        low, high = licenses.size_bounds(n)
        for m in range(1, 150):
            assert (low <= m <= high) == (200 * min(n, m) >= licenses.PERCENT * (n + m))


# ---- 4 ----


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "we<|ird\\"]), st.one_of(ODD, st.sampled_from([chat.TURN, chat.CLOSE, "</s>[INST] ok [/INST]", "<\\|turn|>", "\\", "<"]))), max_size=6))
def test_chat_round_trip(turns):
    text = chat.formatted(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in chat.loss_spans(text)] == [t for r, t in turns if r == "assistant"]
    bare = text
    for mark in (chat.TURN, chat.TEXT, chat.CLOSE):
        assert bare.count(mark) == len(turns)
    assert "</s>" not in text and "[INST]" not in text and "[/INST]" not in text


def test_chat_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op4_chat(spark, sf).collect()}
    assert set(got) == set(want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def test_layouts_are_chosen_by_fingerprint(spark):
    said = [("user", "hi"), ("assistant", "yo")]
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "extra": 1},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"prompt": "hi", "completion": "yo"},
        {"question": "hi", "answer": "yo"},
    ]
    assert [chat.canonical(r) for r in records] == [said] * 5
    assert len(chat.BY_FINGERPRINT) == len(chat.MAPPINGS)
    df = spark.createDataFrame([(json.dumps(r), 1) for r in records] + [(None, 1), ("{", 1), ('{"x": 1}', 1), ("[]", 1)], "record string, chat int")
    rows = chat.formatted_records(df).collect()
    assert [r["layout"] for r in rows] == ["messages", "shared", "instruction with input", "prompt and completion", "question and answer", None, None, None, None]
    assert {r["chat"] for r in rows[:5]} == {chat.formatted(said)} and {r["chat"] for r in rows[5:]} == {None}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "first"), (None, 0, None, "lost"), (2, 0, "assistant", "long " * 100_000)]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted_rows(spark.createDataFrame(rows, schema))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 5 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 500_000
    assert chat.digests(chat.formatted_rows(spark.createDataFrame([], schema))).count() == 0
    with pytest.raises(ValueError):
        chat.formatted_rows(spark.createDataFrame([], "a int"))


# ---- 2 ----


def test_main_text_is_the_article(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_html(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.DOTALL)[1]
        want = " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


PAGE = """<!DOCTYPE html><html><head><title>x y</title></head><body><header>Site name</header><nav><a href=/>home</a></nav>
<div class="notice">we use cookies</div><main><h1>Head line</h1><p>One <b>tw</b>o&nbsp;three &lt;b&gt; it&#39;s.<br>four<p>five words
are here<aside>note this</aside><script>if (a<b) "</p>"</script> six seven<!-- <p>hidden --><ul><li>item one</ul><div id="comments"><p>I like it</p></div></main>
<form>sign up <input name=a></form><footer>(c) me</footer>"""


def fitted(pages):
    """Weights from these pages, as ``fit`` makes them of the counts."""
    n = Counter()
    for p in pages:
        n.update(html.contexts(p))
    return html.Weights(html.learned({k: v for k, v in n.items() if not k[0].startswith('"')}))


def without_names(page):
    """The page with links before and a copyright line behind, and no element or name that tells them apart."""
    page = re.sub(r"</?article>", "", page).replace(' class="ad"', "")
    page = re.sub(r"<(nav|footer)>", "<div>", re.sub(r"</(nav|footer)>", "</div>", page))
    return page.replace("<h1>", '<ul class="links">' + "".join(f"<li><a href=/{i}>section {i}</a>" for i in range(12)) + "</ul><h1>", 1)


def article_of(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    return " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_held_out_pages_without_names_come_from_the_scan(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights = fitted(pages[::2])
    scores, changed = [], 0
    for p in pages[1::2]:
        got, want = (Counter(x.split()) for x in (html.main_text(without_names(p), weights), article_of(p)))
        scores.append(2 * (got & want).total() / (got.total() + want.total()))
        with monkeypatch.context() as m:
            m.setattr(html, "best_region", lambda s: (0, len(s)))
            changed += html.main_text(without_names(p), weights) != " ".join(got.elements()) and html.main_text(without_names(p), weights).count("section 1 ") > 0
    assert sum(scores) / len(scores) > 0.99 and min(scores) > 0.9
    assert changed == len(scores)


@pytest.mark.parametrize("fit_on", ["prior", "pages"])
def test_unmarked_links_and_footers_go(spark, fit_on):
    weights = html.Weights() if fit_on == "prior" else fitted([r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()])
    said = "The article has these words, quite a few of them, and more than a list of links has."
    links = '<ul class="links">' + "<li><a href=x>section one</a></li>" * 12 + "</ul>"
    assert html.main_text(f'<body>{links}<p>{said}</p><div class="bottom">Copyright 2024 a company</div></body>', weights) == said
    assert html.main_text(f'<div class="search-article legal"><p>{said}</p><p>{said}</p></div>', weights) == f"{said} {said}"
    assert html.main_text(f"<body><div>{said}<br>{said} {said}</div></body>", weights) == f"{said} {said} {said}"
    assert html.main_text(f'<p>{said}</p><div class="commentList"><p>I like it</p></div><p>{said}</p>', weights) == f"{said} {said}"
    assert html.main_text("<p>super<wbr>cali fragil <b>is</b>tic", weights) == "supercali fragil istic"


def test_main_text_leaves_the_rest_out():
    want = "Head line One two three <b> it's. four five words are here six seven item one"
    assert html.main_text(PAGE, html.Weights()) == want
    assert [html.main_text(p, html.Weights()) for p in (None, "", "<p>", "<p>a<b", "plain 3 < 4")] == ["", "", "", "a", "plain 3 < 4"]


@pytest.mark.parametrize("long", [f"data-x='{'ab> <i' * 300}'", 'data-x="' + "y" * 200_000 + '"', " ".join(f'a{i}="{i}>"' for i in range(100))])
def test_long_attributes_belong_to_their_tag(long):
    page = f"<body><main><p>one two</p><script {long}>var secret = 1;</script><div {long} class=sidebar>menu</div><SCRIPT {long}>x</script ><p {long}>three <a {long}>four</a></p></main></body>"
    assert html.main_text(page, html.Weights()) == "one two three four"
    assert html.main_text(f"one <p {long}", html.Weights()).startswith("one")


@pytest.mark.parametrize("page", ["<a \"=\"" * 30_000, "<a x=\"" * 30_000, "<a b='\"=\"" * 30_000, "<a" + " b=''" * 60_000 + "<", "<div a=' " * 30_000 + "'>" * 30_000])
def test_pages_of_stray_quotes_take_linear_time(page):
    begun = time.process_time()
    html.main_text(page, html.Weights())
    assert time.process_time() - begun < 5


ARTICLE = "<article><h1>Head line of it</h1><p>" + "Some words of the article that matter much. " * 12 + "</p>{}</article>"
CORE = "Head line of it " + ("Some words of the article that matter much. " * 12).strip()


@pytest.mark.parametrize("page, want", [
    ("<header><svg class='logo' /></header>" + ARTICLE.format(""), CORE),
    (ARTICLE.format("<p>a <svg viewBox='0 0 1 1'/> b end</p>"), CORE + " a b end"),
    (ARTICLE.format("<svg><svg></svg><text>X</text></svg><p>after</p>"), CORE + " after"),
    ("<nav><svg class=a><path d=1></nav><div>" + ARTICLE.format("") + "</div>", CORE),
    (ARTICLE.format("<svg-icon name=x></svg-icon><p>tail words here</p>"), CORE + " tail words here"),
    (ARTICLE.format("<p>choose <select><option>one two three four five six seven</option></select> now please</p>"), CORE + " choose now please"),
    (ARTICLE.format("<p>x <math><mi>y</mi></math> z</p>"), CORE + " x z"),
    (ARTICLE.format("<svg data-x='a>b'><text>n</text></svg ><p>t</p>"), CORE + " t"),
    (ARTICLE.format("<script>x</script foo><p>t</p>"), CORE + " t"),
])
def test_raw_elements_take_nothing_with_them(page, want):
    assert html.main_text(page, html.Weights()) == want


def test_texts_of_the_query_come_from_learned_weights_and_the_scan(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights, held_out = fitted(pages[::2]), pages[1::2]
    texts = [html.main_text(p, weights) for p in held_out]
    assert texts == [article_of(p) for p in held_out]
    with monkeypatch.context() as m:
        m.setattr(html, "best_region", lambda s: (0, len(s)))
        assert sum(html.main_text(p, weights) != t for p, t in zip(held_out, texts, strict=True)) == len(texts)
    monkeypatch.setattr(html, "PRIOR", {})
    alone = fitted(pages[::2])
    assert not set(html.PRIOR_NAMES) & set(alone.words)
    scores = []
    for p, t in zip(held_out, texts, strict=True):
        got, want = (Counter(x.split()) for x in (html.main_text(p, alone), t))
        scores.append(2 * (got & want).total() / (got.total() + want.total()))
    assert sum(scores) / len(scores) > 0.99


def test_best_region_is_the_maximum():
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.integers(-5, 5), max_size=12))
    def check(scores):
        low, high = html.best_region([float(s) for s in scores])
        best = max((sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[low:high]) == best

    check()


@pytest.mark.parametrize("page", ["<a '" * 30_000, "<" * 100_000, "<!--" * 50_000, "<script>" * 20_000, "<p>x" * 50_000, "<div>" * 50_000 + "</x>" * 50_000])
def test_hostile_pages_take_linear_time(page):
    begun = time.process_time()
    html.main_text(page, html.Weights())
    assert time.process_time() - begun < 15


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, text string, tag int"
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (None, "u", "<p>a</p>", "x", 1), (2, "u", "", "x", 1)]
    df = spark.createDataFrame(rows, schema)
    got = html.extracted(df, html.fit(df)).collect()
    assert sorted(r["text"] for r in got) == ["", "", "", "a"]
    empty = spark.createDataFrame([], schema)
    assert html.extracted(empty, html.fit(empty)).count() == 0


def test_all_edges_have_a_row_each(edge_docs):
    assert edge_docs.count() == 2 * len(EDGES) + 2 and edge_docs.where(F.col("text").isNull()).count() == 2


def test_all_labelled_rows_fit_the_forest(spark, tmp_path):
    """More of them than any bound; counts over values and path lengths equal plain ones."""
    from sparlattice.llm.shared import Scratch

    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert quality.labelled_stats(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))).count() == 20_500
    rng = np.random.default_rng(3)
    x, good, fold = rng.normal(size=(700, 4)).round(1), rng.random(700) < 0.8, rng.integers(0, quality.FOLDS, 700)
    x[:, 3] = 0.0
    data = [(i, bool(g), int(f), *map(float, v)) for i, (g, f, v) in enumerate(zip(good, fold, x, strict=True))]
    rows = spark.createDataFrame(data, "doc_id long, good boolean, fold int, " + ", ".join(f"{c} double" for c in quality.RATES)).repartition(3)
    scratch = Scratch(spark)
    got = quality.pairs_in_order(rows, scratch)
    for c in range(4):
        for f in range(quality.FOLDS):
            for g in range(quality.FOLDS):
                a, b = x[good & (fold == g), c], x[~good & (fold == f), c]
                assert got[c, f, g] == (2 * (a[:, None] < b) + (a[:, None] == b)).sum()
    n = np.array([(good & (fold == f)).sum() for f in range(quality.FOLDS)])
    picked = quality.gathered(rows, n, np.arange(n.sum()))
    assert sorted(map(tuple, picked)) == sorted(map(tuple, x[good])) and sorted(map(tuple, picked[: n[0]])) == sorted(map(tuple, x[good & (fold == 0)]))
    forest = quality.grow([x[good][k : k + 50] for k in range(0, 400, 50)], x.min(axis=0), x.max(axis=0), np.ones(4))
    lengths = forest.path_lengths(x)
    costs = {t: sum(quality.GOOD_WEIGHT if g else -1 for v, g in zip(lengths, good, strict=True) if v < t) for t in [-np.inf, *((a + b) / 2 for a, b in zip(np.unique(lengths)[:-1], np.unique(lengths)[1:], strict=True)), np.inf]}
    found = quality.shortest_kept(rows, [forest] * quality.FOLDS, scratch)
    assert costs[found] == min(costs.values())

"""Words are told apart whatever their letters: equal first hashes, long words, words of structure."""

import numpy as np
import pytest

from sparlattice.llm import arrays, bpe, neardup, queries, secrets, token_files
from tests.llm.conftest import components


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (16, 64, 128, 1024, 2048, 4096)]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(queries.tokenizer_path(queries.BYTE_VOCABULARY))


def test_thue_morse_words_encode_alone_together_and_across_batches(vocab):
    words = [w for p in PAIRS for w in p]
    want = [vocab.merged(w.encode()) for w in words]
    assert [bpe.encode([w], vocab)[0] for w in words] == want
    assert bpe.encode(words, vocab) == want
    assert [bpe.decode(i, vocab).decode() for i in bpe.encode(words, vocab)] == words
    t = token_files.WordTokenizer(queries.tokenizer_path(queries.WORD_TOKENIZER))
    for batch in ([w] for w in words), [words]:
        for texts in batch:
            ids, bounds = t.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.tokenizer.encode(w, add_special_tokens=False).ids for w in texts]


def test_words_that_share_the_first_hash_keep_their_own_ids(vocab, monkeypatch):
    whole = arrays.hash_runs
    monkeypatch.setattr(bpe, "hash_runs", lambda blocks, points, starts, ends, kind=0: whole(blocks, points, starts, ends, kind) % np.uint64(7 if kind == 0 else 2**63))
    texts = ["the quick brown fox jumps over a lazy dog", "over the lazy fox", "zzzz qqqq the dog"]
    own = bpe.Memory(10)
    monkeypatch.setattr(vocab, "memory", own)
    want = [[i for w in bpe.PreTokens([t]).joined[:-1].replace(" ", "\n ").split("\n") for i in vocab.resolve([w])[0]] for t in texts]
    for _ in range(3):
        assert bpe.encode(texts, vocab) == want
        assert [bpe.encode([t], vocab)[0] for t in texts] == want


def test_hashes_of_runs_depend_on_the_run_alone():
    words = ["", "a", "ab", "abc", "abcd", "é" * 95, "x" * 96, "x" * 97, "y" * 500]
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for kind in (0, 1):
        got = arrays.hash_runs(arrays.packed(points), points, starts, ends, kind)
        assert len(set(got.tolist())) == len(words)
        for w, h in zip(words, got, strict=True):
            p = np.frombuffer(("zz" + w + "q").encode("utf-32-le"), dtype=np.uint32)
            assert arrays.hash_runs(arrays.packed(p), p, np.array([2]), np.array([2 + len(w)]), kind)[0] == h


def test_thue_morse_documents_are_not_linked(spark):
    texts = dict(enumerate(w for p in PAIRS for w in p))
    texts[len(texts)] = texts[2]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == components(texts)


HOSTILE = ["-----BEGIN A-----\n" * 60_000, "ey . " + "a-" * 500_000, "ey." * 330_000, "eyJ0eXAi." * 110_000, "-----BEGIN A-----" + "x" * 1_000_000, ("-----BEGIN A-----" + "x" * 50 + "-----END B-----") * 12_000, "password" + " " * 1_000_000]


@pytest.mark.parametrize("text", HOSTILE)
def test_hostile_texts_take_linear_time(text):
    import time

    def seconds(t):
        begun = time.process_time()
        secrets.base_spans(t)
        secrets.confirmed_spans(t)
        return time.process_time() - begun

    assert seconds(text) < 1 + 6 * seconds(text[: len(text) // 3])


def test_armour_and_tokens_in_one_pass():
    text = "-----BEGIN A-----\n-----BEGIN KEY-----\nabc\n-----END KEY-----\n-----END A-----"
    assert [text[a:b] for a, b, _ in secrets.armoured(text)] == ["-----BEGIN KEY-----\nabc\n-----END KEY-----"]
    head = "eyJhbGciOiJIUzI1NiJ9"
    text = f"x.{head}.e30.sig.{head}.e30. {head}.e30 a-{head}.e30.s"
    # The last one stands behind other characters of the alphabet, as tokens do behind a name.
    assert [text[a:b] for a, b in secrets.dotted_tokens(text)] == [f"{head}.e30.sig", f"{head}.e30.", f"{head}.e30.s"]

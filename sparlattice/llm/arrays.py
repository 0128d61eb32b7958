"""Vectorised text scanning for Arrow batches.

Texts of a batch are laid end to end as code points, one separator behind each,
and words, shingles and pre-tokens are found and hashed with whole-array
operations. The helpers run inside ``mapInArrow`` tasks and hold one chunk of
about ``CHUNK_CHARS`` characters (or one longer text) at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np

CHUNK_CHARS = 1_000_000
SHINGLE_WORDS = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.atleast_1d(np.asarray(x, dtype=np.uint64))  # whole arrays wrap around silently
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def packed(points: np.ndarray) -> np.ndarray:
    """Three code points from each place on, 21 bits each, in one integer."""
    p = np.zeros(len(points) + 2, dtype=np.uint64)
    p[: len(points)] = points
    return p[:-2] | p[1:-1] << _U(21) | p[2:] << _U(42)


#: Characters of the longest run that is hashed by whole-array steps.
LONG_RUN = 96
_LEFT = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], dtype=np.uint64)
_KINDS = ((_U(0x243F6A8885A308D3), _U(1)), (_U(0x13198A2E03707344), _U(0xD6E8FEB86659FD93)))


def hash_runs(blocks: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of code points, three characters a step.

    Kinds 0 and 1 are independent of each other: both together identify a run
    by 128 bits. A step is a finaliser of all bits, not a sum of powers, whose
    low bits certain long words share. ``blocks``: ``packed(points)``.
    """
    seed, factor = _KINDS[kind]
    n = ends - starts
    h = mix(n.astype(np.uint64) + seed)
    # Longest first: the runs that a step still touches are the first ones.
    size = np.minimum(n, LONG_RUN + 1).astype(np.uint8)
    longer = np.append(np.cumsum(np.bincount(size, minlength=LONG_RUN + 2)[::-1])[::-1], 0)
    rows = np.argsort(size, kind="stable")[::-1][longer[LONG_RUN + 1] :]
    at, left, g = starts[rows], n[rows], h[rows]
    for k in range(0, LONG_RUN, 3):
        m = int(longer[k + 1] - longer[LONG_RUN + 1])
        if not m:
            break
        x = blocks[at[:m] + k]
        ending = m - int(longer[k + 3] - longer[LONG_RUN + 1])
        if ending:
            x[m - ending :] &= _LEFT[left[m - ending : m] - k]
        x *= factor
        x ^= g[:m]
        g[:m] = mix(x)
    h[rows] = g
    for i in np.flatnonzero(n > LONG_RUN).tolist():
        digest = hashlib.blake2b(points[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(digest[8 * kind : 8 * kind + 8], "little")
    return h


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) with about ``limit`` characters each."""
    part: list[str] = []
    first = size = at = 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > limit:
            yield first, part
            first, part, size = at, [], 0
        part.append(text)
        size += len(text) + 1
        at += 1
    if part:
        yield first, part


class Scan:
    """Code points of some texts, one separator behind each text."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths
        self.n = len(texts)


def lower_az(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


class Words(Scan):
    """Maximal runs of characters other than space and U+0009 to U+000D.

    ``starts``/``ends``: positions in ``points``; ``doc``: the text of each word;
    ``hashes`` and ``second``: two of the word with A-Z in lower case; ``first``:
    index of each text's first word, with the total at the end.
    """

    def __init__(self, texts: list[str], lower: bool = True):
        super().__init__(texts)
        p = self.points
        inside = (p != 32) & ((p < 9) | (p > 13))
        inside[self.ends] = False
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.ends_of_words = np.flatnonzero(edge == -1)
        self.letters = lower_az(p) if lower else p
        self.blocks = packed(self.letters)
        self.hashes = hash_runs(self.blocks, self.letters, self.starts, self.ends_of_words)
        self.first = np.searchsorted(self.starts, np.append(self.begins, len(p)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    @cached_property
    def second(self) -> np.ndarray:
        return hash_runs(self.blocks, self.letters, self.starts, self.ends_of_words, 1)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``size`` words within a text."""
        return windows_of(self.hashes, self.first, size)


def windows_of(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        acc = acc * _U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:n] - np.arange(n)
    at = np.flatnonzero(left >= size)
    return at, mix(acc[at] + _U(size))


def shingle_sets(words: Words, size: int = SHINGLE_WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text: runs of ``size`` words, the whole sequence
    as one where there are fewer, nothing where there are none.

    Two hashes of each, ascending by the first; both identify a shingle.
    """
    (at, one), (_, two) = (windows_of(h, words.first, size) for h in (words.hashes, words.second))
    bounds = np.searchsorted(at, words.first)
    none = np.empty(0, dtype=np.uint64)
    out = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= size:
            a, b = bounds[i], bounds[i + 1]
            distinct, first = np.unique(one[a:b], return_index=True)
            out.append((distinct, two[a:b][first]))
        elif n:
            a, b = words.first[i], words.first[i + 1]
            out.append(tuple(windows_of(h[a:b], np.array([0, n]), n)[1] for h in (words.hashes, words.second)))
        else:
            out.append((none, none))
    return out


#: Characters with the Unicode property White_Space. Fixed values.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, END = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for every code point."""
    import sys
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def library_classes(pre_tokenizer, step: int = 4_096) -> bytes:
    """The class of every code point as a tokenizers pre-tokenizer has it, compressed.

    The library's own character tables decide, whatever Unicode version Python
    knows. A run of characters ``r`` is cut within ``a r 1 r !`` (without the
    spaces): letters join the ``a``, other characters the ``!``; a run of neither
    kind is halved, down to one character, which is a number if it joins the ``1``
    or, where digits stand alone, itself. Surrogates, which no text holds, are
    OTHER. Some two seconds of the driver; tasks get the table.
    """
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    # Whether white space between words is a token of its own or is left out.
    keeps = any(span == (1, 2) for _, span in pre_tokenizer.pre_tokenize_str("a\n1\n!"))
    runs = [(i, min(i + step, stop)) for start, stop in ((0, 0xD800), (0xE000, 0x110000)) for i in range(start, stop, step)]
    while runs:
        start, stop = runs.pop()
        n, run = stop - start, "".join(map(chr, range(start, stop)))
        spans = {span for _, span in pre_tokenizer.pre_tokenize_str(f"a{run}1{run}!")}
        if (0, n + 1) in spans:
            table[start:stop] = LETTER
        elif (n + 2, 2 * n + 3) in spans:
            table[start:stop] = OTHER
        elif n > 1:
            runs += [(start, start + n // 2), (start + n // 2, stop)]
        else:
            table[start] = NUMBER if ((1, 4) if keeps else (1, 2)) in spans else SPACE
    table[0x20] = SPACE
    return zlib.compress(table.tobytes())


@lru_cache(maxsize=4)
def unpacked_classes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=np.uint8)


#: Letters that an apostrophe takes with it at the start of a token. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Runs(Scan):
    """Maximal runs of one character class, cut behind contractions.

    ``kind`` holds END for separators. A lone apostrophe that no space precedes
    and one of ``CONTRACTIONS`` follows is joined with these letters.
    """

    def __init__(self, texts: list[str], after_space: bool, table: np.ndarray | None = None):
        """``after_space``: a space before the apostrophe takes it away from the letters
        behind. ``table``: the class of every code point, Python's own where none is given."""
        super().__init__(texts)
        p = self.points
        self.kind = (classes() if table is None else table)[p]
        self.kind[self.ends] = END
        k = self.kind
        cut = np.empty(len(p) + 1, dtype=bool)
        cut[0] = cut[-1] = True
        np.not_equal(k[1:], k[:-1], out=cut[1:-1])
        cut[self.begins] = True
        lone = np.flatnonzero((p == 39) & cut[:-1] & cut[1:] & (k == OTHER))
        if len(lone):
            ok = (lone == 0) | (p[lone - 1] != 32) | np.isin(lone, self.begins) if after_space else np.ones(len(lone), dtype=bool)
            done = ~ok
            for letters in CONTRACTIONS:
                fits = ~done
                for j, c in enumerate(letters, 1):
                    at = np.minimum(lone + j, len(p) - 1)
                    fits &= (p[at] == ord(c)) & (k[at] == LETTER)
                hit = lone[fits]
                cut[hit + 1] = False
                cut[hit + 1 + len(letters)] = True
                done |= fits
        self.cut = cut

"""Words of a batch of texts as numpy arrays.

The operators that look at word sequences (windows, shingles, automata)
need word boundaries and word fingerprints for millions of words a second.
A batch of texts is joined into one byte buffer, boundaries come from a
256-entry byte class table, and a word's fingerprint is a polynomial over
its bytes, mixed at the end.  No Spark in here: these are helpers that run
inside ``mapInPandas`` / ``mapInArrow`` tasks.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P1 = 0x9E3779B97F4A7C15
_P2 = 0xC2B2AE3D27D4EB4F
_STRETCH = 1 << 15
_KEPT_STEPS = 1 << 20


def byte_class(exclude: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans: True for bytes that belong to words."""
    t = np.ones(256, dtype=bool)
    for lo, hi in exclude:
        t[lo:hi + 1] = False
    return t


# [^\x20\x09-\x0D]+
SPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_NONE = np.empty(0, dtype=np.uint64)
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text (None: none)."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z, every other byte unchanged."""
    return data.translate(_ASCII_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply), element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _U(base | 1)
        np.multiply.accumulate(out, out=out)
    return out


_steps_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse modulo 2^64."""
    up, down = _steps_of.get(base, (_NONE, _NONE))
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        up, down = _powers(base, size), _powers(pow(base | 1, -1, 1 << 64), size)
        if size <= _KEPT_STEPS:
            _steps_of[base] = up, down
    return up[:n], down[:n]


class Words:
    """Word boundaries and fingerprints of a batch of byte strings.

    ``starts`` / ``ends`` are offsets into ``data``; ``doc_first[i]`` is the
    index of document i's first word, so its words are
    ``doc_first[i]:doc_first[i + 1]``.
    """

    def __init__(self, docs: list[bytes], is_word: np.ndarray):
        self.data = b" ".join(docs) + b" "
        buf = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.empty(len(buf) + 1, dtype=bool)
        inside[0] = False
        inside[1:] = is_word[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.buf = buf
        self.starts = edge[::2].copy()
        self.ends = edge[1::2].copy()
        sizes = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
        doc_at = np.zeros(len(docs) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=doc_at[1:])
        self.doc_first = np.searchsorted(self.starts, doc_at)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]

    def fingerprints(self, base: int = _P1) -> np.ndarray:
        """One 64-bit fingerprint a word (a stretch of words at a time): running
        sums of the bytes times the base's powers, brought back to the word's start."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        for lo in range(0, len(out), _STRETCH):
            starts, ends = self.starts[lo:lo + _STRETCH], self.ends[lo:lo + _STRETCH]
            at, n = starts[0], int(ends[-1] - starts[0])
            up, down = _steps(base, n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            vals = self.buf[at:at + n].astype(np.uint64)
            vals += _U(1)
            vals *= up
            np.cumsum(vals, out=sums[1:])
            starts, ends = starts - at, ends - at
            vals = (sums[ends] - sums[starts]) * down[starts]
            out[lo:lo + _STRETCH] = mix(vals ^ ((ends - starts).astype(np.uint64) * _U(_P2)))
        return out


def run_hash(codes: np.ndarray, k: int, base: int = _P2) -> np.ndarray:
    """Fingerprints of every k consecutive codes; entry i covers i..i+k-1
    (the last k-1 entries are not defined and left zero)."""
    n = len(codes)
    out = np.zeros(n, dtype=np.uint64)
    if n < k:
        return out
    m = n - k + 1
    p = _powers(base, k)
    acc = codes[:m] * p[0]
    for j in range(1, k):
        acc = acc + codes[j:j + m] * p[j]
    out[:m] = mix(acc)
    return out

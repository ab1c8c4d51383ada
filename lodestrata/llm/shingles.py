"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import re

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 0x1B03738712FAD5C9, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_POWERS = np.ones(1, np.uint64)
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_BREAK = re.compile(rb"[ \t\n\v\f\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and their inverses, modulo 2**64."""
    global _POWERS
    if len(_POWERS) <= n:
        inverse = pow(int(_P), -1, 1 << 64)
        p = np.full(2 * n + 2, _P, np.uint64)
        q = np.full(2 * n + 2, np.uint64(inverse), np.uint64)
        p[0] = q[0] = 1
        _POWERS = np.stack([np.multiply.accumulate(p), np.multiply.accumulate(q)])
    return _POWERS[0], _POWERS[1]


def _hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of some bytes that begin and end with a space, and where it begins."""
    b = np.frombuffer(buf, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    p, q = _powers(len(b))
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:len(b)], out=run[1:])
    return mix64((run[ends] - run[starts]) * q[starts] + (ends - starts).astype(np.uint64)), starts


def _one_word(r: bytes) -> np.ndarray:
    """The hash of a word that is longer than PIECE, from those of its parts."""
    p, total = _powers(PIECE)[0], 0
    for at in range(0, len(r), PIECE):
        c = np.frombuffer(r[at:at + PIECE], np.uint8).astype(np.uint64) + np.uint64(1)
        total += int((c * p[:len(c)]).sum()) * pow(int(_P), at, 1 << 64)
    return mix64(np.array([(total + len(r)) % (1 << 64)], np.uint64))


def _long(r: bytes) -> np.ndarray:
    """Hashes of a long text's words, piece by piece; pieces end where words do."""
    at, out = 0, []
    while at < len(r):
        end = at + PIECE
        m = _BREAK.search(r, end) if end < len(r) else None
        stop = m.start() if m else len(r)
        if stop - end > PIECE:
            # a word of that length lies over the piece's end
            word = max(at, max(r.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1)
            out += [_hashed(b" " + r[at:word] + b" ")[0], _one_word(r[word:stop])]
        else:
            out.append(_hashed(b" " + r[at:stop] + b" ")[0])
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, A-Z lower-cased, and each text's first word (and the end).

    A word's hash is a polynomial in its bytes, taken from running sums over the whole batch, then
    mixed; the work per byte is a few vector operations. Long texts are hashed in pieces of PIECE bytes,
    which need some 100 bytes of memory a byte.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    if sum(map(len, raw)) > PIECE:
        each = [_long(r) for r in raw]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])
    h, starts = _hashed(b" " + b" ".join(raw) + b" ")
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) + 1 if raw else np.array([1])
    return h, np.searchsorted(starts, at)


def shingle_sets(texts: list, k: int = 4) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles (k at most 5).

    A text of fewer words has its whole sequence as the only one; without words the set is empty.
    """
    h, at = word_hashes(texts)
    n = len(h)
    if n >= k:
        s = h[:n - k + 1] * _PLACES[0]
        for j in range(1, k):
            s = s + h[j:n - k + 1 + j] * _PLACES[j]
        s = mix64(s + np.uint64(k))
    out = []
    for i in range(len(texts)):
        a, z = at[i], at[i + 1]
        if z - a >= k:
            out.append(np.unique(s[a:z - k + 1]))
        elif z > a:
            out.append(mix64(np.array([np.sum(h[a:z] * _PLACES[:z - a]) + np.uint64(z - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out

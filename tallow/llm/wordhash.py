"""Word hashes of many texts at once, by whole-array steps over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that a step takes at once (a longer text is taken alone).
BLOCK = 1 << 18
_rng = np.random.default_rng(20_240_229)
_VALUES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]  # case of A-Z does not count
_RADIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(256, _RADIX, np.uint64), dtype=np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK bytes, each with the number of its first text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BLOCK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def placed(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, bounds (words of text i are at bounds[i]:bounds[i + 1]), and where the words begin and
    end in the bytes of all texts, which also are returned (each text ends with a line feed)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~separators[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), first, after, data
    lengths = after - first
    at = np.cumsum(lengths) - lengths
    place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _RADIX, np.uint64), dtype=np.uint64)
    hashes = mixed(np.add.reduceat(_VALUES[data[inside]] * powers[place], at))
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)]), first, after, data


def words(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and bounds as in placed()."""
    return placed(texts, separators)[:2]


def word(text: str) -> int:
    """The hash of one word."""
    return int(words([text.encode()], WHITE)[0][0])


def per_text(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner (0..n-1) in ascending order, and bounds as in words()."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(n + 1))

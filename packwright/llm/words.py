"""Words of whole texts as arrays: where they stand and a 64-bit hash of each.

A helper of tasks: it sees one bounded slice of an Arrow batch at a time (one text at
least, so a very long text is a slice of its own). Everything works on UTF-8 bytes;
bytes from 0x80 up are parts of words in every definition here, so words are the same
as by code points. Lower-casing touches A-Z only.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BYTES_PER_SLICE = 1 << 20

# Odd multipliers of the hashes (any odd numbers do).
RADIX = 0x9E3779B97F4A7C15
FOLD = 0xD6E8FEB86659FD93


def word_bytes(separators: bytes) -> np.ndarray:
    """Table of 256 flags: is the byte part of a word?"""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


# [^\x20\x09-\x0D]+
BLANK_SEPARATED = word_bytes(bytes([0x20, *range(0x09, 0x0E)]))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: 0-9, a-z and everything from 0x80 up
ALPHANUMERIC = word_bytes(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Words:
    """Words of some texts, one after the other. ``first[i]:first[i + 1]`` are those of text i."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text(self, begin: int, stop: int) -> list[str]:
        return [self.data[a:b].decode("utf-8", "replace") for a, b in zip(self.start[begin:stop], self.end[begin:stop])]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BYTES_PER_SLICE + 1024)
        for k, base in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def split_words(texts: list[bytes | None], inside: np.ndarray) -> Words:
    """Lower-case A-Z and split; null has no words."""
    texts = [t or b"" for t in texts]
    data = b" ".join(texts).lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = inside[raw]
    steps = np.diff(flags)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    powers, inverse = _radix_powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    return Words(data, start, end, hashes, np.searchsorted(start, begins))


def slices(texts: list[bytes | None], most: int = BYTES_PER_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes, or of one text."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k following words, and the word each starts at; none crosses texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    folded = words.hash[:n].copy()
    for j in range(1, k):
        folded = mix(folded * np.uint64(FOLD) + words.hash[j : n + j])
    counts = np.maximum(np.diff(words.first) - k + 1, 0)
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    starts = np.arange(int(counts.sum())) + np.repeat(words.first[:-1] - before, counts)
    return folded[starts], starts


def phrase_hash(phrase: str | list[str], inside: np.ndarray = ALPHANUMERIC) -> tuple[list[str], np.ndarray]:
    """The words of a short text and their hashes."""
    words = split_words([(phrase if isinstance(phrase, str) else " ".join(phrase)).encode()], inside)
    return words.text(0, len(words)), words.hash


def fold_hash(hashes: np.ndarray, start: int, k: int) -> int:
    """The hash ``runs`` gives to k following words."""
    with np.errstate(over="ignore"):
        folded = hashes[start : start + 1].copy()
        for j in range(1, k):
            folded = mix(folded * np.uint64(FOLD) + hashes[start + j : start + j + 1])
    return int(folded[0])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)

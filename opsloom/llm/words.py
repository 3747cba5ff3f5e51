"""The hashes of a text's words, computed from the bytes of all its words at once."""

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, none for blanks, and odd multipliers for the places of bytes in a word. Words longer than
#: the list of places are hashed one by one.
BYTES = np.random.default_rng(17).integers(1, 1 << 64, size=256, dtype=np.uint64)
BYTES[BLANK] = 0
PLACES = np.random.default_rng(23).integers(1, 1 << 64, size=1 << 12, dtype=np.uint64) | np.uint64(1)
#: Texts are hashed in pieces of about so many bytes, cut at blanks.
PIECE = 1 << 19


def raw_of(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower() if text else b""


def hashes_of_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, dtype=np.uint8)
    blank = BLANK[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.nonzero(first)[0]
    lines = np.searchsorted(starts, np.nonzero(b == 10)[0])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), lines
    b, blank, starts = b[starts[0] :], blank[starts[0] :], starts - starts[0]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    h = np.add.reduceat(BYTES[b] * PLACES[np.minimum(place, len(PLACES) - 1)], starts)
    if len(b) > len(PLACES):
        ends = np.nonzero(~blank & np.append(blank[1:], True))[0] + 1
        for k in np.nonzero(ends - starts > len(PLACES))[0].tolist():
            h[k] = xxhash.xxh3_64_intdigest(b[starts[k] : ends[k]].tobytes())
    h ^= h >> np.uint64(32)
    return h * MIX, lines


def words_and_lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words between ASCII blanks, and how many words lie before each line end."""
    found, lines, at, n = [], [], 0, 0
    while at < len(raw):
        cut = at + PIECE
        while cut < len(raw) and not BLANK[raw[cut]]:
            cut += 1
        h, ends = hashes_of_piece(raw[at:cut])
        found.append(h)
        lines.append(ends + n)
        n, at = n + len(h), cut
    if len(found) == 1:
        return found[0], lines[0]
    return (np.concatenate(found), np.concatenate(lines)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def word_hashes(raw: bytes) -> np.ndarray:
    return words_and_lines(raw)[0]


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each word on, or of all words where there are fewer."""
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64) if k else np.zeros(0, dtype=np.uint64)
    for i in range(k):
        out = out * MIX + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return out * MIX

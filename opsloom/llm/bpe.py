"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut at added tokens, then into words by the tokenizer's pattern. Each word's parts and the ranks of its
adjacent pairs lie in two contiguous rows; the smallest rank is found by a scan, the boundary behind it deleted and
the neighbouring ranks refreshed, until no pair has a rank. All words of a slice of texts that aren't remembered take
these steps together, as rows of one matrix. Words over `SHORT` bytes, where repeated scans would cost the square of the
length, take the same merges from a heap. Encoded words are remembered in bounded caches.

Token ids travel as little-endian unsigned 32-bit integers in a binary column. A null text encodes as the empty text;
an empty text gives no ids and decodes to the empty text. A text of any length is encoded whole, in one task. Texts are
encoded one by one, so ties and repeated rows change nothing; an empty table gives an empty table; extra columns stay.
"""

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import values

SHORT = 64
#: Words in a generation of those that a worker remembers, besides those of its present slice of texts.
CACHE = 3 << 15
#: Characters of a slice of texts, and cells of a matrix of words.
SLICE, CELLS = 1 << 19, 1 << 18
NO_RANK = 1 << 60
LATIN_END = "\u0250"
# Fixed value: white space other than spaces and line ends.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Fixed value: the pattern by which byte-level tokenizers of this family cut words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Small, fixed-size tables of one tokenizer file; safe to broadcast."""

    single: tuple[int, ...]  # id of each byte
    pairs: dict[int, int]  # left id << 32 | right id -> rank
    merged: tuple[int, ...]  # rank -> id of the merged token
    tokens: tuple[bytes, ...]  # id -> bytes
    added: dict[str, int]  # added tokens found in plain text

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE tokenizer without prefix space is expected")
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
        for text, i in ids.items():
            tokens[i] = text.encode() if text in added else bytes(alphabet[c] for c in text)
        for text, i in added.items():
            tokens[i] = text.encode()
        pairs, merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs[ids[left] << 32 | ids[right]] = rank
            merged.append(ids[left + right])
        single = [0] * 256
        for c, b in alphabet.items():
            single[b] = ids[c]
        return cls(tuple(single), pairs, tuple(merged), tuple(tokens), added)


class Merger:
    """Merges many words at once. A row of a matrix holds a word's parts, a second one the ranks of its adjacent pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.single = np.array(vocabulary.single, dtype=np.int64)
        self.merged = np.array(vocabulary.merged, dtype=np.int64)
        keys = np.fromiter(vocabulary.pairs, np.int64, len(vocabulary.pairs))
        ranks = np.fromiter(vocabulary.pairs.values(), np.int64, len(keys))
        order = np.argsort(keys)
        # A pair beyond all others ends the list, so that a search always finds a place.
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(ranks[order], NO_RANK)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a part of -1 is none."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of the words, in order; the words are alike in length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        parts = np.full((len(words), width), -1, dtype=np.int64)
        parts[inside] = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        done, place = parts.copy(), np.arange(len(words))
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(ranks)), best]
            go = rank < NO_RANK
            if not go.all():
                done[place[~go], : parts.shape[1]] = parts[~go]
                done[place[~go], parts.shape[1] :] = -1
                parts, ranks, place, best, rank = parts[go], ranks[go], place[go], best[go], rank[go]
                if not len(place):
                    break
            row = np.arange(len(place))
            parts[row, best] = self.merged[rank]
            # The boundary behind the part goes, and with it the merged pair's rank.
            column = np.arange(parts.shape[1] - 1)
            parts = parts[row[:, None], column + (column > best[:, None])]
            column = column[:-1]
            ranks = ranks[row[:, None], column + (column >= best[:, None])]
            if ranks.shape[1]:
                for at, there in ((best, best < ranks.shape[1]), (best - 1, best > 0)):
                    r, c = row[there], at[there]
                    ranks[r, c] = self.rank(parts[r, c], parts[r, c + 1])
        done[place, : parts.shape[1]] = parts
        done[place, parts.shape[1] :] = -1
        left = done >= 0
        packed = done[left].astype("<u4").tobytes()
        ends = 4 * np.cumsum(left.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_long(parts: list[int], pairs: dict[int, int], merged: tuple[int, ...]) -> list[int]:
    """The same merges in the same order, from a heap over a linked list."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pairs.get(parts[i] << 32 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j < 0 or parts[j] != right:
            continue
        parts[i], parts[j] = merged[rank], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := pairs.get(parts[a] << 32 | parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [p for p in parts if p >= 0]


def cut_spaced(s: str) -> list[str] | None:
    """What the pattern makes of a space and a plain stretch, Latin letters and perhaps one mark behind them."""
    if s.isalpha():
        return [" " + s] if s.isascii() or max(s) < LATIN_END else None
    if s[-1:] in (".", ",") and s[:-1].isalpha() and (s.isascii() or max(s) < LATIN_END):
        return [" " + s[:-1], s[-1]]
    return None


def even(t: str) -> bool:
    """Whether single spaces and line ends between other characters are the only white space."""
    return not ("  " in t or "\n " in t or " \n" in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n" or OTHER_SPACE.search(t))


class Remembered:
    """Packed ids by word, in two generations: when the young one is full it becomes the old one, whose entries come back when
    they are asked for again. So what is frequent stays, and no more than twice CACHE entries do."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}

    def missing(self, wanted: set[str]) -> set[str]:
        """What of `wanted` isn't known; what the old generation knows is young again."""
        fresh, old = wanted.difference(self.young), self.old
        if old:
            back = [w for w in fresh if w in old]
            self.young.update(zip(back, map(old.__getitem__, back), strict=True))
            fresh.difference_update(back)
        return fresh


class Encoder:
    """Encodes texts, a slice of them at a time: what words of a slice aren't remembered are merged together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.merger = vocabulary, Merger(vocabulary)
        self.cut = regex.compile(WORDS).findall
        self.words = Remembered()  # a word -> its packed ids
        self.spaced = Remembered()  # a stretch without white space -> the packed ids of a space and it
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of words. Words of similar length share a matrix; long ones are merged one by one."""
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in self.words.missing(words):
            raw = w.encode()
            found = classes.setdefault((len(raw) + 3) >> 2 if len(raw) <= SHORT else 0, ([], []))
            found[0].append(w)
            found[1].append(raw)
        for size, (found, raws) in classes.items():
            if size:
                step = CELLS // (4 * size)
                for a in range(0, len(found), step):
                    self.words.young.update(zip(found[a : a + step], self.merger.merge(raws[a : a + step]), strict=True))
            else:
                for w, raw in zip(found, raws, strict=True):
                    parts = [self.v.single[b] for b in raw]
                    self.words.young[w] = np.array(merge_long(parts, self.v.pairs, self.v.merged), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Where single spaces and line ends are the only white space, the pattern cuts before each space and around each
        line end, so that the stretches between them are remembered as wholes. Other texts are cut by the pattern."""
        self.words.age()
        self.spaced.age()
        lines = [None if not t or not even(t) or self.special(t) else [line.split(" ") for line in t.split("\n")] for t in texts]
        cuts = [[] if own is not None else [p if i % 2 else self.cut(p) for i, p in enumerate(self.parts(t))] for t, own in zip(texts, lines, strict=True)]
        wanted = {w for own in cuts for p in own[::2] for w in p}
        fresh = self.spaced.missing({s for own in lines if own for line in own for s in line[1:]})
        fresh = {s: cut_spaced(s) or self.cut(" " + s) for s in fresh}
        heads = {s: self.cut(s) for s in {line[0] for own in lines if own for line in own}}
        self.learn(wanted.union(*fresh.values(), *heads.values(), "\n"))
        word, spaced = self.words.young.__getitem__, self.spaced.young
        spaced.update(zip(fresh, [word(p[0]) if len(p) == 1 else b"".join(map(word, p)) for p in fresh.values()], strict=True))
        heads = {s: b"".join(map(word, p)) for s, p in heads.items()}
        ids = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.v.added.items()}
        out, end = [], word("\n")
        for own, cut in zip(lines, cuts, strict=True):
            if own is not None:
                out.append(end.join(b"".join([heads[line[0]], *map(spaced.__getitem__, line[1:])]) for line in own))
            else:
                out.append(b"".join(ids[p] if i % 2 else b"".join(map(word, p)) for i, p in enumerate(cut)))
        return out

    def special(self, text: str) -> bool:
        return self.added is not None and any(t in text for t in self.v.added)

    def parts(self, text: str) -> list[str]:
        """Plain text and added tokens by turns."""
        return self.added.split(text) if self.special(text) else [text]


_LAST: list[Encoder] = []


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """An encoder whose cache of words outlives the task, as long as the worker meets the same broadcast vocabulary."""
    if not _LAST or _LAST[0].v is not vocabulary:
        _LAST[:] = [Encoder(vocabulary)]
    return _LAST[0]


def decode_ids(packed: bytes, tokens: tuple[bytes, ...]) -> str:
    ids = np.frombuffer(packed, dtype="<u4").tolist()
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def slices(column: pa.Array) -> Iterator[list]:
    """The values of a column, some at a time: SLICE characters, but one value at least."""
    held, size = [], 0
    for x in values(column, 64):
        held.append(x)
        size += len(x) if x else 0
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """`df` with `out_col`: the packed token ids of `text_col`."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(shared.value)
        for texts in batches:
            yield pa.array([x for held in slices(texts) for x in encoder.encode([t or "" for t in held])], pa.binary())

    return df.withColumn(out_col, run(F.col(text_col)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`df` with `out_col`: the text of the packed token ids of `ids_col`; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = shared.value
        for ids in batches:
            yield pa.array([decode_ids(x, tokens) if x else "" for x in values(ids)], pa.string())

    return df.withColumn(out_col, run(F.col(ids_col)))


def encode_and_decode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "coded") -> DataFrame:
    """`df` with `out_col`, a struct of `ids`, the packed token ids of `text_col`, and `decoded`, their text: both in one
    pass of the text through one worker."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(shared.value)
        for texts in batches:
            ids = pa.array([x for held in slices(texts) for x in encoder.encode([t or "" for t in held])], pa.binary())
            decoded = pa.array([decode_ids(x, encoder.v.tokens) for x in values(ids)], pa.string())
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return df.withColumn(out_col, run(F.col(text_col)))

"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification, over words.

Benchmark items fall into classes by length; the windows of a class have the class's length in words. A window at every
word of every text is a candidate if enough pairs of its neighbouring words occur in items of its class: an edit leaves at
most two pairs of a window unexplained, so this count loses nothing that is within the edit limit. Each candidate is embedded by
CGK random walks: at step t the walk emits the word under its pointer and moves on if a random bit of (t, word) says so.
Words in edit distance d become strings whose Hamming distance is small with good probability. Walks with `BITS` sampled
positions each are hashed; a window and an item that agree on all sampled positions of a walk are a pair. A class has as many
walks as reach `TARGET` recall, up to MOST_WALKS, for a window with as many edits as the limit allows: the chance that one walk
agrees is measured on edited copies of the class's own items when the tables are built.
The walks' recall falls as edits grow with the item, so from `EXACT` words on they aren't used: there every window that passes
the count for an item's own word pairs is verified against that item, which loses nothing within the limit.
Pairs are verified by the exact semi-global edit distance over words, by a bit-parallel automaton.

Texts are lower-cased, words lose punctuation at their ends. A text within edit distance `LIMIT` times an item's words
of that item is contaminated by it. Null or empty texts and items match nothing; items that repeat each count; a text
that holds an item more than once reports its best place, of equals the first. Texts of any length are searched whole, in
pieces of PIECE words that overlap by more than the longest place. Rows that repeat an id are one document, which holds
what any of them holds. Empty tables give no rows. Columns other than id and text are ignored, whatever their names.

The benchmark is a stated query set: it is taken in blocks of at most `BLOCK_CHARS` characters, each of which is
broadcast, so the broadcast has a bound whatever the benchmark's size.
"""

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opsloom.llm.common import values

LIMIT = 0.25
BITS = 2
#: The recall that the walks of a class reach at the limit, the copies by which their chance is measured, and bounds.
TARGET, COPIES = 0.95, 300
LEAST_WALKS, MOST_WALKS = 10, 60
#: Windows of this length or more are verified without walks: the recall is 1.
EXACT = 32
GROWTH = 1.25
BLOCK_CHARS = 4_000_000
CACHE = 1 << 17
EDGES = "\"'`.,;:!?()[]{}<>#*$%&|-_/\\…“”‘’«»"
#: Words of texts that are searched together, and of a piece of a longer text.
SLICE, PIECE = 300_000, 200_000


def bare_words(text: str) -> list[str]:
    return [b for w in text.lower().split() if (b := w.strip(EDGES))]


def window_length(n: int) -> int:
    """The length of the windows for items of n words: the largest of a geometric series that isn't longer."""
    return n if n < 8 else int(8 * GROWTH ** int(math.log(n / 8, GROWTH) + 1e-9))


@dataclass
class Group:
    """Items of one window length, their words, and the LSH tables of all walks."""

    length: int
    allowed: int = 0
    items: list = field(default_factory=list)  # (item id, array of word ids)
    samples: list = field(default_factory=list)  # for each walk the sampled steps
    keys: list = field(default_factory=list)  # for each walk the sorted keys
    owners: list = field(default_factory=list)  # and the items they belong to


@dataclass
class Index:
    words: dict[str, int]
    member: np.ndarray  # word id -> bit mask of groups
    pairs: np.ndarray  # hash of two neighbouring word ids -> bit mask of groups
    groups: list[Group]
    seed: int


def bits(seed: int, step: int, words: np.ndarray) -> np.ndarray:
    """A random bit for each word at a step of a walk."""
    x = (words.astype(np.uint64) + np.uint64(seed * 1_000_003 + step * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def walk_keys(text: np.ndarray, starts: np.ndarray, length: int, seed: int, sampled: np.ndarray) -> np.ndarray:
    """Runs one walk from every start at once; the hash of the words that it emits at the sampled steps."""
    at = np.zeros(len(starts), dtype=np.int64)
    key = np.zeros(len(starts), dtype=np.uint64)
    wanted = set(sampled.tolist())
    for step in range(max(wanted) + 1):
        inside = at < length
        word = np.where(inside, text[np.minimum(starts + at, len(text) - 1)], 0)
        if step in wanted:
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) + np.uint64(0x1234567))
            key ^= key >> np.uint64(29)
        at += bits(seed, step, word)
    return key


PAIR_TABLE = 1 << 20


def pair_slots(ids: np.ndarray) -> np.ndarray:
    """A slot of the table of pairs for each word and its successor; slot 0 where one of them is of no item."""
    slots = np.maximum(((ids[:-1] * 1_000_003) ^ (ids[1:] * 7919)) & (PAIR_TABLE - 1), 1)
    slots[(ids[:-1] == 0) | (ids[1:] == 0)] = 0
    return slots


def build(items: list[tuple], seed: int = 1) -> Index:
    vocabulary: dict[str, int] = {}
    groups: dict[int, Group] = {}
    for item, text in items:
        words = bare_words(text or "")
        if words:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64)
            g = groups.setdefault(window_length(len(ids)), Group(window_length(len(ids))))
            g.items.append((item, ids))
            g.allowed = max(g.allowed, int(LIMIT * len(ids)))
    ordered = sorted(groups.values(), key=lambda g: g.length)
    member, pairs = np.zeros(len(vocabulary) + 1, dtype=np.int64), np.zeros(PAIR_TABLE, dtype=np.int64)
    for c, g in enumerate(ordered):
        for _, ids in g.items:
            member[ids] |= 1 << c
            pairs[pair_slots(ids)] |= 1 << c
    pairs[0] = 0
    for c, g in enumerate(ordered):
        rng = np.random.default_rng(seed + g.length)
        flat = np.concatenate([ids[: g.length] for _, ids in g.items])
        starts = np.arange(len(g.items)) * g.length
        if g.length >= EXACT:
            continue
        walks = [np.sort(rng.choice(3 * g.length, size=min(BITS, 3 * g.length), replace=False) * 2 // 3) for _ in range(MOST_WALKS)]
        for r, sampled in enumerate(walks[: walks_wanted(g, c, member, pairs, walks, seed, rng)]):
            keys = walk_keys(flat, starts, g.length, seed + r, sampled)
            order = np.argsort(keys, kind="stable")
            g.samples.append(sampled)
            g.keys.append(keys[order])
            g.owners.append(order)
    return Index(vocabulary, member, pairs, ordered, seed)


def edited(ids: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many insertions, deletions and substitutions at random places; new words are of no item."""
    words = ids.tolist()
    for _ in range(edits):
        at = int(rng.integers(len(words))) if words else 0
        words[at : at + int(rng.integers(2))] = [0] * int(rng.integers(2))
    return np.array(words, dtype=np.int64)


def candidates(g: Group, c: int, flat: np.ndarray, member: np.ndarray, pairs: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The words from which windows begin that hold enough of the pairs of words, or of the words, of a class's items."""
    least = g.length - 1 - 2 * g.allowed
    if least > 0:
        known, span = np.concatenate([[0], np.cumsum((pairs[slots] >> c) & 1)]), g.length - 1
    else:
        known, span, least = np.concatenate([[0], np.cumsum((member[flat] >> c) & 1)]), g.length, max(1, g.length - g.allowed)
    return np.nonzero(known[span:] - known[:-span] >= least)[0]


def walks_wanted(g: Group, c: int, member: np.ndarray, pairs: np.ndarray, walks: list, seed: int, rng: np.random.Generator) -> int:
    """How many walks find TARGET of edited copies of the class's items, each from any window around the copy that is a
    candidate, as a search would."""
    width = 4 * g.length + 2 * g.allowed
    flat, whole = np.zeros(COPIES * width, dtype=np.int64), []
    for k in range(COPIES):
        ids = g.items[k % len(g.items)][1]
        copy = edited(ids, int(LIMIT * len(ids)), rng)
        flat[k * width + g.length : k * width + g.length + len(copy)] = copy
        whole.append(ids[: g.length])
    starts = candidates(g, c, flat, member, pairs, pair_slots(flat))
    owner, whole = starts // width, np.concatenate(whole)
    found, places = np.zeros(COPIES, dtype=bool), np.arange(COPIES) * g.length
    for r, sampled in enumerate(walks):
        same = walk_keys(whole, places, g.length, seed + r, sampled)[owner] == walk_keys(flat, starts, g.length, seed + r, sampled)
        found[owner[same]] = True
        if r + 1 >= LEAST_WALKS and found.mean() >= TARGET:
            return r + 1
    return len(walks)


class Masks(dict):
    """Word id of an item -> bit mask of its places, for the bit-parallel edit distance."""

    def __init__(self, ids: np.ndarray):
        super().__init__()
        for i, w in enumerate(ids.tolist()):
            self[w] = self.get(w, 0) | 1 << i
        self.n = len(ids)


def best_match(masks: Masks, text: list[int]) -> tuple[int, int]:
    """The least edit distance between the item and any stretch of the text, and the end of the first such stretch."""
    n = masks.n
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
    return best, end


def search(index: Index, texts: list[list[int]], masks: dict) -> Iterator[tuple[int, object, int, int, int]]:
    """(text, item, distance, end word, item words) of the items found in a slice of texts given as word ids."""
    gap = max(g.length for g in index.groups) + 1
    lengths = [len(t) for t in texts]
    flat = np.zeros(sum(lengths) + gap * (len(texts) + 1), dtype=np.int64)
    offsets, at = [], gap
    for t in texts:
        flat[at : at + len(t)] = t
        offsets.append(at)
        at += len(t) + gap
    offsets = np.array(offsets)
    slots = pair_slots(flat)
    for c, g in enumerate(index.groups):
        starts = candidates(g, c, flat, index.member, index.pairs, slots)
        if not len(starts):
            continue
        pairs = set()
        for r, sampled in enumerate(g.samples):
            keys = walk_keys(flat, starts, g.length, index.seed + r, sampled)
            lo, hi = np.searchsorted(g.keys[r], keys, "left"), np.searchsorted(g.keys[r], keys, "right")
            for k in np.nonzero(hi > lo)[0].tolist():
                pairs.update((int(i), int(starts[k])) for i in g.owners[r][lo[k] : hi[k]])
        if g.length >= EXACT:
            # The same count, over each item's own pairs, where candidate windows lie.
            cover = np.zeros(len(flat) + 1, dtype=np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + g.length - 1, -1)
            place = np.nonzero(np.cumsum(cover)[:-1])[0]
            inside, first = slots[place], np.searchsorted(place, starts)
            for i, (_, ids) in enumerate(g.items):
                own = np.unique(pair_slots(ids))
                known = np.concatenate([[0], np.cumsum(np.isin(inside, own[own > 0]))])
                near = known[first + g.length - 1] - known[first] >= g.length - 1 - 2 * int(LIMIT * len(ids))
                pairs.update((i, int(s)) for s in starts[near])
        done = defaultdict(lambda: -1)
        for i, start in sorted(pairs):
            if start <= done[i]:
                continue
            item, ids = g.items[i]
            limit = int(LIMIT * len(ids))
            owner = int(np.searchsorted(offsets, start + g.length // 2, "right")) - 1
            owner = max(owner, 0)
            a = max(int(offsets[owner]), start - limit)
            b = min(int(offsets[owner]) + lengths[owner], start + len(ids) + 2 * limit + 1)
            if (c, i) not in masks:
                masks[c, i] = Masks(ids)
            distance, end = best_match(masks[c, i], flat[a:b].tolist())
            done[i] = start + limit
            if distance <= limit:
                yield owner, item, distance, a + end - int(offsets[owner]), len(ids)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`id_col`, `item_col`, the least edit distance, the item's words and the word at which the place ends, for every
    text and every item that it holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    items = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")).where(F.length("_text") > 0)
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _item {items.schema['_item'].dataType.simpleString()}, distance int, end_word int, item_words int"
    item_type = to_arrow_type(items.schema["_item"].dataType)
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("_text"))).first()[0] or 0) / BLOCK_CHARS))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b)
        index = build(sorted(((r["_item"], r["_text"]) for r in block.collect()), key=lambda x: (str(x[0]), x[1])))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, masks = shared.value, {}
            number = WordIds(index.words)
            longest = max((int(len(ids) * (1 + 2 * LIMIT)) + 2 for g in index.groups for _, ids in g.items), default=0)
            for batch in batches:
                for pieces in slices_of(batch.column(1), number, longest):
                    rows = list(search(index, [p[2] for p in pieces], masks)) if index.groups else []
                    owners = pa.array([pieces[r[0]][0] for r in rows], pa.int64())
                    ends = pa.array([pieces[r[0]][1] + r[3] for r in rows], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(owners), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int32()), ends, pa.array([r[4] for r in rows], pa.int32())],
                        names=["_id", "_item", "distance", "end_word", "item_words"],
                    )

        part = docs.select("_id", "_text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("distance", "end_word", "item_words"))
    found = found.groupBy("_id", "_item").agg(best.alias("m"))
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "m.distance", "m.item_words", "m.end_word")


class WordIds(dict):
    """Word as written -> id among the items' words, 0 for other words, -1 for punctuation alone; bounded."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES)
        value = self.words.get(core, 0) if core else -1
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def slices_of(texts: pa.Array, number: WordIds, overlap: int) -> Iterator[list[tuple[int, int, list[int]]]]:
    """The texts' words in pieces (row, first word, word ids), SLICE words of them at a time."""
    held, size = [], 0
    for row, text in enumerate(values(texts, 64)):
        ids = [i for i in map(number.__getitem__, text.lower().split()) if i >= 0]
        for at in range(0, max(1, len(ids)), PIECE):
            held.append((row, at, ids[at : at + PIECE + overlap]))
            size += len(held[-1][2])
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """The ids of contaminated documents, each once."""
    return matches(docs, items, **columns).select(columns.get("id_col", "doc_id")).distinct()

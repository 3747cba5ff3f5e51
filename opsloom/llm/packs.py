"""Shuffles of many small entries: a row holds the entries of a group as bytes, a column of numbers each.

Entries with a 64-bit key are dealt to ranges of keys, or to parts of the documents, so many that a range or part has about
RANGE entries. An entry costs its bytes, not a row. A task gets a range, or in very large corpora several, one after the other.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.words import MIX

#: Entries that one range or part holds on average.
RANGE = 1_500_000
#: Tasks of a shuffle at most.
TASKS = 10_000
#: A key with so many entries passes the ranges by; in larger corpora the number rises, so that at most HOT_LISTED are listed.
HOT, HOT_LISTED = 100_000, 200_000


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where the columns' values, in order, differ from the ones before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def packed(group: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each group: `group`, and the values of every column as bytes. Entries keep their order in a group."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.nonzero(firsts(group))[0]
    ends = starts + np.diff(starts, append=len(group))
    arrays = [pa.array(group[starts].astype(np.int64))]
    for column in columns.values():
        column = column[order]
        arrays.append(pa.array([column[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["group", *columns])


def unpacked(table: pa.Table | pa.RecordBatch, **kinds) -> list[np.ndarray]:
    """The entries of all rows, a column each."""
    found = []
    for name, kind in kinds.items():
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        found.append(np.concatenate(parts) if parts else np.zeros(0, dtype=kind))
    return found


def by_group(packs: DataFrame, groups: int, run: Callable[[int, pa.Table], pa.Table], kind: str) -> DataFrame:
    """What `run` makes of each group's number and rows. Groups are numbered from 0 on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            starts = np.nonzero(firsts(numbers))[0]
            for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True):
                if held and numbers[a] != now:
                    yield from run(now, pa.Table.from_batches(held)).to_batches()
                    held = []
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(now, pa.Table.from_batches(held)).to_batches()

    tasks = min(groups, TASKS)
    dealt = packs.repartitionById(tasks, F.expr(f"cast(group * {tasks} div {groups} as int)"))
    return dealt.sortWithinPartitions("group").mapInArrow(each, kind)


def schema(names) -> str:
    return "group long, " + ", ".join(f"{n} binary" for n in names)


def share_of(h: np.ndarray, n: int) -> np.ndarray:
    """The range, of n ranges of equal width, that a 64-bit hash lies in."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def part_of(doc: np.ndarray, n: int) -> np.ndarray:
    return share_of(doc.view(np.uint64) * MIX, n)


#: An entry: a key, the document's number, a place in it; once it is known, the smallest document with the key.
ENTRY = {"key": np.uint64, "doc": np.int64, "at": np.uint32}
SHARED = ENTRY | {"source": np.int64}


def entries(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ranges: int) -> pa.RecordBatch:
    return packed(share_of(key, ranges), key=key, doc=doc, at=at.astype(np.uint32))


def smallest(packs: DataFrame, least: int, among: np.ndarray | None = None) -> DataFrame:
    """For each key the entries' documents in `packs`, n, and the smallest of them, each row of `packs` counted alone first:
    of all keys that `least` or more documents of a row have, or of the sorted keys `among`."""
    listed = packs.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, doc = unpacked(batch.slice(i, 1), key=np.uint64, doc=np.int64)
                if listed is not None:
                    known = np.isin(key, listed.value)
                    key, doc = key[known], doc[known]
                order = np.lexsort((doc, key))
                order = order[firsts(key[order], doc[order])]
                starts = np.nonzero(firsts(key[order]))[0]
                n = np.diff(starts, append=len(order))
                starts, n = starts[n >= least], n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(key[order[starts]].view(np.int64)), pa.array(n), pa.array(doc[order[starts]])], names=["key", "n", "source"])

    rows = packs.select("key", "doc").mapInArrow(run, "key long, n long, source long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("source").alias("source"))


def hot_keys(packs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that too many documents have for a range, sorted, and the smallest document of each. A key that is alone in
    every row of `packs` isn't among them, but has no more entries in its range than there are rows."""
    rows = smallest(packs, 2).where(F.col("n") >= max(HOT, total // HOT_LISTED)).select("key").toPandas()
    hot = np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))
    if not len(hot):
        return hot, np.zeros(0, dtype=np.int64)
    rows = smallest(packs, 1, hot).select("key", "source").toPandas()
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    return hot, rows["source"].to_numpy(np.int64)[np.argsort(key)]


def shared(packs: DataFrame, ranges: int, total: int) -> DataFrame:
    """The entries whose key two or more documents have, with the smallest of these as source, packed by part of the
    documents. `packs` is a table of entries(). Hot keys, whose sources are found before the shuffle, are dealt by part of
    the documents, so that no range holds more than it can."""
    hot = hot_keys(packs, total)
    listed = packs.sparkSession.sparkContext.broadcast(hot)  # HOT_LISTED at most
    if len(hot[0]):

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = listed.value[0]
            for batch in batches:
                for i in range(batch.num_rows):
                    key, doc, at = unpacked(batch.slice(i, 1), **ENTRY)
                    known = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    yield packed(np.where(known, ranges + part_of(doc, ranges), share_of(key, ranges)), key=key, doc=doc, at=at)

        packs = packs.mapInArrow(split, schema(ENTRY))

    def run(group: int, table: pa.Table) -> pa.Table:
        key, doc, at = unpacked(table, **ENTRY)
        if group < ranges:
            order = np.argsort(key, kind="stable")
            # Most keys have one entry: these go first, which spares the full sort by document.
            first = firsts(key[order])
            order = order[~(first & np.append(first[1:], True))]
            order = order[np.lexsort((at[order], doc[order], key[order]))]
            key, doc, at = key[order], doc[order], at[order]
            starts = np.nonzero(firsts(key))[0]
            sizes = np.diff(starts, append=len(key))
            several = doc[starts] != doc[starts + sizes - 1]
            keep = np.repeat(several, sizes)
            source = np.repeat(doc[starts], sizes)[keep]
            key, doc, at = key[keep], doc[keep], at[keep]
        else:
            keys, least = listed.value
            source = least[np.searchsorted(keys, key)]
        return pa.Table.from_batches([packed(part_of(doc, ranges), key=key, doc=doc, at=at, source=source)])

    return by_group(packs, 2 * ranges if len(hot[0]) else ranges, run, schema(SHARED))

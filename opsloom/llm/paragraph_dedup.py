r"""Substring deduplication: paragraph MinHash banding, exact verification, and removals clustered by components.

Two kinds of paragraphs are banded by MinHash over word 5-grams and joined on colliding bands:

* Parts: stretches of `PART` words that begin at words chosen by content. A word is chosen if the hash of the PART words from
  it on is the least of those from any PASSAGE - PART + 1 neighbouring words. So every PASSAGE words that two documents
  share hold an equal part, wherever lines and sentences end. Equal parts collide in any band; one band is made.
* Lines of PASSAGE or more words, in `BANDS` bands of `ROWS` values: at a similarity of 0.75 a pair collides with probability
  1 - (1 - 0.75^ROWS)^BANDS, 0.98 here.

Collisions are verified. For parts, the stretches of PASSAGE words around them are compared by their hashes, whole: what two
documents share is found word by word, however many words, and nothing that is shorter. The smallest id that has a stretch is
its source. For lines that collide, the exact Jaccard similarity of their 5-grams decides, in the n-gram join over these lines
alone: a line leaves whose 5-grams are too rarely shared for any link, and the rest are compared in groups until every pair
is in one component or verified apart. The first document of a component of lines is their source.

Filler isn't a passage: a word or a phrase said over and over is no sign of copying. PASSAGE words, or a line, count if at
least half of their 5-grams differ.

Documents and the sources of their passages form components; in each, the sources keep the passages and the others'
stretches are removals. Edits within a stretch of PASSAGE words that doesn't fill a line hide it: it is neither equal nor a
line.

Null and empty texts, and texts of fewer than PASSAGE words, have no paragraph. Texts of any length are read whole; a text's
words have to fit a task. Ties don't matter: the smallest id decides. Rows that repeat an id are read as that document's text
each; a document is never a repeat of itself. Rows without an id are left out, since no removal could name them. Ids that
aren't integers are compared by their hash. An empty table has no repeats. Other columns are ignored, whatever their names.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm import packs
from opsloom.llm.common import Tables, scratch, values
from opsloom.llm.components import components
from opsloom.llm.jaccard_join import link_sets, name_of, sets_of_lists
from opsloom.llm.words import MIX, grams, raw_of, words_and_lines

PASSAGE, PART = 50, 25
BANDS, ROWS = 5, 2
SHINGLE = 5
#: Words of texts that are searched together.
FLUSH = 1_000_000
SEEDS = np.random.default_rng(5).integers(1, 1 << 63, size=2 * (2 + BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def lows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each value on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = [powers(int(MIX), 1 << 12), powers(pow(int(MIX), -1, 1 << 64), 1 << 12)]


def stretches(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on."""
    n = len(h)
    if n > len(_POWERS[0]):
        _POWERS[:] = [powers(int(MIX), 2 * n), powers(pow(int(MIX), -1, 1 << 64), 2 * n)]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _POWERS[0][:n], dtype=np.uint64)])
    x = (sums[k:] - sums[:-k]) * _POWERS[1][: n - k + 1]
    x ^= x >> np.uint64(32)
    x *= SEEDS[0]
    return x ^ (x >> np.uint64(29))


def chosen(h: np.ndarray) -> np.ndarray:
    """The words at which parts begin."""
    x, width = stretches(h, PART), PASSAGE - PART + 1
    least = lows(x, width)
    # A value is the least of some window if the greatest of its windows' least values is as great as it is.
    edge = np.zeros(width - 1, dtype=np.uint64)
    greatest = ~lows(~np.concatenate([edge, least, edge]), width)
    return np.nonzero(greatest == x)[0]


def low_hashes(g: np.ndarray, i: int) -> np.ndarray:
    x = (g ^ SEEDS[2 * i]) * SEEDS[2 * i + 1]
    return x ^ (x >> np.uint64(32))


def bands_of_parts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The band of each part: two MinHash values of the 5-grams in it."""
    g = grams(h, SHINGLE)
    a, b = (lows(low_hashes(g, i), PART - SHINGLE + 1)[starts] for i in (0, 1))
    key = (a * MIX) ^ b
    return (key ^ (key >> np.uint64(31))) * MIX


def long_lines(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines of PASSAGE or more words begin and end."""
    ends = np.append(ends, len(h))
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= PASSAGE
    return starts[long], ends[long]


def bands_of_lines(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of bands for each line, over the 5-grams that lie within it."""
    g = grams(h, SHINGLE)
    edges = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
    bands = []
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            x = np.append(low_hashes(g, 2 + b * ROWS + r), np.uint64(0xFFFFFFFFFFFFFFFF))
            key = (key * MIX) ^ np.minimum.reduceat(x, edges)[::2]
            key ^= key >> np.uint64(31)
        bands.append(key * MIX)
    return np.stack(bands, axis=1)


class Paragraphs:
    """The paragraphs of a text."""

    def __init__(self, text: str):
        self.h, ends = words_and_lines(raw_of(text))
        self.starts = self.keys = np.zeros(0, dtype=np.uint64)
        self.lines, self.bands = [], np.zeros((0, BANDS), dtype=np.uint64)
        if len(self.h) >= PASSAGE:
            self.starts = chosen(self.h)
            self.keys = bands_of_parts(self.h, self.starts)
            a, b = long_lines(self.h, ends)
            if len(a):
                self.lines, self.bands = list(zip(a.tolist(), b.tolist(), strict=True)), bands_of_lines(self.h, a, b)


def together(found: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(found) if found else np.zeros(0, dtype=kind)


def paragraph_entries(docs: DataFrame, ranges: int) -> DataFrame:
    """Packed entries: the bands of the paragraphs of each text, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, size = [], [], 0
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), values(batch.column(1), 256), strict=True):
                p = Paragraphs(text)
                key.append(np.unique(np.concatenate([p.keys, p.bands.ravel()])))
                doc.append(np.full(len(key[-1]), number, dtype=np.int64))
                size += len(p.h)
                if size >= 4 * FLUSH:
                    k, d = together(key), together(doc)
                    yield packs.entries(k, d, np.zeros(len(k)), ranges)
                    key, doc, size = [], [], 0
        k, d = together(key), together(doc, np.int64)
        yield packs.entries(k, d, np.zeros(len(k)), ranges)

    return docs.select("_doc", "_text").mapInArrow(run, packs.schema(packs.ENTRY))


def keys_of_documents(found: DataFrame, ranges: int) -> DataFrame:
    """_doc and its `_keys`, a row for each document, from packed entries."""
    kind = pa.schema([("_doc", pa.int64()), ("_keys", pa.list_(pa.int64()))])

    def run(group: int, table: pa.Table) -> pa.Table:
        key, doc = packs.unpacked(table, key=np.uint64, doc=np.int64)
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        starts = np.nonzero(packs.firsts(doc))[0]
        offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(doc[starts]), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))], schema=kind)

    return packs.by_group(found.select("group", "key", "doc"), ranges, run, "_doc long, _keys array<long>")


def windows(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The words at which PASSAGE words begin that hold a part from one of `starts` on."""
    n = len(h) - PASSAGE + 1
    edge = np.zeros(len(h) + 2, dtype=np.int32)
    np.add.at(edge, np.maximum(starts + PART - PASSAGE, 0), 1)
    np.add.at(edge, starts + 1, -1)
    return np.nonzero(np.cumsum(edge)[:n] > 0)[0]


def varied(g: np.ndarray) -> np.ndarray:
    """For each word from which PASSAGE words begin whether at least half of their 5-grams differ. `g` has the 5-grams' hashes."""
    span, n = PASSAGE - SHINGLE + 1, len(g)
    order = np.argsort(g, kind="stable")
    again = np.nonzero(g[order][1:] == g[order][:-1])[0]
    here, before = order[again + 1], order[again]
    near = here - before < span
    here, before = here[near], before[near]
    # A repeat counts in the windows that hold both places.
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(here - span + 1, 0), 1)
    np.add.at(edge, before + 1, -1)
    return 2 * np.cumsum(edge)[: n - span + 1] <= span


COLLIDING = f"{packs.schema(packs.ENTRY)}, content long, doc_ long, start int, size int, grams array<long>"


def colliding(docs: DataFrame, ranges: int) -> DataFrame:
    """For texts with their colliding `_keys`: packed entries of the stretches of PASSAGE words around parts; rows with
    content, doc_, start and size of lines; and rows with content and grams of lines, each once a flush."""
    names = ["group", *packs.ENTRY, "content", "doc_", "start", "size", "grams"]
    kinds = [pa.int64(), *[pa.binary()] * len(packs.ENTRY), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, at, size, lines, contents = [], [], [], 0, [], {}

        def flush():
            k = together(key)
            found = packs.entries(k, together(doc, np.int64), together(at, np.int64), ranges)
            yield rows(**{c: found.column(c) for c in found.schema.names})
            if lines:
                content, owner, start, length = (list(x) for x in zip(*lines, strict=True))
                yield rows(content=content, doc_=owner, start=start, size=length)
                yield rows(content=list(contents), grams=list(contents.values()))
            key.clear(), doc.clear(), at.clear(), lines.clear(), contents.clear()

        for batch in batches:
            for i, text in enumerate(values(batch.column(1), 256)):
                number, wanted = batch.column(0)[i].as_py(), batch.column(2)[i].values.to_numpy().view(np.uint64)
                p = Paragraphs(text)
                hits = p.starts[np.isin(p.keys, wanted)]
                g = grams(p.h, SHINGLE) if len(hits) or len(p.lines) else None
                starts = windows(p.h, hits) if len(hits) else np.zeros(0, dtype=np.int64)
                starts = starts[varied(g)[starts]] if len(starts) else starts
                if len(starts):
                    key.append(stretches(p.h, PASSAGE)[starts])
                    at.append(starts)
                    doc.append(np.full(len(starts), number, dtype=np.int64))
                for (a, b), own in zip(p.lines, p.bands, strict=True):
                    if np.isin(own, wanted).any():
                        line = np.unique(g[a : b - SHINGLE + 1])
                        if 2 * len(line) >= b - a - SHINGLE + 1:
                            content = name_of(line)
                            lines.append((content, number, a, b - a))
                            contents[content] = line.view(np.int64)
                size += len(p.h)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("_doc", "_text", "_keys").mapInArrow(run, COLLIDING)


def equal_passages(found: DataFrame, ranges: int) -> DataFrame:
    """doc, source, start, end of the stretches that repeat another document's, joined where they overlap or touch, from the
    packed entries of stretches of PASSAGE words."""
    kind = pa.schema([("doc", pa.int64()), ("source", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(group: int, table: pa.Table) -> pa.Table:
        doc, at, source = packs.unpacked(table, doc=np.int64, at=np.uint32, source=np.int64)
        order = np.lexsort((at, source, doc))
        order = order[doc[order] != source[order]]
        doc, at, source = doc[order], at[order].astype(np.int64), source[order]
        first = packs.firsts(doc, source)
        first[1:] |= at[1:] > at[:-1] + PASSAGE
        starts = np.nonzero(first)[0]
        last = np.append(starts[1:], len(at))[: len(starts)] - 1
        return pa.Table.from_arrays([pa.array(doc[starts]), pa.array(source[starts]), pa.array(at[starts].astype(np.int32)), pa.array((at[last] + PASSAGE).astype(np.int32))], schema=kind)

    return packs.by_group(found.select("group", "doc", "at", "source"), ranges, run, "doc long, source long, start int, end int")


def similar_lines(found: DataFrame, tables: Tables) -> DataFrame:
    """doc, source, start, end of lines that are similar to a line of another document with other content."""
    lines = found.where("start is not null").select("content", F.col("doc_").alias("doc"), "start", "size")
    contents = found.where("grams is not null").groupBy(F.col("content").alias("_id")).agg(F.first("grams").alias("grams"))
    contents = tables.write(contents, "lines")
    _, labels = link_sets(contents, sets_of_lists, "lines")
    tables.drop(contents)
    lines = lines.join(labels.select(F.col("id").alias("content"), "comp"), "content")
    sources = lines.groupBy("comp").agg(F.min("doc").alias("source"))
    return lines.join(sources, "comp").where("doc <> source").select("doc", "source", "start", (F.col("start") + F.col("size")).alias("end"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, source, start, end: the repeated passages, as words of the document, and the document they repeat."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    number = F.col("_id").cast("long") if whole else F.xxhash64("_id")
    docs = docs.withColumn("_doc", number)
    tables = Tables(docs.sparkSession, "paragraphs")
    long = docs.where(F.length("_text") >= 2 * PASSAGE - 1)
    # A word has two characters with its blank at least; a part begins at about every thirteenth word.
    chars = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    ranges = 1 + chars // (60 * packs.RANGE)
    first = tables.write(paragraph_entries(long, ranges), "paragraphs")
    keys = tables.write(keys_of_documents(packs.shared(first, ranges, chars // 60), ranges), "keys")
    tables.drop(first)
    total = PART * (keys.agg(F.sum(F.size("_keys"))).first()[0] or 0)
    ranges = 1 + total // packs.RANGE
    found = tables.write(colliding(long.join(keys, "_doc"), ranges), "colliding")
    equal = packs.shared(found.where("group is not null").select("group", *packs.ENTRY), ranges, total)
    equal = tables.write(equal_passages(equal, ranges), "equal")
    passages = equal.union(similar_lines(found, tables)).distinct()
    passages = tables.write(passages, "passages")
    tables.drop(keys, found, equal)
    if whole:
        return passages.select(F.col("doc").cast(kind).alias("_id"), F.col("source").cast(kind).alias("source"), "start", "end")
    names = docs.select("_id", "_doc").distinct()
    passages = passages.join(names.select(F.col("_doc").alias("doc"), "_id"), "doc")
    return passages.join(names.select(F.col("_doc").alias("source"), F.col("_id").alias("_source")), "source").select("_id", F.col("_source").alias("source"), "start", "end")


def joined(spans: DataFrame) -> DataFrame:
    """_id, start, end: a document's spans, joined where they overlap or touch, whatever their sources."""
    own = Window.partitionBy("_id").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select("_id", "start", "end").withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("_id", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_span")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with a repeated passage, sources included: the id, `cluster_id` (the smallest id of the
    component), and `removals`, an array of struct<start, end> of the word ranges that repeat another document's, in order
    and apart from each other."""
    found = repeats(docs, id_col, text_col)
    links = found.select(F.col("_id").alias("a"), F.col("source").alias("b"))
    labels = components(links)
    own = found.select("_id").union(found.select("source")).distinct()
    spans = joined(found).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removals"))
    rows = own.join(spans, "_id", "left").join(labels.select(F.col("id").alias("_id"), "comp"), "_id", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(F.col("_id").alias(id_col), F.coalesce("comp", "_id").alias("cluster_id"), F.coalesce("removals", none).alias("removals"))


def remove(df: DataFrame, removals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without the words in `removals` (a table as clusters() returns it) and the blanks behind them; other words, other
    white space and all line ends stay."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([without(t, s) for t, s in zip(values(texts), values(spans), strict=True)], pa.string())

    name = scratch(df, "_removals")
    spans = removals.select(F.col(id_col), F.col("removals").alias(name))
    return df.join(spans, id_col, "left").withColumn(text_col, run(text_col, name)).select(df.columns)


def without(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    gone = set()
    for s in spans:
        gone.update(range(s["start"], s["end"]))
    out, n, removed = [], 0, False
    for piece in re.findall(r"[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+", text):
        if piece[0] in " \t\n\r\x0b\x0c":
            out.append("\n" * piece.count("\n") if removed else piece)
        else:
            removed = n in gone
            n += 1
            if not removed:
                out.append(piece)
    return "".join(out)

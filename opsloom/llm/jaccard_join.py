r"""N-gram Jaccard self-join by rare-first prefix filtering, and the components of its links.

A document's set holds the 64-bit hashes of its distinct word n-grams (see `shingles`). Two documents link when the Jaccard
similarity of their sets reaches NUMERATOR / 100. Documents with equal sets are one node, named by a hash of the set.

1. Every shingle is counted over all nodes. Shingles and their nodes travel packed, sorted into ranges of hashes, a range
   for each `packs.RANGE` shingles of the corpus; copies within a task's flush travel once. Shingles so frequent that a range
   couldn't hold them (`hot_shingles`) are counted first and pass the ranges by.
2. The shingles that two or more nodes share go back to their nodes, packed likewise. A set is ordered rare first, by count
   and hash, so its unshared shingles come first. A node whose shared shingles are too few for any link leaves here:
   nodes of ordinary prose do, however many lines they share.
3. Nodes that link share a shingle of the index prefix (1/7 of the smaller set) and of the probe prefix (1/4 of the larger).
   Nodes of a shared prefix shingle are first compared with a few pivots of its group only, since a group of near copies
   needs no more than its links to the pivots to be connected. `ROUNDS` rounds take other pivots for what is still apart.
4. At last every pair that shares a prefix shingle, lies in different components and passes the length, positional and
   suffix filters is verified, once. This makes the components exact whatever the pivots were. Pairs within a component,
   and so within a group of copies, are never formed.

The suffix filter bounds the Hamming distance of two nodes' shared shingles from below: a shingle flips one of 64 * `SIGNS`
bits, and bits that differ between two nodes need as many shingles that differ. It is part of the join's condition.
Verification intersects the shared shingles, which is exact: what isn't shared is in no intersection.

Null or empty texts, and texts without words, have the empty set and link with nothing. A text of any length is read whole;
its set has to fit a task. Ties don't matter: components don't depend on an order. Rows that repeat an id, or have none, are
rows of their own: each is returned, and a component's id is the smallest that isn't null. An empty table gives no rows.
Columns other than id and text are ignored, whatever their names.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm import packs
from opsloom.llm.common import Tables
from opsloom.llm.components import components
from opsloom.llm.words import grams, raw_of, word_hashes

WORDS = 5
NUMERATOR = 75
#: Shingles of a flush.
FLUSH = 1_000_000
#: A shingle of so many nodes passes the ranges by; in larger corpora the number rises, as packs.HOT_LISTED says.
HOT = packs.HOT
SIGNS = 8
ROUNDS = 4
PIVOTS = 3
COMPARED = 2


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams. Words lie between ASCII blanks, A-Z lower-cased; a text with
    fewer than n words has its whole sequence as the one shingle, a text without words none."""
    h = grams(word_hashes(raw_of(text)), words)
    h.sort()
    return h[packs.firsts(h)]


def name_of(s: np.ndarray) -> int:
    """The name of the node of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n, percent: int = NUMERATOR):
    return n + (-percent * n) // 100 + 1


def sets_of_texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingles(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]


def sets_of_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The last column's lists, which are sorted sets already."""
    return [x.values.to_numpy().view(np.uint64) for x in batch.column(batch.num_columns - 1)]


def flushes(batches: Iterator[pa.RecordBatch], sets_of: Callable) -> Iterator[tuple[pa.RecordBatch | None, list, dict]]:
    """For each slice of a batch: the slice and its sets, and the sets by node name whenever FLUSH shingles have come
    together, or nothing but these at the end."""
    held, size = {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = sets_of(part)
            full = {}
            for s in sets:
                if len(s) and (name := name_of(s)) not in held:
                    held[name] = s
                    size += len(s)
            if size >= FLUSH:
                full, held, size = held, {}, 0
            yield part, sets, full
    if held:
        yield None, [], held


def scanned(docs: DataFrame, sets_of: Callable) -> DataFrame:
    """The members, a row for each document: _id, node, n. And rows with h and its nodes f, for shingles that two or more
    nodes of a flush share."""
    kind = docs.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "node", "n", "h", "f"]
        id_type = None
        for part, sets, full in flushes(batches, sets_of):
            if part is not None:
                id_type = part.column(0).type
                none = pa.nulls(len(sets), pa.int64())
                nodes = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), nodes, pa.array([len(s) for s in sets], pa.int64()), none, none], names=names)
            if full:
                h, f = np.unique(np.concatenate(list(full.values())), return_counts=True)
                h, f = h[f > 1].view(np.int64), f[f > 1]
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), id_type), none, none, pa.array(h), pa.array(f)], names=names)

    return docs.mapInArrow(run, f"_id {kind.simpleString()}, node long, n long, h long, f long")


def hot_shingles(scan: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles too frequent for a range, sorted, and their counts. A shingle that is alone in each flush isn't counted,
    but has no more entries in its range than there are flushes."""
    rows = scan.where("h is not null").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= max(HOT, total // packs.HOT_LISTED)).toPandas()
    h, f = rows["h"].to_numpy(np.int64).view(np.uint64), rows["f"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], f[order]


#: An entry: a shingle, the node that has it, and the node's number of shingles; once it is counted, the shingle's nodes.
ENTRY = {"h": np.uint64, "node": np.uint64, "n": np.uint32}
COUNTED = ENTRY | {"c": np.uint32}


def places(h: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash whether the sorted list has it, and where."""
    if not len(listed):
        return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    return listed[at] == h, at


def sent(docs: DataFrame, sets_of: Callable, hot: np.ndarray, ranges: int) -> DataFrame:
    """The packed shingles of all nodes, by range of hashes; hot ones by part of the nodes, in groups numbered from `ranges`
    on."""
    listed = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_LISTED at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, full in flushes(batches, sets_of):
            if full:
                sizes = np.fromiter(map(len, full.values()), np.int64, len(full))
                h, n = np.concatenate(list(full.values())), np.repeat(sizes.astype(np.uint32), sizes)
                node = np.repeat(np.fromiter(full, np.int64, len(full)).view(np.uint64), sizes)
                known, _ = places(h, listed.value)
                group = np.where(known, ranges + packs.share_of(node, ranges), packs.share_of(h, ranges))
                yield packs.packed(group, h=h, node=node, n=n)

    return docs.drop("_id").mapInArrow(run, packs.schema(ENTRY))


def returned(sent_: DataFrame, hot: tuple[np.ndarray, np.ndarray], ranges: int) -> DataFrame:
    """The shared shingles with their counts, packed by part of the nodes."""
    listed = sent_.sparkSession.sparkContext.broadcast(hot)  # HOT_LISTED at most

    def run(group: int, table: pa.Table) -> pa.Table:
        h, node, n = packs.unpacked(table, **ENTRY)
        if group < ranges:
            # Most shingles have one entry: these go first, which spares the full sort by node.
            order = np.argsort(h, kind="stable")
            first = packs.firsts(h[order])
            order = order[~(first & np.append(first[1:], True))]
            order = order[np.lexsort((node[order], h[order]))]
            order = order[packs.firsts(h[order], node[order])]
            h, node, n = h[order], node[order], n[order]
            place = np.cumsum(packs.firsts(h)) - 1
            c = np.bincount(place)[place]
            h, node, n, c = h[c > 1], node[c > 1], n[c > 1], c[c > 1]
        else:
            keys, counts = listed.value
            c = counts[places(h, keys)[1]]
        c = c.clip(max=(1 << 32) - 1).astype(np.uint32)
        return pa.Table.from_batches([packs.packed(packs.share_of(node, ranges), h=h, node=node, n=n, c=c)])

    return packs.by_group(sent_, 2 * ranges if len(hot[0]) else ranges, run, packs.schema(COUNTED))


def described(counted: DataFrame, ranges: int) -> DataFrame:
    """The nodes that can link: node, n, their shared shingles rare first, how many of these lie in the prefix, and
    the bits that they flip."""
    kind = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64())), ("prefix", pa.int64()), ("signs", pa.list_(pa.int64()))])

    def run(group: int, table: pa.Table) -> pa.Table:
        h, node, n, c = packs.unpacked(table, **COUNTED)
        order = np.lexsort((h, c, node))
        order = order[packs.firsts(h[order], node[order])]
        h, node, n = h[order], node[order], n[order].astype(np.int64)
        starts = np.nonzero(packs.firsts(node))[0]
        sizes, n = np.diff(starts, append=len(h)), n[starts]
        able = 100 * sizes >= NUMERATOR * n
        h, node, n, sizes = h[np.repeat(able, sizes)], node[starts][able], n[able], sizes[able]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        signs = np.zeros(len(sizes) * SIGNS, dtype=np.uint64)
        word = np.repeat(np.arange(len(sizes)), sizes) * SIGNS + (h >> np.uint64(58)).astype(np.int64) % SIGNS
        np.bitwise_xor.at(signs, word, np.uint64(1) << (h >> np.uint64(7) & np.uint64(63)))
        edges = np.arange(len(sizes) + 1, dtype=np.int32) * SIGNS
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(edges), pa.array(signs.view(np.int64)))
        return pa.Table.from_arrays([pa.array(node.view(np.int64)), pa.array(n), lists[0], pa.array(prefix_length(n) - n + sizes), lists[1]], schema=kind)

    return packs.by_group(counted, ranges, run, "node long, n long, shared array<long>, prefix long, signs array<long>")


def pivots(rows: DataFrame, round_: int) -> DataFrame:
    """h and its pivot nodes with their sizes. The first round takes the node in whose order the shingle comes earliest: it
    holds few rarer shingles, as the origin of a group of near copies does. Later rounds take PIVOTS nodes by hash."""
    early = (F.col("pos") * 1000 / F.col("n")).cast("int")
    keys = [early] if round_ == 0 else [F.xxhash64(F.lit(round_ * PIVOTS + k), "node") for k in range(PIVOTS)]
    picks = [F.min(F.struct(key.alias("key"), *[F.col(c).alias(c) for c in ("node", "n", "pos")])).alias(f"p{k}") for k, key in enumerate(keys)]
    found = rows.groupBy("h").agg(*picks)
    return found.select("h", F.explode(F.array_distinct(F.array(*[F.struct(f"p{k}.node", f"p{k}.n", f"p{k}.pos") for k in range(len(keys))]))).alias("p"))


def similar_sizes(a, b):
    return (100 * a >= NUMERATOR * b) & (100 * b >= NUMERATOR * a)


def enough_left(n, pos, m, at):
    """Whether two sets can link whose first common shingle lies at these places. Jaccard >= t is an intersection of t / (1 + t) of
    both sizes."""
    return (100 + NUMERATOR) * F.least(n - pos, m - at) >= NUMERATOR * (n + m)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link. `pairs` is a table; nodes in no pair aren't shuffled where its ends can be broadcast."""
    nodes = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_semi")
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= NUMERATOR * (F.col("na") + F.col("nb") - both)).select("a", "b")


def with_components(rows: DataFrame, labels: DataFrame | None, node: str, comp: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(comp, F.col(node))
    named = labels.select(F.col("id").alias(node), F.col("comp").alias("_comp"))
    return rows.join(named, node, "left").withColumn(comp, F.coalesce("_comp", node)).drop("_comp")


def apart(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The prefix shingles whose nodes lie in two or more components, with these."""
    rows = with_components(rows.select("h", "node", "n", "pos"), labels, "node", "comp")
    split = rows.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("h")
    return rows.join(split, "h", "left_semi")


def remaining_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pair of nodes in different components that passes the prefix, length, positional and suffix filters. A group's
    largest component meets the others only."""
    signs = [F.col("signs")[i].alias(f"s{i}") for i in range(SIGNS)]
    rows = rows.join(nodes.select("node", F.size("shared").cast("long").alias("size"), *signs), "node")
    sizes = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    columns = ["node", "n", "pos", "comp", "size", *[f"s{i}" for i in range(SIGNS)]]
    x, y = (r.select("h", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for r, side in ((rows.join(main, "h").where("comp <> main"), "x"), (rows, "y")))
    index = "{0} - ceil(%d * {0} / %d) + 1" % (2 * NUMERATOR, 100 + NUMERATOR)
    n, m = F.col("n_x"), F.col("n_y")
    first = F.expr(f"if(n_x < n_y or (n_x = n_y and node_x < node_y), pos_x < {index.format('n_x')}, pos_y < {index.format('n_y')})")
    enough = enough_left(n, F.col("pos_x"), m, F.col("pos_y"))
    differ = sum((F.bit_count(F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y"))) for i in range(SIGNS)), F.lit(0))
    near = (100 + NUMERATOR) * (F.col("size_x") + F.col("size_y") - differ) >= 2 * NUMERATOR * (n + m)
    met = x.join(y, (x["h"] == y["h"]) & (F.col("comp_x") != F.col("comp_y")) & similar_sizes(n, m) & enough & first & near)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def connected(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and comp: the components of the nodes that link. `rows` has the groups in which linked nodes meet: h, node, n and
    pos, the node's place for h in its order. `nodes` has node, n, `shared`, the set by which links are verified, and `signs`, by
    which pairs are filtered first."""
    tables = Tables(rows.sparkSession, "connected")
    labels, links = None, None
    open_ = tables.write(apart(rows, None), "apart")
    for round_ in range(ROUNDS):
        met = open_.join(pivots(open_, round_), "h").where(F.col("node") != F.col("p.node")).where(similar_sizes(F.col("n"), F.col("p.n")))
        # A pair that links passes at its first common shingle; what meets later only isn't formed.
        met = met.where(enough_left(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
        met = met.groupBy("node", "comp", F.col("p.node").alias("pivot")).agg(F.count(F.lit(1)).alias("met"))
        # Of the pivots that a node meets, the ones it shares most with are compared with it.
        met = with_components(met, labels, "pivot", "pcomp").where("comp <> pcomp")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("met"), "pivot"))
        pairs = met.withColumn("_r", rank).where(F.col("_r") <= COMPARED)
        pairs = tables.write(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
        found = tables.write(verified(pairs, nodes), "links")
        tables.drop(pairs)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links)
        # Components only grow: a shingle whose nodes lie in one is settled in all later rounds.
        before, open_ = open_, tables.write(apart(open_, labels), "apart")
        tables.drop(before)
    pairs = tables.write(remaining_pairs(open_, nodes), "pairs")
    found = tables.write(verified(pairs, nodes), "links")
    labels = components(found if links is None else links.union(found))
    tables.drop(*tables.held)
    return labels


def link_sets(docs: DataFrame, sets_of: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """As link(), for `docs` with _id and a column that `sets_of` makes sets from."""
    tables = Tables(docs.sparkSession, name)
    scan = tables.write(scanned(docs, sets_of), "members")
    members = scan.where("n is not null").select("_id", "node", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    ranges, hot = 1 + total // packs.RANGE, hot_shingles(scan, total)
    nodes = tables.write(described(returned(sent(docs, sets_of, hot[0], ranges), hot, ranges), ranges), "nodes")
    own = F.col("n") - F.size("shared")
    prefixes = nodes.select("node", "n", own.alias("_own"), F.posexplode(F.slice("shared", F.lit(1), F.col("prefix").cast("int"))).alias("_at", "h"))
    prefixes = tables.write(prefixes.select("h", "node", "n", (F.col("_own") + F.col("_at")).alias("pos")), "prefixes")
    labels = connected(prefixes, nodes)
    tables.drop(prefixes, nodes)
    return members, labels


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The members, a row for each document with `_id`, `n` and `node`, and the components of nodes: id, comp. Nodes
    without a link are in no row of the second table; documents without words have no node."""
    return link_sets(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), sets_of_texts, "jaccard")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: its id, `n_shingles`, and `component_id`, the smallest id in its component."""
    members, labels = link(docs, id_col, text_col)
    rows = with_components(members, labels, "node", "comp")
    # Documents without shingles have no node: each is a component of its own.
    smallest = rows.where("n > 0").groupBy("comp").agg(F.min("_id").alias("component_id"))
    rows = rows.join(smallest, "comp", "left")
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))

"""DAG analysis over all runs at once: nodes (run_id, node) and an edge table (run_id, src, dst), or nodes with a column
`next`, the list of the nodes behind them; a name in `next` that isn't a node of the run is no edge.

Runs of up to LARGE nodes and edges are brought to a task each by one shuffle, many runs to a task, and worked on there
together in arrays. A larger run goes by joins that stop when nothing is new: frontiers are rewritten in each round and cut
from their lineage by tables in the shared folder, so a plan doesn't grow with the depth, and there are as many rounds as the run is deep."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.exprs import round2, rounded
from opsloom.sources.shared import cut, dealt

#: Nodes and edges of a run up to which a task works on it by itself, and rows that a task takes together.
LARGE, TOGETHER = 1_000_000, 200_000
#: Pairs of an origin and a node that are marked at once.
MARKS = 50_000_000
# Kinds of the rows that come together.
NODE, EDGE, MORE = 0, 1, 2


class Runs:
    """Whole runs as arrays. `table` has run_id, kind, a, to and further columns: a node, with `to` as its next nodes; an
    edge, from a to each of `to`; or a row more about the node a. With `named`, every name is a node.

    Nodes are numbered in order of run and name as they come; `row` is a node's row in the table, -1 without one, and `src`
    and `dst` the edges between numbers. An edge from what isn't a node has src -1."""

    def __init__(self, table: pa.Table, named: bool = False):
        self.table = table = table.combine_chunks()
        ids, a, to = (whole(table, c) for c in ("run_id", "a", "to"))
        self.kind = whole(table, "kind").to_numpy()
        self.run = codes(ids)[0]
        sizes = pc.fill_null(pc.list_value_length(to), 0).to_numpy().astype(np.int64)
        name, self.names = codes(pa.concat_arrays([a, to.flatten().cast(a.type)]))
        width = int(name.max(initial=0)) + 1
        self.key = self.run * width + name[: len(a)]
        from_, at = np.repeat(self.key, sizes), np.repeat(self.run, sizes) * width + name[len(a) :]
        own = np.nonzero(self.kind == NODE)[0]
        if named:
            self.node = np.unique(np.concatenate([self.key, at]))
            self.row = np.full(len(self.node), -1)
        else:
            self.node, place = np.unique(self.key[own], return_index=True)
            self.row = own[place]
        self.run_of, self.name = self.node // width, self.node % width
        src, dst = self.number(from_), self.number(at)
        listed = np.repeat(self.kind == EDGE, sizes)
        self.n_edges = lambda: np.unique(np.stack([from_, at])[:, (dst >= 0) | listed], axis=1)[0] // width  # their runs, each edge once
        order = np.argsort(src[dst >= 0], kind="stable")
        self.src, self.dst = src[dst >= 0][order], dst[dst >= 0][order]
        self.ids = ids.take(pa.array(np.unique(self.run, return_index=True)[1]))  # the id of each run's number
        self.run_at = np.unique(self.run)

    def number(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.node, key), max(0, len(self.node) - 1))
        return np.where(self.node[at] == key, at, -1) if len(self.node) else np.full(len(key), -1)

    def ids_of(self, runs: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(np.searchsorted(self.run_at, runs)))

    def names_of(self, nodes: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.name[nodes]))

    def column(self, name: str, missing=None) -> np.ndarray:
        """A column of the nodes' rows."""
        values = whole(self.table, name).take(pa.array(self.row))
        return (values if missing is None else pc.fill_null(values, missing)).to_numpy(zero_copy_only=False)

    def ahead(self, up: bool = False) -> Callable:
        """A function that gives the edges out of nodes: for each edge the place of its node among these, and its end."""
        a, b = (self.dst, self.src) if up else (self.src, self.dst)
        order = np.argsort(a, kind="stable")
        order = order[(a[order] >= 0) & (b[order] >= 0)]
        a, b = a[order], b[order]
        starts, ends = (np.searchsorted(a, np.arange(len(self.node)), side) for side in ("left", "right"))

        def step(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = ends[at] - starts[at]
            return np.repeat(np.arange(len(at)), sizes), b[np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

        return step

    def levels(self) -> np.ndarray:
        """Kahn's order over all runs at once: in each step the nodes that wait for nothing get their level; -1 without one."""
        waits, step = np.bincount(self.dst, minlength=len(self.node)), self.ahead()
        level, ready, k = np.full(len(self.node), -1, dtype=np.int32), np.nonzero(waits == 0)[0], 0
        while len(ready):
            level[ready] = k
            gone = step(ready)[1]
            np.subtract.at(waits, gone, 1)
            ready, k = np.unique(gone[waits[gone] == 0]), k + 1
        return level

    def behind(self, first: np.ndarray) -> np.ndarray:
        """Which nodes an edge reaches from the first ones or from nodes so reached."""
        step, hit = self.ahead(), np.zeros(len(self.node), dtype=bool)
        new = np.nonzero(first)[0]
        while len(new):
            new = np.unique(step(new)[1])
            new = new[~hit[new]]
            hit[new] = True
        return hit

    def reached(self, origins: np.ndarray, up: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an origin and a node behind it. Origins are taken by slices whose marks fit."""
        step = self.ahead(up)
        first, sizes = (np.unique(self.run_of, return_index=True)[1], np.unique(self.run_of, return_counts=True)[1])
        run = np.searchsorted(self.run_of[first], self.run_of[origins])
        ends = np.cumsum(sizes[run])
        while len(origins):
            n = max(1, int(np.searchsorted(ends, MARKS, "right")))
            base = ends[:n] - sizes[run[:n]] - first[run[:n]]
            marks = np.zeros(int(ends[n - 1]), dtype=bool)
            o, v = np.arange(n), origins[:n]
            while len(o):
                at, v = step(v)
                o = o[at]
                pair, place = np.unique(base[o] + v, return_index=True)
                place = place[~marks[pair]]
                o, v = o[place], v[place]
                marks[base[o] + v] = True
                if len(o):
                    yield origins[:n][o], v
            origins, run, ends = origins[n:], run[n:], ends[n:] - ends[n - 1]


def whole(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers for equal values, and the value of each number."""
    found = values.dictionary_encode("encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def rows_of(nodes: DataFrame | None = None, edges: DataFrame | None = None, more: DataFrame | None = None, keep: dict[str, Column] | None = None, more_of: dict[str, Column] | None = None) -> DataFrame:
    """Nodes, edges and further rows about nodes as rows of one table; `keep` and `more_of` are columns of the nodes and of
    the further rows."""
    parts, keep, more_of = [], keep or {}, more_of or {}
    if nodes is not None:
        kind = nodes.schema["node"].dataType
        to = F.col("next") if "next" in nodes.columns else F.lit(None)
        parts.append(nodes.select("run_id", F.lit(NODE).alias("kind"), F.col("node").alias("a"), to.cast(f"array<{kind.simpleString()}>").alias("to"), *[c.alias(n) for n, c in keep.items()]))
    if edges is not None:
        parts.append(edges.select("run_id", F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.array("dst").alias("to")))
    if more is not None:
        parts.append(more.select("run_id", F.lit(MORE).alias("kind"), F.col("node").alias("a"), *[c.alias(n) for n, c in more_of.items()]))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def in_runs(rows: DataFrame, work: Callable[[Runs], Iterator[pa.RecordBatch]], result: list[str], counted: DataFrame, large: int = LARGE, named: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """What `work` makes of whole runs, and the ids of runs that are larger than `large`, or nothing without such runs.
    `result` has the columns behind run_id; the first of them is never null. Partitions are made by the rows of `counted`."""

    def split(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        """The complete runs of the table, and the run that may go on in the next batch."""
        run = codes(whole(table, "run_id"))[0]
        at = len(run) if last else int(np.nonzero(run != run[-1])[0].max(initial=-1)) + 1
        return table.slice(0, at), table.slice(at)

    def weights(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        run, ids = codes(whole(table, "run_id"))
        own = (whole(table, "kind").to_numpy() != EDGE) + pc.fill_null(pc.list_value_length(whole(table, "to")), 0).to_numpy()
        return run, np.bincount(run, weights=own, minlength=len(ids)), ids

    def marked(ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[pa.nulls(len(ids), t) for t in types]], names=["run_id", *names])

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        run, weight, ids = weights(table)
        if (weight > large).any():
            yield marked(ids.filter(pa.array(weight > large)))
            table = table.filter(pa.array(weight[run] <= large))
        if table.num_rows:
            yield from work(Runs(table, named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, over = [], 0, None
        for batch in batches:
            if over is not None:  # the rest of a run that is too large
                batch = batch.filter(pc.not_equal(batch.column(0), over))
                if not batch.num_rows:
                    continue
                over = None
            held.append(batch)
            size += batch.num_rows
            if size >= TOGETHER:
                complete, rest = split(pa.Table.from_batches(held), False)
                if complete.num_rows:
                    yield from done(complete)
                if weights(rest)[1][0] > large:
                    over = rest.column("run_id")[0]
                    yield marked(whole(rest.slice(0, 1), "run_id"))
                    rest = rest.slice(0, 0)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from done(pa.Table.from_batches(held))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["run_id"].dataType.simpleString()
    kind = ", ".join([f"run_id {id_type}", *result])
    names = [c.split(" ")[0] for c in result]
    types = [to_arrow_type(f.dataType) for f in rows.sparkSession.createDataFrame([], kind).schema[1:]]
    rows = rows.where("run_id is not null")
    found = cut(dealt(rows, counted.count(), "run_id").sortWithinPartitions("run_id").mapInArrow(run, kind))
    huge = found.where(F.col(names[0]).isNull()).select("run_id").distinct()
    return (found, None) if huge.isEmpty() else (found.where(F.col(names[0]).isNotNull()), huge)


def by_runs(df: DataFrame) -> DataFrame:
    """`df` by its runs, for windows and groups whose tasks don't grow with the table."""
    return dealt(df, df.count(), "run_id")


def of_runs(df: DataFrame | None, runs: DataFrame) -> DataFrame | None:
    return None if df is None else df.join(runs, "run_id", "left_semi")


def edges_of(nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The edges as a table, of nodes with `next` as well."""
    if edges is not None:
        return edges
    pairs = nodes.select("run_id", F.col("node").alias("src"), F.explode("next").alias("dst"))
    return pairs.join(nodes.select("run_id", F.col("node").alias("dst")), ["run_id", "dst"], "left_semi").select("run_id", "src", "dst")


def closure(edges: DataFrame | None, start: DataFrame, up: bool = False, nodes: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(run_id, origin, node): everything reachable from the start nodes (run_id, node), without the start itself unless a
    cycle leads back. With `up`, against the edges. Instead of edges, nodes with `next` can be given."""
    kind = start.schema["node"].dataType.simpleString()

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        origins = np.unique(g.number(g.key[g.kind == MORE]))
        for o, v in g.reached(origins[origins >= 0], up):
            yield pa.RecordBatch.from_arrays([g.ids_of(g.run_of[o]), g.names_of(o), g.names_of(v)], names=["run_id", "origin", "node"])

    found, huge = in_runs(rows_of(nodes, edges, start), work, [f"origin {kind}", f"node {kind}"], edges if nodes is None else nodes, large, named=nodes is None)
    if huge is None:
        return found
    links = edges_of(of_runs(nodes, huge), None) if edges is None else of_runs(edges, huge)
    return found.union(closure_by_rounds(links, of_runs(start, huge), up))


def closure_by_rounds(edges: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = cut(edges.select("run_id", F.col(a).alias("_at"), F.col(b).alias("_to")).distinct())  # read in each round
    frontier = start.select("run_id", F.col("node").alias("origin"), "node").distinct()
    found = None
    while True:
        near = frontier.withColumnRenamed("node", "_at").join(steps, ["run_id", "_at"]).select("run_id", "origin", F.col("_to").alias("node")).distinct()
        frontier = cut(near if found is None else near.join(found, ["run_id", "origin", "node"], "left_anti"))
        if frontier.isEmpty():
            return frontier if found is None else found
        found = frontier if found is None else found.union(frontier)


def levels(nodes: DataFrame, edges: DataFrame | None = None, large: int = LARGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, node, level): the longest path from a root; nodes on or behind a cycle are dropped, as by Kahn's order, and so
    are nodes behind one that isn't there. Each node once; with `keep`, each row of `nodes` with these columns of it."""

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        level = g.levels()
        if keep:
            own = np.nonzero(g.kind == NODE)[0]
            level = level[g.number(g.key[own])]
            rows = pa.array(own[level >= 0])
        else:
            rows = pa.array(g.row[level >= 0])
        columns = [whole(g.table, c).take(rows) for c in ("run_id", "a", *keep)]
        yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(level[level >= 0]), *columns[2:]], names=["run_id", "node", "level", *keep])

    own = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.select("node", *keep).schema]
    found, huge = in_runs(rows_of(nodes, edges, keep={c: F.col(c) for c in keep}), work, [own[0], "level int", *own[1:]], nodes, large)
    if huge is None:
        return found
    nodes, edges = of_runs(nodes, huge), of_runs(edges, huge)
    more = levels_by_rounds(nodes.select("run_id", "node").distinct(), edges_of(nodes, edges).distinct())
    return found.union(nodes.join(more, ["run_id", "node"]).select("run_id", "node", "level", *keep) if keep else more.select("run_id", "node", "level"))


def levels_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In each round the nodes whose predecessors all have a level get theirs."""
    left, open_ = cut(nodes), cut(edges)
    done, level = None, 0
    while True:
        waiting = open_.select("run_id", F.col("dst").alias("node")).distinct()
        ready = cut(left.join(waiting, ["run_id", "node"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return ready if done is None else done
        done = ready if done is None else done.union(ready)
        gone = ready.select("run_id", "node")
        left = cut(left.join(gone, ["run_id", "node"], "left_anti"))
        open_ = cut(open_.join(gone.withColumnRenamed("node", "src"), ["run_id", "src"], "left_anti"))
        level += 1


def dag_stats(nodes: DataFrame, edges: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """For each run its nodes, its edges, depth, width and density; depth and width are null where no node has a level."""

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        level = g.levels().astype(np.int64)
        runs, first, n = np.unique(g.run_of, return_index=True, return_counts=True)
        if not len(runs):
            return
        depth = np.maximum.reduceat(level, first) + 1
        at = np.searchsorted(runs, g.run_of)
        (key, w), width = np.unique((at * (int(level.max()) + 1) + level)[level >= 0], return_counts=True), np.zeros(len(runs), dtype=np.int64)
        np.maximum.at(width, key // (int(level.max()) + 1), w)
        linked, e = np.unique(g.n_edges(), return_counts=True)
        edges_, known = np.zeros(len(runs), dtype=np.int64), np.isin(linked, runs)
        edges_[np.searchsorted(runs, linked[known])] = e[known]
        none = depth == 0
        columns = [g.ids_of(runs), pa.array(n), pa.array(edges_), pa.array(depth, mask=none), pa.array(width, mask=none)]
        yield pa.RecordBatch.from_arrays(columns, names=["run_id", "nodes", "edges", "depth", "width"])

    found, huge = in_runs(rows_of(nodes, edges), work, ["nodes long", "edges long", "depth long", "width long"], nodes, large)
    if huge is not None:
        nodes, edges = of_runs(nodes, huge), edges_of(of_runs(nodes, huge), of_runs(edges, huge)).select("run_id", "src", "dst").distinct()
        leveled = levels_by_rounds(nodes.select("run_id", "node").distinct(), edges)
        width = leveled.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("_w")).groupBy("run_id").agg(F.max("_w").alias("width"), (F.max("level") + 1).cast("long").alias("depth"))
        n = nodes.groupBy("run_id").agg(F.count_distinct("node").alias("nodes"))
        rows = n.join(edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges")), "run_id", "left").join(width, "run_id", "left")
        found = found.union(rows.select("run_id", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "depth", "width"))
    most = F.col("nodes") * (F.col("nodes") - 1) / 2
    return found.withColumn("density", F.when(most > 0, F.floor(F.col("edges") / most * 10000 + 0.5) / 10000).otherwise(0.0))


def dearest(g: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its level, the cost of the dearest path to it, and the node before it on that path, -1 at a root. Of equal
    ones the smallest name is before it. A cost that is null counts as the dearest, one that isn't a number as the cheapest."""
    level, total, before = g.levels(), g.column("cost", float("inf") if pa.types.is_floating(whole(g.table, "cost").type) else None), np.full(len(g.node), -1)
    names = np.empty(len(g.names), dtype=np.int64)
    names[pc.sort_indices(g.names).to_numpy()] = np.arange(len(g.names))
    total, rank = total.copy(), names[g.name]
    on = level[g.dst] > 0
    src, dst = g.src[on], g.dst[on]
    order = np.argsort(level[dst], kind="stable")
    src, dst = src[order], dst[order]
    cuts = np.searchsorted(level[dst], np.arange(1, int(level.max(initial=0)) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        s, d = src[lo:hi], dst[lo:hi]
        t = np.where(np.isnan(total[s]), -np.inf, total[s]) if total.dtype.kind == "f" else total[s]
        best = np.lexsort((-rank[s], t, d))  # the last of each end is the one that counts
        last = best[np.append(d[best][1:] != d[best][:-1], True)]
        before[d[last]] = s[last]
        total[d[last]] = total[d[last]] + total[s[last]]
    return level, total, before


def critical_path(nodes: DataFrame, edges: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(run_id, path, cost, costs): the longest path by node cost, and the cost of each of its nodes; of equal predecessors and
    ends the smallest name counts. `nodes` has run_id, node, cost, each node once."""
    kind = nodes.schema["cost"].dataType.simpleString()
    kind = kind if kind in ("tinyint", "smallint", "int", "bigint") else "double"
    as_ = "bigint" if kind != "double" else kind

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        level, total, before = dearest(g)
        own = np.nonzero(level >= 0)[0]
        names = np.empty(len(g.names), dtype=np.int64)
        names[pc.sort_indices(g.names).to_numpy()] = np.arange(len(g.names))
        t = np.where(np.isnan(total), -np.inf, total) if total.dtype.kind == "f" else total
        own = own[np.lexsort((-names[g.name[own]], t[own], g.run_of[own]))]
        ends = own[np.append(g.run_of[own][1:] != g.run_of[own][:-1], True)] if len(own) else own
        # The paths from their ends back, all runs a step at a time.
        owner, at, steps = np.arange(len(ends)), ends, []
        while len(at):
            steps.append((owner, at))
            more = before[at] >= 0
            owner, at = owner[more], before[at][more]
        owner, at = (np.concatenate([x[i] for x in reversed(steps)]) if steps else np.zeros(0, dtype=np.int64) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        at, offsets = at[order], pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ends)))]).astype(np.int32))
        costs = whole(g.table, "cost").take(pa.array(g.row[at]))
        unknown = np.isinf(total[ends]) if total.dtype.kind == "f" else None
        columns = [pa.ListArray.from_arrays(offsets, g.names_of(at)), pa.array(total[ends], mask=unknown), pa.ListArray.from_arrays(offsets, costs)]
        yield pa.RecordBatch.from_arrays([g.ids_of(g.run_of[ends]), *columns], names=["run_id", "path", "cost", "costs"])

    cost = F.col("cost").cast(as_)
    name = nodes.schema["node"].dataType.simpleString()
    found, huge = in_runs(rows_of(nodes, edges, keep={"cost": cost}), work, [f"path array<{name}>", f"cost {as_}", f"costs array<{as_}>"], nodes, large)
    if huge is None:
        return found
    nodes, edges = of_runs(nodes, huge).withColumn("cost", cost), of_runs(edges, huge)
    return found.union(critical_path_by_rounds(nodes, edges_of(nodes, edges)))


def critical_path_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    leveled = levels_by_rounds(nodes.select("run_id", "node").distinct(), edges.distinct())
    ranked = cut(nodes.select("run_id", "node", "cost").join(leveled, ["run_id", "node"]))
    into = edges.select("run_id", F.col("src").alias("_p"), F.col("dst").alias("node")).distinct()
    best = cut(ranked.where("level = 0").select("run_id", "node", F.col("cost").alias("total"), F.array("node").alias("path"), F.array("cost").alias("costs")))
    last = ranked.agg(F.max("level")).first()[0] or 0
    for level in range(1, last + 1):
        own = ranked.where(F.col("level") == level)
        prior = best.select("run_id", F.col("node").alias("_p"), F.col("total").alias("_t"), F.col("path").alias("_path"), F.col("costs").alias("_costs"))
        rows = own.join(into, ["run_id", "node"]).join(prior, ["run_id", "_p"])
        top = rows.groupBy("run_id", "node", "cost").agg(F.min(F.struct((-F.col("_t")).alias("t"), "_p", "_path", "_costs")).alias("_m"))
        reached = top.select("run_id", "node", (F.col("cost") - F.col("_m.t")).alias("total"), F.concat("_m._path", F.array("node")).alias("path"), F.concat("_m._costs", F.array("cost")).alias("costs"))
        best = cut(best.union(reached))
    pick = F.min(F.struct((-F.col("total")).alias("t"), "node", "path", "costs")).alias("_m")
    return best.groupBy("run_id").agg(pick).select("run_id", F.col("_m.path").alias("path"), (-F.col("_m.t")).alias("cost"), F.col("_m.costs").alias("costs"))


def bottleneck(paths: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The most expensive node of each critical path, the first of equals, and its share of the path in percent. `paths` has the
    costs of its nodes, as critical_path() gives them."""
    top = paths.withColumn("_c", F.array_max("costs")).withColumn("node", F.try_element_at("path", F.array_position("costs", F.col("_c")).cast("int")))
    share = F.when(F.col("cost") > 0, rounded(F.col("_c") / F.col("cost") * 100, 1)).otherwise(0.0)
    return top.select("run_id", "node", F.col("_c").alias("cost"), share.alias("pct"))


def dirty_nodes(nodes: DataFrame, edges: DataFrame | None, base: DataFrame, now: int | None = None, ttl_ms: int | None = None, large: int = LARGE) -> DataFrame:
    """(run_id, node, dirty, result_hash): a node of the new run is cached, with the hash of the run before, if it completed
    there with a hash, nothing upstream is dirty, and that run (base.completed_at) isn't older than the lifetime. Nodes that
    are new in the run are dirty. `base` has each node once."""
    was = F.when(F.col("status") == "completed", F.col("result_hash")).cast("string")
    old = F.lit(False) if ttl_ms is None else F.coalesce(F.lit(now) - F.col("completed_at") > ttl_ms, F.lit(False))

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        told = np.nonzero(g.kind == MORE)[0]
        about = g.number(g.key[told])
        expired = np.unique(g.run[told[whole(g.table, "_old").take(pa.array(told)).to_numpy(zero_copy_only=False).astype(bool)]])
        place = np.full(len(g.node), -1)
        place[about[about >= 0]] = told[about >= 0]
        hashes = whole(g.table, "_hash").take(pa.array(place, mask=place < 0))
        first = hashes.is_null().to_numpy(zero_copy_only=False) | np.isin(g.run_of, expired)
        dirty = pa.array(first | g.behind(first))
        yield pa.RecordBatch.from_arrays([g.ids_of(g.run_of), g.names_of(np.arange(len(g.node))), dirty, pc.if_else(dirty, pa.scalar(None, pa.string()), hashes)], names=["run_id", "node", "dirty", "result_hash"])

    kind = nodes.schema["node"].dataType.simpleString()
    found, huge = in_runs(rows_of(nodes, edges, base, more_of={"_hash": was, "_old": old}), work, [f"node {kind}", "dirty boolean", "result_hash string"], base, large)
    if huge is None:
        return found
    nodes, base = of_runs(nodes, huge), of_runs(base, huge)
    rows = nodes.select("run_id", "node").distinct().join(base.select("run_id", "node", was.alias("_hash")), ["run_id", "node"], "left")
    first = rows.where(F.col("_hash").isNull()).select("run_id", "node")
    first = first.union(nodes.select("run_id", "node").join(base.where(old).select("run_id").distinct(), "run_id", "left_semi"))
    spread = behind_by_rounds(edges_of(nodes, of_runs(edges, huge)), first).union(first).distinct().withColumn("_d", F.lit(True))
    dirty = F.coalesce("_d", F.lit(False))
    return found.union(rows.join(spread, ["run_id", "node"], "left").select("run_id", "node", dirty.alias("dirty"), F.when(~dirty, F.col("_hash")).alias("result_hash")))


def behind_by_rounds(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(run_id, node): what lies behind any of the first nodes; origins aren't told apart."""
    steps = cut(edges.select("run_id", F.col("src").alias("node"), "dst").distinct())  # read in each round
    frontier, found = first.select("run_id", "node").distinct(), None
    while True:
        near = frontier.join(steps, ["run_id", "node"]).select("run_id", F.col("dst").alias("node")).distinct()
        frontier = cut(near if found is None else near.join(found, ["run_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return frontier if found is None else found
        found = frontier if found is None else found.union(frontier)


def component(edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The nodes reachable from `root` along or against the edges (job_id, depends_on_job_id), and the edges among them."""
    both = edges.select(F.lit(0).alias("run_id"), F.col("job_id").alias("src"), F.col("depends_on_job_id").alias("dst"))
    both = both.union(both.select("run_id", "dst", "src"))
    start = edges.sparkSession.range(1).select(F.lit(0).alias("run_id"), F.lit(root).alias("node"))
    nodes = closure(both, start).select("node").union(start.select("node")).distinct()
    kept = edges.join(nodes.withColumnRenamed("node", "job_id"), "job_id", "left_semi").join(nodes.withColumnRenamed("node", "depends_on_job_id"), "depends_on_job_id", "left_semi")
    return nodes, kept.select("job_id", "depends_on_job_id").distinct()


def cascade_cancel(jobs: DataFrame, edges: DataFrame, failed: DataFrame, reason: str) -> DataFrame:
    """Pending jobs that depend on a failed one, however far, as cancelled rows."""
    links = edges.select(F.lit(0).alias("run_id"), F.col("depends_on_job_id").alias("src"), F.col("job_id").alias("dst"))
    hit = closure(links, failed.select(F.lit(0).alias("run_id"), F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct()
    return jobs.where("status = 0").join(hit, "id", "left_semi").withColumn("status", F.lit(5)).withColumn("error", F.lit(reason))


def stages(leveled: DataFrame, workers: int, order: str = "node") -> DataFrame:
    """Within a level, groups of at most `workers` nodes in order."""
    place = F.row_number().over(Window.partitionBy("run_id", "level").orderBy(order)) - 1
    return leveled.withColumn("stage", F.floor(place / workers).cast("long"))


def conditions(nodes: DataFrame, edges: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """For each node with predecessors: whether on_success (all), on_failure (any) and always hold. A status that is null counts
    for neither."""
    if edges is not None:
        return conditions_by_joins(nodes, edges)

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        own = np.nonzero(g.kind == NODE)[0]
        at, status = g.number(g.key[own]), whole(g.table, "status").take(pa.array(own))
        n = {}
        for what, hit in (("known", status.is_valid()), ("done", pc.equal(status, "completed")), ("failed", pc.equal(status, "failed"))):
            one = np.bincount(at, weights=pc.fill_null(hit, False).to_numpy(zero_copy_only=False), minlength=len(g.node))
            n[what] = np.bincount(g.dst[g.src >= 0], weights=one[g.src[g.src >= 0]], minlength=len(g.node))
        to = np.nonzero(np.bincount(g.dst[g.src >= 0], minlength=len(g.node)))[0]
        known, done, failed = (n[w][to] for w in ("known", "done", "failed"))
        columns = [pa.array(done == known, mask=known == 0), pa.array(failed > 0, mask=known == 0), pa.array(np.ones(len(to), dtype=bool))]
        yield pa.RecordBatch.from_arrays([g.ids_of(g.run_of[to]), g.names_of(to), *columns], names=["run_id", "node", "on_success", "on_failure", "always"])

    kind = nodes.schema["node"].dataType.simpleString()
    found, huge = in_runs(rows_of(nodes, keep={"status": F.col("status")}), work, [f"node {kind}", "on_success boolean", "on_failure boolean", "always boolean"], nodes, large)
    if huge is None:
        return found
    nodes = of_runs(nodes, huge)
    return found.union(conditions_by_joins(nodes, edges_of(nodes, None)))


def conditions_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    before = edges.join(nodes.select("run_id", F.col("node").alias("src"), "status"), ["run_id", "src"])
    grouped = before.groupBy("run_id", F.col("dst").alias("node"))
    return grouped.agg(F.bool_and(F.col("status") == "completed").alias("on_success"), F.bool_or(F.col("status") == "failed").alias("on_failure"), F.lit(True).alias("always"))


def skipped(nodes: DataFrame, edges: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """Pending nodes behind a failed or skipped one, however far."""

    def work(g: Runs) -> Iterator[pa.RecordBatch]:
        own = np.nonzero(g.kind == NODE)[0]  # a node may have several rows
        at, status = g.number(g.key[own]), whole(g.table, "status").take(pa.array(own))
        first = np.zeros(len(g.node), dtype=bool)
        first[at[pc.is_in(status, pa.array(["failed", "skipped"])).to_numpy(zero_copy_only=False)]] = True
        hit = g.behind(first)[at] & pc.fill_null(pc.equal(status, "pending"), False).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([whole(g.table, c).take(pa.array(own[hit])) for c in ("run_id", "a")], names=["run_id", "node"])

    kind = nodes.schema["node"].dataType.simpleString()
    found, huge = in_runs(rows_of(nodes, edges, keep={"status": F.col("status")}), work, [f"node {kind}"], nodes, large)
    if huge is None:
        return found
    nodes = of_runs(nodes, huge)
    hit = behind_by_rounds(edges_of(nodes, of_runs(edges, huge)), nodes.where("status in ('failed', 'skipped')"))
    return found.union(nodes.where("status = 'pending'").join(hit, ["run_id", "node"], "left_semi").select("run_id", "node"))


def saga_waves(leveled: DataFrame) -> DataFrame:
    """Compensable nodes in waves, the deepest level first; levels without any are left out. `leveled` has run_id, node, level
    and status."""
    wave = F.dense_rank().over(Window.partitionBy("run_id").orderBy(F.desc("level"))).cast("long")
    return by_runs(leveled).where("status in ('completed', 'cache_hit')").select("run_id", "node", wave.alias("wave"))


def contexts(nodes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """For each run the context of callable conditions: counts of its completed and failed nodes and how many there are."""
    counts = nodes.groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failure_count"), F.count(F.lit(1)).alias("nodes")
    )
    return counts.select("run_id", F.struct("run_id", "success_count", "failure_count", "nodes").alias("context"))


def compensations(leveled: DataFrame, compensators: dict[str, str]) -> DataFrame:
    """The compensation jobs of each run, a row a node that completed and has a compensator: its wave, the task, the key
    that makes it run once, and what it is told of the forward execution. `leveled` has run_id, node, level, status, task and
    result."""
    task = F.try_element_at(F.create_map(*[F.lit(v) for kv in compensators.items() for v in kv]), F.col("task"))
    rows = by_runs(leveled).where("status in ('completed', 'cache_hit')").withColumn("compensator", task).where("compensator is not null")
    wave = F.dense_rank().over(Window.partitionBy("run_id").orderBy(F.desc("level"))).cast("long")
    key = F.concat_ws(":", F.lit("compensation"), "run_id", "node")
    return rows.select("run_id", "node", wave.alias("wave"), "compensator", key.alias("idempotency_key"), F.col("result").alias("forward_result"))


# The states of a workflow, and the legal transitions between them.
STATES = ["pending", "running", "completed", "completed_with_failures", "failed", "cancelled", "paused", "compensating", "compensated", "compensation_failed"]
TRANSITIONS = [
    ("pending", "running"),
    ("running", "completed"),
    ("running", "completed_with_failures"),
    ("running", "failed"),
    ("running", "cancelled"),
    ("running", "paused"),
    ("running", "compensating"),
    ("paused", "running"),
    ("paused", "cancelled"),
    ("completed_with_failures", "compensating"),
    ("completed", "compensating"),
    ("failed", "compensating"),
    ("compensating", "compensated"),
    ("compensating", "compensation_failed"),
]


def legal(df: DataFrame, before: str = "state", after: str = "target") -> DataFrame:
    pairs = [f"{a}>{b}" for a, b in TRANSITIONS]
    return df.withColumn("legal", F.concat_ws(">", before, after).isin(pairs))


def chunks(df: DataFrame, key: str, position: str, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1) / size).cast("long"))


def fan_out_items(df: DataFrame, node: str, items: str) -> DataFrame:
    """One child for each item of a list result, named node[i]."""
    rows = df.select("*", F.posexplode(items).alias("pos", "item"))
    return rows.withColumn("child", F.concat(F.col(node), F.lit("["), F.col("pos").cast("string"), F.lit("]")))


def fan_in(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The children's results in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("results"))


def mermaid(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The text of each run's graph. Lines of nodes, with their edges in `next` or of an edge table, come together by one shuffle."""
    kind = nodes.schema["node"].dataType.simpleString()
    named = F.concat(F.lit("    "), F.col("node"), F.lit("["), F.col("node"), F.lit(": "), F.col("status"), F.lit("]"))
    rows = nodes.select("run_id", "node", named.alias("_n"), (F.col("next") if edges is None else F.lit(None)).cast(f"array<{kind}>").alias("_to"))
    if edges is not None:
        rows = rows.union(edges.select("run_id", F.col("src").alias("node"), F.lit(None).cast("string").alias("_n"), F.array("dst").alias("_to")))
    lines = F.transform("_to", lambda n: F.concat(F.lit("    "), F.col("node"), F.lit(" --> "), n))
    found = rows.groupBy("run_id").agg(F.array_sort(F.collect_list("_n")).alias("_n"), F.count("_n").alias("_own"), F.array_sort(F.flatten(F.collect_list(lines))).alias("_e"))
    return found.where("_own > 0").select("run_id", F.array_join(F.concat(F.array(F.lit("graph LR")), "_n", "_e"), "\n").alias("mermaid"))


def success_rate(df: DataFrame) -> DataFrame:
    return df.agg(round2(F.avg(F.col("succeeded").cast("double")) * 100).alias("pct"))

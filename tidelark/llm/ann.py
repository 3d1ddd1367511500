"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Building: a forest of pivot cells, split into blocks of bounded size, gives
every vector a first list of ``neighbours`` others.  Then NN-descent, in rounds:
every node goes to the nodes that it lists and meets there all that list the
same one, its neighbours of neighbours (an exchange of vectors by meeting
place).  Pairs of which one has come since the last round are compared, and
what is nearer than the farthest in a list is told to its owner (an exchange by
owner).  Rounds go on until no more than ``settled`` of the entries are new, so
the data says how many there are.

Searching: each query starts from its own list and keeps the ``beam`` nearest
nodes seen; in each hop a join expands all those that are not yet expanded with
the ids and vectors of the nodes that list them, which stand in a table bucketed
by node, so that only the queries move.  Hops go on until no query has a node
left to expand.  The candidates found are ranked by their exact cosines.

Defined results: equal vectors are one node; a result lists its members by id.
Vectors that are null, zero, or hold null or non-finite components take no
part, nor does a null id.  Vectors of unequal length have no cosine: each
length is searched by itself.  Rows with an equal id and equal vector count
once.  Tables of up to ``block`` distinct vectors are compared pair by pair, so
small tables give exact results; a query gets all candidates if they are fewer
than ``k``.  An empty table gives no rows.  Long vectors are only more bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_scratch, partitions, quoted, small_batches, written, written_at

LISTS = "u long, unit binary, vs array<long>, ss array<float>, fresh array<boolean>"
STATE = "q long, v long, s float, done int, least float"
#: Units are kept as 16-bit integers, this many to one.
SCALE = 32767.0


def usable(vec: Column) -> Column:
    """Whether a vector of doubles has a direction."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, summed in order of components."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _whole_groups(batches, key: str):
    """Tables of rows sorted by ``key`` with all rows of each key they hold."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        k = t.column(key).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _top(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, first: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k largest s of each u, each v once; u ascending.  Of equal (u, v) the one with the largest ``first`` (by default s) counts."""
    o = np.lexsort((-(s if first is None else first), v, u))
    one = np.concatenate(([True], (u[o][1:] != u[o][:-1]) | (v[o][1:] != v[o][:-1]))) if len(o) else np.zeros(0, bool)
    o = o[one]
    o = o[np.lexsort((v[o], -s[o], u[o]))]
    a = u[o]
    return o[np.arange(len(a)) - np.searchsorted(a, a, "left") < k]


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists; a null is an empty list."""
    b = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(b.offsets.to_numpy())
    return b.flatten().to_numpy(zero_copy_only=False), n


def _listed(values: np.ndarray, n: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values, kind))


def _units(col) -> np.ndarray:
    """Rows of float32 from a column of unit bytes."""
    b = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(b.to_pylist()), np.int16).reshape(len(b), -1).astype(np.float32) / np.float32(SCALE)


def _unit_bytes(vec: Column) -> Column:
    @F.arrow_udf("binary")
    def to_bytes(col: pa.Array) -> pa.Array:
        x = np.array(col.to_pylist(), np.float64).reshape(len(col), -1)
        x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        return pa.array([r.tobytes() for r in np.round(x * SCALE).astype(np.int16)], pa.binary())

    return to_bytes(vec)


def _told(owner: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """A row with the lists of others and similarities for each owner; owners ascend."""
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(owner)))
    none = pa.nulls(len(at))
    return pa.RecordBatch.from_arrays([pa.array(owner[at], pa.int64()), none.cast(pa.binary()), _listed(v, n, pa.int64()), _listed(s, n, pa.float32()), none.cast(pa.list_(pa.bool_()))], ["u", "unit", "vs", "ss", "fresh"])


def _merged(rows: DataFrame, k: int, name: str) -> tuple[DataFrame, str, int]:
    """Lists of the k nearest of each node, from its old list and what it was told; also the path and how many entries are new."""
    spark = rows.sparkSession
    count = spark.sparkContext.accumulator(0)

    def keep(batches):
        for t in _whole_groups(batches, "u"):
            u, unit = t.column("u").to_numpy(), t.column("unit").combine_chunks()
            v, n = _flat(t.column("vs"))
            s, _ = _flat(t.column("ss"))
            own = unit.is_valid().to_numpy(zero_copy_only=False)
            fresh = np.repeat(~own, n)  # what a node has already is no news
            owner = np.repeat(u, n)
            o = _top(owner, v, s, k, (~fresh).astype(np.float32))
            nodes = u[own]  # a row each, ascending
            count.add(int(fresh[o].sum()))
            size = np.searchsorted(owner[o], nodes, "right") - np.searchsorted(owner[o], nodes, "left")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), unit.filter(pa.array(own)), _listed(v[o], size, pa.int64()), _listed(s[o], size, pa.float32()), _listed(fresh[o], size, pa.bool_())], ["u", "unit", "vs", "ss", "fresh"])

    lists, path = written_at(rows.repartition(partitions(spark), "u").sortWithinPartitions("u").mapInArrow(keep, LISTS), name)
    return lists, path, count.value


def _first_lists(nodes: DataFrame, n: int, k: int, trees: int, cell: int, block: int) -> DataFrame:
    """Neighbours within blocks of pivot cells; ``trees`` x 4096 vectors at most are broadcast."""
    spark = nodes.sparkSession
    pivots = 1 if n <= block else min(4096, max(1, n // cell))
    trees = 1 if n <= block else trees
    sample = [np.frombuffer(r[0], np.int16).astype(np.float32) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(trees * pivots).select("unit").collect()]
    shared = spark.sparkContext.broadcast([np.stack(sample[t::trees]) for t in range(trees)])

    def cells(batches):
        for batch in batches:
            x = _units(batch.column("unit"))
            for t, p in enumerate(shared.value):
                near = (x @ p.T).argmax(1) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(near.astype(np.int32)), batch.column("node"), batch.column("unit")], ["t", "cell", "node", "unit"])

    celled = nodes.select("node", "unit").mapInArrow(cells, "t int, cell int, node long, unit binary")
    # cells too small for a list join the largest of their tree: a row a cell is all that is counted
    in_tree = Window.partitionBy("t")
    counts = celled.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("to", F.when(F.col("n") > k, F.col("cell")).otherwise(F.max_by("cell", F.struct("n", "cell")).over(in_tree)))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("t", "to"))).select("t", "cell", "to", "all")
    salted = celled.join(F.broadcast(counts), ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "t", F.lit("block")), F.ceil(F.col("all") / block)))
    dealt = salted.select(F.xxhash64("t", "to", "part").alias("b"), "node", "unit").repartition(partitions(spark), "b").sortWithinPartitions("b")

    def compare(batches):
        for t in _whole_groups(batches, "b"):
            b, node = t.column("b").to_numpy(), t.column("node").to_numpy()
            x = _units(t.column("unit"))
            at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                m = min(k, e - s - 1)
                for i in range(s, e, 1024) if m else ():  # a hash may put more than one block here
                    j = min(e, i + 1024)
                    sim = x[i:j] @ x[s:e].T
                    sim[np.arange(j - i), np.arange(i - s, j - s)] = -9
                    o = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    yield _told(np.repeat(node[i:j], m), node[s:e][o].ravel(), np.take_along_axis(sim, o, 1).ravel())

    return dealt.mapInArrow(compare, LISTS)


def _meetings(lists: DataFrame, k: int, take: int, block: int) -> DataFrame:
    """What the nodes learn of each other where they meet: each at the nodes it lists, and at itself."""
    spark = lists.sparkSession
    full = F.when(F.size("vs") < k, F.lit(-9.0)).otherwise(F.array_min("ss")).cast("float")
    places = F.concat(F.arrays_zip(F.col("vs").alias("at"), F.col("fresh").alias("news")), F.array(F.struct(F.col("u").alias("at"), F.lit(False).alias("news"))))
    sent = lists.select("u", "unit", full.alias("worst"), F.explode(places).alias("e")).select(F.col("e.at").alias("at"), "u", "unit", "worst", F.col("e.news").alias("news"))

    def meet(batches):
        for t in _whole_groups(batches, "at"):
            at, node, worst, news = (t.column(c).to_numpy(zero_copy_only=False) for c in ("at", "u", "worst", "news"))
            x = _units(t.column("unit"))
            cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            us, vs, ss = [], [], []
            for s0, e0 in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for s in range(s0, e0, block):  # a hub's visitors meet in blocks
                    e = min(e0, s + block)
                    m = min(take, e - s - 1)
                    if not m or not news[s:e].any():
                        continue
                    sim = x[s:e] @ x[s:e].T
                    np.fill_diagonal(sim, -9)
                    sim[~(news[s:e, None] | news[None, s:e])] = -9
                    o = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    near = np.take_along_axis(sim, o, 1)
                    r, c = np.nonzero(near > np.maximum(worst[s:e, None], -2))
                    us.append(node[s:e][r])
                    vs.append(node[s:e][o[r, c]])
                    ss.append(near[r, c])
            if us:
                u, v, s = map(np.concatenate, (us, vs, ss))
                o = _top(u, v, s, k)
                yield _told(u[o], v[o], s[o])

    return sent.repartition(partitions(spark), "at").sortWithinPartitions("at", "u").mapInArrow(meet, LISTS)


def neighbour_graph(nodes: DataFrame, n: int, k: int, take: int, settled: float, trees: int, cell: int, block: int) -> DataFrame:
    """Lists of about the ``k`` nearest of each of the ``n`` nodes (columns node and unit)."""
    spark = nodes.sparkSession
    own = nodes.select(F.col("node").alias("u"), "unit", F.lit(None).cast("array<long>").alias("vs"), F.lit(None).cast("array<float>").alias("ss"), F.lit(None).cast("array<boolean>").alias("fresh"))
    lists, path, fresh = _merged(own.unionByName(_first_lists(nodes, n, k, trees, cell, block)), k, "graph")
    # every new entry is nearer than the one it replaces, so this ends for any ``settled``
    while n > block and fresh > settled * n * k:
        new, new_path, fresh = _merged(lists.unionByName(_meetings(lists, k, take, block)), k, "graph")
        drop_scratch(spark, path)
        lists, path = new, new_path
    return lists


def _graph_table(lists: DataFrame, most: int = 256) -> str:
    """A table bucketed by node: ids and vectors of the nodes that list it, ``most`` of them a row."""
    n = partitions(lists.sparkSession)
    near = lists.select("u", "unit", F.explode("vs").alias("node"))

    def pack(batches):
        for t in _whole_groups(batches, "node"):
            node, u, raw = t.column("node").to_numpy(), t.column("u").to_numpy(), t.column("unit").to_pylist()
            place = np.arange(len(node)) - np.searchsorted(node, node, "left")
            at = np.flatnonzero(place % most == 0)
            end = np.append(at, len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), _listed(u, np.diff(end), pa.int64()), pa.array([b"".join(raw[s:e]) for s, e in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)], pa.binary())], ["node", "near", "units"])

    packed = near.repartition(n, "node").sortWithinPartitions("node").mapInArrow(pack, "node long, near array<long>, units binary")
    name = f"tidelark_graph_{uuid.uuid4().hex}"
    packed.write.bucketBy(n, "node").sortBy("node").format("parquet").saveAsTable(name)  # dealt out as the buckets are: a file each
    return name


def _search(queries: DataFrame, lists: DataFrame, table: str, beam: int) -> DataFrame:
    """State rows with the ``beam`` nearest nodes found of each query (columns q, qunit)."""
    spark = queries.sparkSession
    graph = spark.table(table)

    def expand(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near, n = _flat(batch.column("near"))
            q = np.repeat(batch.column("q").to_numpy(), n)
            least = np.repeat(batch.column("least").to_numpy(), n)
            x = _units(batch.column("qunit"))
            y = _units(pa.array([b"".join(batch.column("units").to_pylist())], pa.binary())).reshape(len(q), -1)
            s = np.einsum("ij,ij->i", np.repeat(x, n, axis=0), y)
            o = np.flatnonzero((near != q) & (s > least))
            o = o[_top(q[o], near[o], s[o], beam)]
            yield pa.RecordBatch.from_arrays([pa.array(q[o]), pa.array(near[o]), pa.array(s[o], pa.float32()), pa.array(np.zeros(len(o), np.int32)), pa.array(least[o])], ["q", "v", "s", "done", "least"])

    def settle_with(left):
        def settle(batches):
            for t in _whole_groups(batches, "q"):
                q, v, s, done = (t.column(c).to_numpy() for c in ("q", "v", "s", "done"))
                o = _top(q, v, s, beam, done.astype(np.float32))
                q, v, s, done = q[o], v[o], s[o], done[o]
                done = np.where(done == 0, 2, 1)  # 2: expanded in the next hop
                left.add(int((done == 2).sum()))
                first, last = np.searchsorted(q, q, "left"), np.searchsorted(q, q, "right")
                least = np.where(last - first < beam, np.float32(-9), s[last - 1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(done.astype(np.int32)), pa.array(least.astype(np.float32))], ["q", "v", "s", "done", "least"])

        return settle

    start = lists.select(F.col("u").alias("q"), F.explode(F.arrays_zip(F.col("vs").alias("v"), F.col("ss").alias("s"))).alias("e")).join(queries.select("q"), "q", "left_semi")
    found = start.select("q", "e.v", "e.s", F.lit(0).alias("done"), F.lit(-9.0).cast("float").alias("least"))
    state = path = None
    while True:
        left = spark.sparkContext.accumulator(0)
        new, new_path = written_at((found if state is None else found.unionByName(state)).repartition(partitions(spark), "q").sortWithinPartitions("q").mapInArrow(settle_with(left), STATE), "search")
        if path:
            drop_scratch(spark, path)
        state, path = new, new_path
        if not left.value:
            return state
        front = state.where("done = 2").select("q", F.col("v").alias("node"), "least").join(queries, "q")
        found = front.join(graph, "node").select("q", "qunit", "least", "near", "units").mapInArrow(expand, STATE)


def _recall(nodes: DataFrame, queries: DataFrame, found: DataFrame, k: int, probes: int) -> float:
    """The share of the true ``k`` nearest nodes of ``probes`` queries, drawn by hash, that were found: one pass over the nodes."""
    spark = nodes.sparkSession
    asked = queries.orderBy(F.xxhash64("q"), "q").limit(probes).collect()
    ids = np.array([r["q"] for r in asked], np.int64)
    shared = spark.sparkContext.broadcast((ids, np.stack([np.frombuffer(r["qunit"], np.int16).astype(np.float32) for r in asked])))

    def nearest(batches):
        q, x = shared.value
        v, s = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            near = x @ _units(batch.column("unit")).T
            near[q[:, None] == node] = -np.inf
            s, v = np.concatenate((s, near), 1), np.concatenate((v, np.broadcast_to(node, near.shape)), 1)
            o = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            s, v = np.take_along_axis(s, o, 1), np.take_along_axis(v, o, 1)
        there = np.isfinite(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], v.shape)[there]), pa.array(v[there]), pa.array(s[there], pa.float32())], ["q", "v", "s"])

    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "v"))
    true = nodes.select("node", "unit").mapInArrow(nearest, "q long, v long, s float").withColumn("r", best).where(F.col("r") <= k).select("q", "v")
    hit = found.select("q", "v", F.lit(1).alias("hit"))
    return true.join(hit, ["q", "v"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = 48, take: int = 10, settled: float = 0.02, beam: int = 128, trees: int = 6, cell: int = 256, block: int = 1024, target: float = 0.95, probes: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row that meets ``is_query``, the row itself left out.

    ``is_query`` is a condition on ``id_col``.  All other rows are candidates.
    Score is the cosine of the original vectors in double precision; ties go to
    the smaller id.
    """
    spark = vectors.sparkSession
    neighbours, beam = max(neighbours, 2 * k), max(beam, 8 * k)
    small_batches(spark, 2000, 16 << 20)  # a row may hold the vectors of 256 nodes
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = written(rows.groupBy("id", "vec").agg(F.max("asks").alias("asks")).withColumn("size", F.size("vec")), "vectors")
    sizes = [r[0] for r in rows.groupBy("size").agg(F.max("asks").alias("asks")).where("asks").select("size").orderBy("size").collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in sizes:  # a table has one length as a rule
        found = _search_length(rows.where(F.col("size") == size), k, neighbours, take, settled, beam, trees, cell, block, target, probes)
        out = found if size == sizes[0] else out.unionByName(found)
    return out


def _search_length(rows: DataFrame, k: int, neighbours: int, take: int, settled: float, beam: int, trees: int, cell: int, block: int, target: float, probes: int) -> DataFrame:
    spark = rows.sparkSession
    grouped = rows.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("members"), F.max("asks").alias("asks"))
    nodes = written(grouped.select("node", "members", "asks", "vec", _unit_bytes(F.col("vec")).alias("unit")), "nodes")
    n = nodes.count()
    lists = neighbour_graph(nodes, n, neighbours, take, settled, trees, cell, block)
    queries = nodes.where("asks").select(F.col("node").alias("q"), F.col("unit").alias("qunit"))
    table = _graph_table(lists)
    try:
        found = _search(queries, lists, table, beam)
        while n > block and beam < n and _recall(nodes, queries, found, k, probes) < target:
            beam *= 2
            found = _search(queries, lists, table, beam)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "v"))
    near = found.withColumn("r", best).where(F.col("r") <= max(32, 4 * k)).select("q", F.col("v").alias("node")).unionByName(queries.select("q", F.col("q").alias("node")))
    # of equal vectors only the k + 1 smallest ids can be among the k nearest
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    ids = rows.join(nodes.where("members > 1").select("vec", "node"), "vec").withColumn("r", place).where(F.col("r") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("ids"))
    listed = nodes.select("node", "vec").join(ids, "node", "left").select("node", F.col("vec").alias("there"), F.coalesce("ids", F.array("node")).alias("ids"))
    scored = near.join(listed, "node").join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("here")), "q").select("q", cosine(F.col("here"), F.col("there")).alias("score"), F.explode("ids").alias("id"))
    # of each distinct vector k + 1 at most go to the queries that have it
    ranked = scored.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id").alias("vec_id")))), 1, k + 1).alias("top"))
    asks = rows.where("asks").select(F.col("id").alias("query_id"), "vec").join(nodes.select("vec", F.col("node").alias("q")), "vec").select("query_id", "q")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = asks.join(ranked, "q").select("query_id", F.posexplode(others).alias("at", "e"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.far")).alias("score"))

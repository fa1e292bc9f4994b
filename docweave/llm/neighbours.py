"""Operator 3: approximate nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import NULL_ID, row_key, table, written

NEIGHBOURS = 20
EVERY = 20
#: Children of a node; vectors of a leaf; vectors of a cell, the part of the tree that one task grows and searches.
BRANCH, LEAF, CELL = 8, 8, 8192
#: Vectors that a node which holds more than a cell is split by, about; bytes that these may take.
SAMPLE, SAMPLE_BYTES = 20_000, 256 << 20
#: Queries that the search is calibrated on, in every node that is split and in every cell, and the recall to reach there.
CALIBRATE, ROUTE_RECALL, CELL_RECALL = 64, 0.96, 0.95
#: Rows of a node that one task places, queries that one task routes, and queries that are asked of a cell in one task.
PLACE_ROWS, ROUTE_ROWS, QUERY_BLOCK = 100_000, 20_000, 8192
#: Queries whose scores, and pairs whose exact scores, are held at once; levels of cells at most.
STEP, ROWS, LEVELS = 128, 50_000, 12
#: By how many of its rows' deviations an inner node, and a leaf, counts as nearer than its centre: something in it may be.
INNER_AHEAD, LEAF_AHEAD = 3.0, 2.0
SEED = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from k-means++ seeds: centres and each row's centre."""
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    own = nearest(x, centres)
    used, own = np.unique(own, return_inverse=True)
    return centres[used], own


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


@dataclass
class KMeansTree:
    """Nodes in one array of centres; a node's children lie side by side; a node without children is a leaf."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ahead: np.ndarray  #: what a node's rows may add to its centre's inner product with a query of length 1
    own: np.ndarray  #: the leaf of every row that the tree was grown on
    visits: int = 1

    @classmethod
    def grow(cls, x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = SEED) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centres, first, count, spread, todo = [x.mean(axis=0)], [0], [0], [0.0], [(0, np.arange(len(x)))]
        own_leaf = np.zeros(len(x), np.int64)
        while todo:
            node, rows = todo.pop()
            own_leaf[rows] = node
            spread[node] = float(((x[rows] - centres[node]) ** 2).mean()) ** 0.5
            if len(rows) <= leaf:
                continue
            found, own = kmeans(x[rows], branch, rng)
            if len(found) < 2:
                continue
            first[node], count[node] = len(centres), len(found)
            for i, c in enumerate(found):
                todo.append((len(centres), rows[own == i]))
                centres.append(c)
                first.append(0)
                count.append(0)
                spread.append(0.0)
        count = np.array(count)
        return cls(np.array(centres), np.array(first), count, np.array(spread) * np.where(count > 0, INNER_AHEAD, LEAF_AHEAD), own_leaf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to by going to the nearest child."""
        node, centres = np.zeros(len(x), np.int64), padded(self.centres, x.shape[1])
        x = padded(x, centres.shape[1])
        while True:
            inner = np.flatnonzero(self.count[node] > 0)
            if not len(inner):
                return node
            for at in np.unique(node[inner]).tolist():
                rows = inner[node[inner] == at]
                a, n = self.first[at], self.count[at]
                node[rows] = a + nearest(x[rows], centres[a : a + n])

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """What every node promises every query: its centre's inner product (missing components are 0) and what may be added."""
        width = min(queries.shape[1], self.centres.shape[1])
        return queries[:, :width] @ self.centres[:, :width].T + np.linalg.norm(queries, axis=1)[:, None] * self.ahead

    def leaves(self, scores: list[float], visits: int) -> list[int]:
        """The first `visits` leaves, best bin first: the open node that promises most is next."""
        heap, found, first, count = [(0.0, 0)], [], self.first, self.count
        while heap and len(found) < visits:
            _, node = heapq.heappop(heap)
            n = int(count[node])
            if not n:
                found.append(node)
                continue
            a = int(first[node])
            for i in range(a, a + n):
                heapq.heappush(heap, (-scores[i], i))
        return found

    def calibrate(self, x: np.ndarray, queries: np.ndarray, recall: float, itself: np.ndarray, k: int = NEIGHBOURS) -> KMeansTree:
        """Widens the number of leaves visited until the queries find that share of their k nearest in x, the grown rows.

        itself: for each query its own row of x, which isn't one of its neighbours, or -1.
        """
        total, need = int((self.count == 0).sum()), []
        for best, scores in zip(self._nearest(x, queries, itself, k), self.scores(queries).tolist()):
            place = {leaf: j for j, leaf in enumerate(self.leaves(scores, total), 1)}
            need += [place[leaf] for leaf in self.own[best].tolist()]
        self.visits = int(np.quantile(need, recall, method="higher")) if need else 1
        return self

    @staticmethod
    def _nearest(x: np.ndarray, queries: np.ndarray, itself: np.ndarray, k: int) -> Iterator[np.ndarray]:
        width = min(x.shape[1], queries.shape[1])
        for q, own in zip(queries, itself.tolist()):
            near, n = x[:, :width] @ q[:width], len(x)
            if own >= 0:
                near[own], n = -np.inf, n - 1
            yield np.argpartition(-near, min(k, n) - 1)[: min(k, n)] if n else np.zeros(0, np.int64)

    def slack(self, x: np.ndarray, queries: np.ndarray, recall: float, itself: np.ndarray, k: int = NEIGHBOURS) -> float:
        """By how much, for queries of length 1, that share of the rows nearest to the queries score above what their leaf promises at most."""
        width, gaps = min(x.shape[1], queries.shape[1]), []
        for best, q, scores in zip(self._nearest(x, queries, itself, k), queries, self.scores(queries)):
            gaps += ((x[best, :width] @ q[:width] - scores[self.own[best]]) / np.linalg.norm(q)).tolist()
        return float(np.quantile(gaps, recall)) if gaps else 0.0

    def enough(self, k: int) -> KMeansTree:
        """Widens the number of leaves so that the smallest ones together hold more than k rows."""
        held = np.cumsum(np.sort(np.bincount(self.own, minlength=len(self.count))[self.count == 0]))
        self.visits = min(len(held), max(self.visits, int(np.searchsorted(held, k + 1)) + 1))
        return self


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones with zeros at the end."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, size = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64), flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=1))
    if (size == width).all():
        return values.reshape(len(flat), width)
    out = np.zeros((len(flat), width))
    row = np.repeat(np.arange(len(flat)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


VECTOR = "uid long, vec_id long, v array<double>, home boolean, leaf long"


def usable(embeddings: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """uid, vec_id, v (double array), least (whether it can be a neighbour), and the cell of a tree of one: all vectors that take part.

    Vectors that are null, empty, zero or hold null or non-finite components take none. uid names a row, also among rows
    of one vec_id; of equal vectors only the k + 1 smallest vec_ids can be among anyone's nearest: those are least.
    """
    rows = embeddings.select(row_key("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    rows = rows.where(fine).withColumn("h", F.xxhash64("v")).withColumn("nth", F.row_number().over(same))
    start = [F.lit(True).alias("home"), F.lit(0).cast("long").alias("leaf")]
    return rows.select(F.xxhash64("vec_id", "h", "nth").alias("uid"), "vec_id", "v", *start, (F.col("nth") <= k + 1).alias("least"))


def _grown(sample: pa.Table) -> pa.Table:
    """The rows that stand for a node (leaf, n, v) -> its tree, whose leaves will hold most of a cell each, calibrated."""
    x, n = matrix(sample.column("v")), sample.column("n")[0].as_py()
    order = np.lexsort(x.T[::-1])  # the same tree whatever the order of arrival
    x = x[order]
    tree = KMeansTree.grow(x, max(LEAF, int(0.8 * CELL * len(x) / n)))
    asked = np.arange(0, len(x), max(1, len(x) // CALIBRATE))
    # the sample holds that share of a query's neighbours
    tree.calibrate(x, x[asked], ROUTE_RECALL, asked, max(1, round(NEIGHBOURS * len(x) / n))).enough(NEIGHBOURS)
    tree.own = tree.own[:0]
    return pa.table({"leaf": sample.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _trees(table_: pa.Table) -> KMeansTree:
    return pickle.loads(table_.column("tree")[0].as_py())


def _place(rows: pa.Table, trees: pa.Table) -> pa.Table:
    at = _trees(trees).leaf_of(matrix(rows.column("v"))) if rows.num_rows and trees.num_rows else np.zeros(rows.num_rows, np.int64)
    return rows.select(["uid", "vec_id", "v", "home", "leaf"]).append_column("sub", pa.array(at, pa.int64()))


def _route(rows: pa.Table, trees: pa.Table) -> pa.Table:
    out, rows = [], rows.select(["uid", "vec_id", "v", "home", "leaf"])
    if trees.num_rows:
        tree = _trees(trees)
        for at in range(0, rows.num_rows, STEP):
            part = rows.slice(at, STEP)
            found = [tree.leaves(s, tree.visits) for s in tree.scores(matrix(part.column("v"))).tolist()]
            took = part.take(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
            first = np.concatenate([np.arange(len(f)) == 0 for f in found])
            home = pa.array(first & took.column("home").to_numpy())
            out.append(took.set_column(3, "home", home).append_column("sub", pa.array([x for f in found for x in f], pa.int64())))
    return pa.concat_tables(out) if out else rows.slice(0, 0).append_column("sub", pa.array([], pa.int64()))


def _descend(rows: DataFrame, full: DataFrame, trees: DataFrame, step, most: int, label: str) -> DataFrame:
    """Rows of full nodes, most of them to a task, by `step` with the node's tree to nodes below; the others stay."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).alias("tasks")).join(full.select("leaf"), "leaf")
    met = rows.join(sizes, "leaf", "left")
    there = met.where("tasks is not null").withColumn("task", F.pmod("uid", "tasks"))
    told = trees.join(sizes, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    moved = there.drop("tasks").groupBy("leaf", "task").cogroup(told.groupBy("leaf", "task")).applyInArrow(step, VECTOR + ", sub long")
    moved = moved.withColumn("leaf", F.xxhash64("leaf", "sub")).drop("sub")
    return written(met.where("tasks is null").drop("tasks").unionByName(moved), label)


def _deal(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and queries by the cells that they belong to or ask, and the cells' sizes: leaf, n.

    Level by level every node of more than CELL rows is split by a tree that one task grows on about SAMPLE of them;
    queries go to the children that best-bin-first traversal reaches, as many as calibration asks for; the first is their
    home. A node that can't be split any more (or is full on the last level) stays one, and its rows are dealt to blocks.
    """
    stuck = None
    for level in range(LEVELS):
        sizes = written(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "ann-cells")
        full = sizes.where(F.col("n") > CELL)
        state = tuple(full.agg(F.count(F.lit(1)), F.max("n")).first())
        if not state[0] or state == stuck:
            break
        stuck = state
        wide = rows.agg(F.max(F.size("v"))).first()[0]
        sample = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * wide)))
        picked = rows.join(full, "leaf").where(F.pmod(F.xxhash64("uid", F.lit(SEED + level)), "n") < sample).select("leaf", "n", "v")
        trees = written(picked.groupBy("leaf").applyInArrow(_grown, "leaf long, tree binary"), "ann-trees")
        rows = _descend(rows, full, trees, _place, PLACE_ROWS, "ann-placed")
        queries = _descend(queries, full, trees, _route, ROUTE_ROWS, "ann-routed")
    return rows, queries, written(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "ann-cells")


@dataclass
class Cell:
    """A block of a cell's rows in order of their leaves, and the tree over them."""

    x: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    tree: KMeansTree

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> Cell:
        order = np.lexsort((uids, ids))
        x, ids, uids = x[order], ids[order], uids[order]
        tree = KMeansTree.grow(x)
        order = np.argsort(tree.own, kind="stable")
        tree.own = tree.own[order]
        return cls(x[order], ids[order], uids[order], tree)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best for each query, itself and what is below its least left out: query, row, score, rows and centres looked at.

        The search is calibrated on some of the queries; a query's leaves are then visited best bin first: a number of them,
        or, where a least is known, as many as promise to come near enough to it. A query's counts are on its first line.
        """
        width = max(queries.shape[1], self.x.shape[1])
        queries, x, ids, tree = padded(queries, width), padded(self.x, width), self.ids, self.tree
        asked = np.arange(0, len(queries), max(1, len(queries) // CALIBRATE))
        at = dict(zip(self.uids.tolist(), range(len(ids))))
        itself = np.array([at.get(u, -1) for u in own[asked].tolist()])
        tree.calibrate(x, queries[asked], CELL_RECALL, itself, k).enough(k)
        slack, ends = tree.slack(x, queries[asked], CELL_RECALL, itself, k), np.flatnonzero(tree.count == 0)
        nodes = np.arange(len(tree.count))
        begin, end = np.searchsorted(tree.own, nodes, "left"), np.searchsorted(tree.own, nodes, "right")
        out = []
        for a in range(0, len(queries), STEP):
            q = queries[a : a + STEP]
            centre, bound = tree.scores(q), least[a : a + STEP]
            # only leaves that can hold something above what the query has already
            able = (centre[:, ends] >= (bound - slack * np.linalg.norm(q, axis=1))[:, None]).sum(axis=1)
            visits = np.where(np.isfinite(bound), able, tree.visits).tolist()
            found = [tree.leaves(c, n) for c, n in zip(centre.tolist(), visits)]
            who, where = np.repeat(np.arange(len(q)), [len(f) for f in found]), np.array([n for f in found for n in f], np.int64)
            by = np.argsort(where, kind="stable")
            scores = np.full((len(q), len(x)), -np.inf)
            edge = np.flatnonzero(np.concatenate(([True], where[by][1:] != where[by][:-1], [True]))) if len(where) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                node, asking = where[by[i]], who[by[i:j]]
                scores[asking, begin[node] : end[node]] = q[asking] @ x[begin[node] : end[node]].T
            seen = np.isfinite(scores).sum(axis=1)
            last = max(0, len(x) - k - 1)
            limit = np.maximum(np.partition(scores, last, axis=1)[:, last], bound)
            limit = np.where(np.isfinite(limit), limit - 1e-9 * np.maximum(1.0, np.abs(limit)), -1.7e308)
            row, col = np.nonzero(scores >= limit[:, None])
            other = self.uids[col] != own[a + row]
            row, col = row[other], col[other]
            # summed row by row: equal vectors get equal scores wherever they stand
            exact = np.concatenate([(x[col[i : i + ROWS]] * q[row[i : i + ROWS]]).sum(axis=1) for i in range(0, max(len(row), 1), ROWS)])
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            none = np.setdiff1d(np.arange(len(q)), row)  # what they looked at counts too
            out.append((a + np.concatenate((row[best], none)), np.concatenate((ids[col[best]], none * 0)), np.concatenate((exact[best], none * np.nan)), seen[np.concatenate((row[best], none))]))
        row, found, exact, seen = (np.concatenate(c) for c in zip(*out))
        first = np.concatenate(([True], row[1:] != row[:-1]))
        return row, found, exact, np.where(first, seen, 0), np.where(first, len(nodes), 0)


FOUND = "uid long, query_id long, vec_id long, score double, scored long, centres long"


def _indexed(rows: pa.Table) -> pa.Table:
    cell = Cell.of(matrix(rows.column("v")), rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy())
    return pa.table({"leaf": rows.column("leaf").slice(0, 1), "block": rows.column("block").slice(0, 1), "cell": pa.array([pickle.dumps(cell)], pa.large_binary()).cast(pa.binary())})


def _match(k: int):
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(cells: pa.Table, queries: pa.Table) -> pa.Table:
        if not cells.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        queries = queries.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        own, asked, least = (queries.column(c).to_numpy() for c in ("uid", "vec_id", "least"))
        row, ids, score, scored, centres = pickle.loads(cells.column("cell")[0].as_py()).top(matrix(queries.column("v")), own, k, least)
        return pa.table(dict(zip(names, (own[row], asked[row], ids, score, scored, centres))))

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score, scored, centres: every query's k nearest among rows (uid, vec_id, v, home, leaf).

    The index is a table of cells, each with its rows and the tree grown on them; a cell of more than about CELL rows that
    can't be split is several blocks. Every query asks its home cell first; what it finds there is the least that others
    have to offer, and so bounds how far they are searched.
    """
    columns = ("uid", "vec_id", "v", "home", "leaf")
    # aliases, so that both sides can come of one table
    placed, routed, sizes = _deal(rows.select(*columns), queries.select(*[F.col(c).alias(c) for c in columns]))
    cut = written(sizes.select("leaf", F.ceil(F.col("n") / CELL).alias("blocks")), "ann-cut")
    dealt = placed.join(cut, "leaf").withColumn("block", F.pmod("uid", "blocks"))
    cells = written(dealt.groupBy("leaf", "block").applyInArrow(_indexed, "leaf long, block long, cell binary"), "ann-index")

    def ask(asking: DataFrame, label: str) -> DataFrame:
        asked = asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts")).join(cut, "leaf")
        asked = written(asked, f"{label}-parts")
        left = cells.join(asked, "leaf").select("leaf", "block", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = asking.join(asked, "leaf").select("uid", "vec_id", "v", "least", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("uid", "parts").alias("part"))
        keys = ["leaf", "block", "part"]
        return written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_match(k), FOUND), label)

    own = Window.partitionBy("uid", "query_id")
    best = own.orderBy(F.desc_nulls_last("score"), "vec_id")
    real = F.when(~F.isnan("score"), F.col("score")).alias("score")
    first = ask(routed.where("home").withColumn("least", F.lit(float("-inf"))), "ann-home").withColumn("score", real)
    bound = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("uid", "query_id", F.col("score").alias("__least"))
    away = routed.where(~F.col("home")).join(bound, (routed["uid"] == bound["uid"]) & (routed["vec_id"] == bound["query_id"]), "left")
    away = away.select(routed["uid"], "vec_id", "v", "leaf", F.coalesce("__least", F.lit(float("-inf"))).alias("least"))
    found = first.unionByName(ask(away, "ann-away").withColumn("score", real))
    found = found.withColumn("rank", F.row_number().over(best)).withColumns({c: F.sum(c).over(own) for c in ("scored", "centres")})
    return found.where((F.col("rank") <= k) & F.col("score").isNotNull()).select("query_id", "rank", F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score", "scored", "centres")


def nearest_vectors(embeddings: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest, by largest inner product, of every vector whose vec_id is divisible by `every`, nearest first.

    scored and centres: the rows, and the centres of nodes, of which an inner product with the query was computed in the
    cells that it came to.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. All others do: a row of a null
    vec_id is a candidate (before all others in ties) but no query, rows of one vec_id are candidates and queries of their
    own, and of vectors of different lengths the shorter counts as 0 where it ends. A query with fewer than k candidates
    gets those; an empty table gives an empty result. Other columns are not looked at.
    """
    rows = written(usable(embeddings, k), "ann-rows")
    queries = rows.where((F.col("vec_id") != NULL_ID) & (F.col("vec_id") % every == 0))
    return search(rows.where("least"), queries, k)


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"))

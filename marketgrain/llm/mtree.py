"""Exact top-k by inner product, by best-first search over M-trees.

Vectors become integers, floor(scale * x). A vector u gets one more coordinate, sqrt(M**2 - |u|**2), M the greatest length
of all, a query q gets 0 there; then the Euclidean distance of the two falls as their inner product rises, since
d**2 = |q|**2 + M**2 - 2 * q.u, and it is a metric, which inner products are not.

Index. The top level is a bounded sample of routing objects, far from one another, with the covering radius of all that is
nearest to each; what is nearest to one, or copies of one vector, however many, is dealt by row over shards of bounded
size. Each shard is an M-tree of pages: an inner page holds routing objects, their covering radii and their distances to the
page's own object; a leaf page holds entries and their distances to its object. A page is a row of a table.

Search. A query visits the shard of the top-level object with the least bound first; its k-th score then bounds all others: only shards
whose covering radius reaches within the k-th distance are visited, and these give nothing that scores less. Within a shard
the page with the least lower bound comes first; stored distances to the parent, by the triangle inequality, rule out
pages and entries before their own distances are computed. Bounds are doubles and give way by more than their rounding,
scores are exact integers, so ties come out right. Shards and groups of queries meet by key, both of bounded size. The
embeddings of high dimension at hand lie about as far from each other as from any routing object: there, bounds rule out little, and the
search costs what comparing all does.

Nulls and edges: a missing vector (see ``vectors``) or a row without vec_id takes no part; a query is one row, so rows that
share its vec_id, or are equal to it, are candidates like others, and a repeated query row has its own result; ties go to the smaller
vec_id, then to the earlier row; fewer candidates than k are all returned; scores of 2**53 or more in size raise a
ValueError; an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.shared import settled, written
from marketgrain.llm.vectors import matrix, usual_length

#: Rows from which routing objects of the top level are chosen, and how many of these there are at most.
SAMPLE_ROWS = 4096
MOST_ROUTES = 1024
#: A small table is dealt over about so many shards; from there on a shard has about SHARD_ROWS rows, fewer if vectors are so long that these
#: would have more than SHARD_BYTES as doubles.
LEAST_SHARDS = 64
SHARD_ROWS = 32_768
SHARD_BYTES = 64 << 20
LEAF, FANOUT = 128, 16
#: Queries that meet a shard at once.
QUERY_ROWS = 4096
#: By this share, distances may be wrong before a bound counts.
SLACK = 1e-7

_PLACED = "row long, vec_id long, u binary, route int, distance double"
_PAGE = "shard int, page int, leaf boolean, centre binary, near binary, radius binary, child binary, row binary, vec_id binary, u binary"


def _int32(column) -> np.ndarray:
    """The column's vectors as a matrix of doubles."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.int32).reshape(len(cells), -1 if cells else 0).astype(np.float64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def integer_vectors(rows: DataFrame, scale: int, length: int) -> DataFrame:
    """``rows``: row, vec_id, embedding. Returns row, vec_id, u (floor(scale * x), little-endian int32), of the vectors that count."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = matrix(batch.column(2), length)
            u = np.floor(found * scale)
            if u.size and (u * u).sum(axis=1).max() >= 2**53:
                raise ValueError("scores of 2**53 or more can't be told exactly")
            taken = pa.array(numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), _binary(u.astype(np.int32))], ["row", "vec_id", "u"])

    return rows.mapInArrow(read, "row long, vec_id long, u binary")


def apart(u: np.ndarray, extra: np.ndarray, most: int) -> list[int]:
    """Up to ``most`` of the vectors, each the farthest from those before; copies are taken once."""
    norms = (u * u).sum(axis=1) + extra * extra
    chosen, nearest = [0], np.full(len(u), np.inf)
    while len(chosen) < min(most, len(u)):
        last = chosen[-1]
        nearest = np.minimum(nearest, norms + norms[last] - 2 * (u @ u[last] + extra * extra[last]))
        farthest = int(nearest.argmax())
        if nearest[farthest] <= SLACK * norms[farthest]:
            break
        chosen.append(farthest)
    return chosen


@dataclass
class Metric:
    """Distances between vectors that have got their further coordinate; ``square``: M**2."""

    square: float

    def extra(self, u: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (u * u).sum(axis=1), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """From each of a to each of b, both indexed."""
        product = a @ b.T + np.outer(self.extra(a), self.extra(b))
        return np.sqrt(np.maximum(2 * (self.square - product), 0))

    def of_scores(self, square: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """From queries with these squared lengths to the indexed vectors that they score so."""
        return np.sqrt(np.maximum(square + self.square - 2 * scores, 0))

    def slack(self, square: float) -> float:
        return SLACK * (1 + np.sqrt(square) + np.sqrt(self.square))


@dataclass
class Top:
    """The top level: routing objects, their covering radii, and each one's shards (first, number)."""

    metric: Metric
    routes: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    parts: np.ndarray


@dataclass
class Index:
    top: Top
    #: A row for each page of the shards' trees.
    pages: DataFrame


def _pages(u: np.ndarray, metric: Metric, capacity: int = LEAF, fanout: int = FANOUT) -> list[dict]:
    """The pages of one shard's tree, the root first; rows are numbers into ``u``."""
    pages: list[dict] = []

    def grow(rows: np.ndarray, centre: np.ndarray) -> tuple[int, float]:
        """Returns the new page's number and its covering radius."""
        number = len(pages)
        page = {"page": number, "centre": centre}
        pages.append(page)
        near = metric.between(u[rows], centre[None])[:, 0]
        radius = float(near.max())
        if len(rows) <= capacity:
            page |= {"leaf": True, "near": near, "radius": np.zeros(0), "child": np.zeros(0, np.int32), "rows": rows}
            return number, radius
        sample = rows[:: max(1, len(rows) // (16 * fanout))]
        chosen = sample[apart(u[sample], metric.extra(u[sample]), fanout)]
        own = metric.between(u[rows], u[chosen]).argmin(axis=1)
        groups = [(u[c], rows[own == k]) for k, c in enumerate(chosen)]
        if len(chosen) == 1:  # copies of one vector, or nearly
            groups = [(u[chosen[0]], part) for part in np.array_split(rows, min(fanout, -(-len(rows) // capacity)))]
        groups = [(c, g) for c, g in groups if len(g)]
        grown = [grow(g, c) for c, g in groups]
        near = metric.between(np.array([c for c, _ in groups]), centre[None])[:, 0]
        page |= {"leaf": False, "near": near, "radius": np.array([r for _, r in grown]), "child": np.array([n for n, _ in grown], np.int32), "rows": np.zeros(0, np.int64)}
        return number, radius

    grow(np.arange(len(u)), u[0])
    return pages


def build_index(vectors: DataFrame) -> Index:
    """``vectors``: a written table of row, vec_id, u."""
    spark = vectors.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _int32(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(u)], pa.int64()), pa.array([float((u * u).sum(axis=1).max()) if len(u) else 0.0])], ["n", "square"])

    n, square = vectors.select("u").mapInArrow(lengths, "n long, square double").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("square"), F.lit(0.0))).first()
    metric = Metric(square)
    longest = vectors.select("u").first()
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // max(1, 2 * len(longest["u"])))) if longest is not None else 1
    sample = vectors.select("row", "u").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).collect()
    chosen = _int32(pa.array([r["u"] for r in sample], pa.binary())) if sample else np.zeros((0, 0))
    routes = chosen[apart(chosen, metric.extra(chosen), min(MOST_ROUTES, max(LEAST_SHARDS, -(-n // most))))] if sample else chosen

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = metric.between(_int32(batch.column(2)), routes)
                route = distances.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route.astype(np.int32)), pa.array(distances[np.arange(len(route)), route])], ["row", "vec_id", "u", "route", "distance"])

    placed = written(vectors.mapInArrow(place, _PLACED), "placed")
    told = {r["route"]: r for r in placed.groupBy("route").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    counts = np.array([told[k]["n"] if k in told else 0 for k in range(len(routes))], np.int64)
    radii = np.array([told[k]["radius"] if k in told else 0.0 for k in range(len(routes))])
    size = max(1, min(most, -(-2 * n // LEAST_SHARDS)))
    parts = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)
    dealt = pd.DataFrame({"route": np.arange(len(routes), dtype=np.int32), "first": first, "parts": parts})

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        u, shard = _int32(table["u"]), table["shard"][0].as_py()
        rows, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
        made = []
        for p in _pages(u, metric):
            own = p["rows"]
            made.append((shard, p["page"], p["leaf"], p["centre"].astype(np.int32).tobytes(), p["near"].tobytes(), p["radius"].tobytes(), p["child"].tobytes(), rows[own].tobytes(), ids[own].tobytes(), u[own].astype(np.int32).tobytes()))
        types = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 7]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made), types)], [c.split()[0] for c in _PAGE.split(", ")])

    # the top level has MOST_ROUTES rows at most
    known = F.broadcast(spark.createDataFrame(dealt, "route int, first long, parts long"))
    sharded = placed.join(known, "route").select((F.col("first") + F.pmod(F.xxhash64("row"), "parts")).cast("int").alias("shard"), "row", "vec_id", "u")
    pages = written(sharded.groupBy("shard").applyInArrow(build, _PAGE), "pages")
    return Index(Top(metric, routes, radii, first, parts), pages)


@dataclass
class Best:
    """The k best entries of a query so far; ``floor``: scores below it aren't wanted."""

    k: int
    floor: float
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        wanted = scores >= self.floor
        if not wanted.any():
            return
        scores, ids, rows = (np.concatenate([a, b[wanted]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores))[: self.k]
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])


class Tree:
    """One shard's pages, read for search. ``computed`` counts the distances and scores that were computed."""

    def __init__(self, table: pa.Table, metric: Metric):
        self.metric, self.computed, self.pages = metric, 0, {}
        columns = {name: table[name].to_pylist() for name in table.column_names}
        for i, number in enumerate(columns["page"]):
            raw = {n: columns[n][i] for n in ("centre", "near", "radius", "child", "row", "vec_id", "u")}
            centre = np.frombuffer(raw["centre"], np.int32).astype(np.float64)
            page = {"leaf": columns["leaf"][i], "centre": centre, "near": np.frombuffer(raw["near"]), "radius": np.frombuffer(raw["radius"])}
            page |= {"child": np.frombuffer(raw["child"], np.int32), "row": np.frombuffer(raw["row"], np.int64), "vec_id": np.frombuffer(raw["vec_id"], np.int64)}
            page["u"] = np.frombuffer(raw["u"], np.int32).astype(np.float64).reshape(len(page["row"]), len(centre))
            self.pages[number] = page
        for page in self.pages.values():
            if not page["leaf"]:
                page["objects"] = np.array([self.pages[c]["centre"] for c in page["child"].tolist()])

    def search(self, query: np.ndarray, row: int, best: Best) -> None:
        square = float(query @ query)
        slack = self.metric.slack(square)
        reach = lambda: float(self.metric.of_scores(square, best.floor)) + slack if np.isfinite(best.floor) else np.inf
        distance = lambda u: self.metric.of_scores(square, u @ query)
        self.computed += 1
        queue = [(0.0, 0, float(distance(self.pages[0]["centre"])))]  # lower bound, page, distance to its object
        while queue:
            bound, number, own = heapq.heappop(queue)
            most = reach()
            if bound > most:
                break
            page = self.pages[number]
            if page["leaf"]:
                open_ = np.flatnonzero(np.abs(own - page["near"]) <= most)
                if len(open_):
                    self.computed += len(open_)
                    scores = page["u"][open_] @ query
                    other = page["row"][open_] != row
                    best.add(scores[other], page["vec_id"][open_][other], page["row"][open_][other])
                continue
            open_ = np.flatnonzero(np.abs(own - page["near"]) - page["radius"] <= most)
            if len(open_):
                self.computed += len(open_)
                to = distance(page["objects"][open_])
                bounds = np.maximum(np.maximum(to - page["radius"][open_], 0), bound)
                for b, k, d in zip(bounds.tolist(), open_.tolist(), to.tolist()):
                    if b <= most:
                        heapq.heappush(queue, (b, int(page["child"][k]), d))


_ROUTED = "shard int, query long, query_id long, u binary, floor double, part int"
_FOUND = "query long, query_id long, vec_id long, row long, score long"


def _routed(queries: DataFrame, top: Top, first: bool, groups: int) -> DataFrame:
    """Each query under the shards to visit: one near it at first, then all others that its floor doesn't rule out."""

    def nearest(q: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        to = top.metric.of_scores((q * q).sum(axis=1)[:, None], q @ top.routes.T)
        bounds = np.where(top.parts > 0, to - top.radii, np.inf)
        least = np.lexsort((to, np.maximum(bounds, 0)), axis=1)[:, 0]
        return bounds, least, top.first[least] + numbers % np.maximum(top.parts[least], 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                q, numbers = _int32(own.column(2)), own.column(0).to_numpy()
                bounds, least, visited = nearest(q, numbers)
                if first:
                    which, shards = np.arange(len(q)), visited
                else:
                    squares, floors = (q * q).sum(axis=1), own.column(3).to_numpy()
                    reach = np.where(np.isfinite(floors), top.metric.of_scores(squares, np.maximum(floors, -(2.0**53))), np.inf) + np.array([top.metric.slack(s) for s in squares])
                    which, routes = np.nonzero((bounds <= reach[:, None]) & (top.parts > 0))
                    each = np.repeat(np.arange(len(which)), top.parts[routes])
                    nth = np.arange(len(each)) - np.repeat(np.cumsum(top.parts[routes]) - top.parts[routes], top.parts[routes])
                    shards = top.first[routes][each] + nth
                    which = which[each]
                    new = shards != visited[which]
                    which, shards = which[new], shards[new]
                for i in range(0, len(which), 8192):
                    w, taken = which[i : i + 8192], pa.array(which[i : i + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(shards[i : i + 8192].astype(np.int32)), *[c.take(taken) for c in own.columns], pa.array((numbers[w] % groups).astype(np.int32))], ["shard", "query", "query_id", "u", "floor", "part"])

    return queries.select("query", "query_id", "u", "floor").mapInArrow(route, _ROUTED)


def _visited(routed: DataFrame, index: Index, k: int, groups: int) -> DataFrame:
    """What each shard has for the queries that visit it: the k best there of those that reach the query's floor."""
    metric = index.top.metric

    def search(pages: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if pages.num_rows and queries.num_rows:
            tree, q = Tree(pages, metric), _int32(queries["u"])
            for i, (query, query_id, floor) in enumerate(zip(*(queries[c].to_pylist() for c in ("query", "query_id", "floor")))):
                best = Best(k, floor)
                tree.search(q[i], query, best)
                found += zip([query] * len(best.ids), [query_id] * len(best.ids), best.ids.tolist(), best.rows.tolist(), map(int, best.scores.tolist()))
        columns = zip(*found) if found else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "row", "score"])

    # every group of queries meets the shard's pages: a shard is repeated once for each QUERY_ROWS queries
    pages = index.pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["shard", "part"]
    return pages.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(search, _FOUND)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``queries``: a written table of query (its row), query_id, u. Returns query, query_id, rank, vec_id, score."""
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    open_ = queries.withColumn("floor", F.lit(float("-inf")))
    near = written(_visited(_routed(open_, index.top, True, groups), index, k, groups), "near")
    floors = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    bounded = queries.join(floors, "query", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
    rest = _visited(_routed(written(bounded.select("query", "query_id", "u", "floor"), "bounded"), index.top, False, groups), index, k, groups)
    ranked = near.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, is_query: Column, k: int, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For every row of ``table`` for which ``is_query`` (of a column vec_id) holds, the k other rows with the greatest inner products: query_id, rank
    (from 1), vec_id, score."""

    def found() -> DataFrame:
        rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
        rows = rows.where("vec_id is not null")
        vectors = written(integer_vectors(rows, scale, usual_length(rows, "embedding")), "vectors")
        if vectors.isEmpty():
            return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        queries = written(vectors.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "u"), "queries")
        return search(build_index(vectors), queries, k).select("query_id", "rank", "vec_id", "score")

    return settled(table.sparkSession, found, "top-k")

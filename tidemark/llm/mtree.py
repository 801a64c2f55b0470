"""Exact search for the largest inner products by metric trees of integer vectors.

Vectors get one more coordinate, sqrt(M² - |x|²) for rows (M: the largest length) and 0 for queries. Then
|q' - x'|² = |q|² + M² - 2 q·x, so the nearest rows by the metric are those of the largest inner product. Rows are dealt to
the nearest of a bounded number of pivots and by hash within them; each part becomes an M-tree of pages, whose entries hold
a routing vector, a covering radius and the distance to the parent's routing vector. A search takes the pages of a group of
trees by their lower bounds, best first, and leaves out entries by |d(q, parent) - d(parent, entry)| - radius before any
product is taken; a batch of queries shares the reading of a page. Bounds are compared as distances with a margin, scores as exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of the sample that gives pivots and first bounds, pivots among them, and rows of a tree on average at most.
SAMPLE, PIVOTS, TREE = 1024, 128, 8192
#: Entries of a leaf page, and children of an inner one.
LEAF, FANOUT = 64, 16
#: Queries and rows that meet in one task.
QUERIES, ROWS = 16_384, 65_536
#: Queries that are searched for together in a task.
BATCH = 1024
#: Scaled components from here on are refused, as their products could leave a long.
LIMIT = 1 << 26
SALTS = 16
PAGES = "tree int, page int, leaf boolean, n int, vectors binary, parent binary, radius binary, child binary, ids binary, sizes binary"


def scaled(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale x) of each component. Rows without an id, and vectors that are null or hold null or
    non-finite components, go; of rows that share an id the one with the smallest vector stays. Components too large for
    exact products are an error."""
    x = F.col("x")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False))))
    fits = F.forall(x, lambda e: F.abs(e) < LIMIT / scale)
    whole = F.transform(x, lambda e: F.floor(e * scale).cast("int"))
    rows = rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component of {LIMIT // scale} or more"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: list, size: int) -> np.ndarray:
    """Rows of `size` components, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), size), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lifted(m: np.ndarray, most: float) -> np.ndarray:
    m = m.astype(float)
    return np.hstack([m, np.sqrt(np.maximum(most - (m * m).sum(1), 0.0))[:, None]])


def _blob(a: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def grown(size: int, most: float):  # noqa: ANN201
    """For applyInPandas by tree over (tree, v, ids): the pages of one M-tree. Page 0 is its root."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        whole, ids = _matrix(part["v"].tolist(), size), part["ids"].tolist()
        points, pages = _lifted(whole, most), []

        def page(at: np.ndarray, above: np.ndarray | None) -> int:
            """Makes the page of some rows; above: the lifted routing vector that leads to it."""
            mine = len(pages)
            pages.append(None)
            far = np.zeros(len(at)) if above is None else np.sqrt(((points[at] - above) ** 2).sum(1))
            if len(at) <= LEAF:
                own = [ids[i] for i in at]
                pages[mine] = (True, len(at), _blob(whole[at], np.int32), _blob(far, float), b"", b"", _blob(np.array([i for x in own for i in x]), np.int64), _blob(np.array([len(x) for x in own]), np.int32))
                return mine
            k = min(FANOUT, ceil(len(at) / LEAF))
            chosen, near = [int(np.argmax(far))], np.full(len(at), np.inf)
            for _ in range(k - 1):  # each next routing vector is the row farthest from those before
                near = np.minimum(near, ((points[at] - points[at[chosen[-1]]]) ** 2).sum(1))
                chosen.append(int(np.argmax(near)))
            to = ((points[at][:, None, :] - points[at[chosen]][None]) ** 2).sum(2)
            nearest = to.argmin(1)
            if np.bincount(nearest, minlength=k).max() > 0.9 * len(at):  # no metric groups: equal parts by distance
                nearest = np.empty(len(at), int)
                nearest[np.argsort(to[:, 0], kind="stable")] = np.arange(len(at)) * k // len(at)
            keep, parent, radius, child = [], [], [], []
            for j in range(k):
                own = at[nearest == j]
                if len(own):
                    keep.append(at[chosen[j]])
                    parent.append(far[chosen[j]])
                    radius.append(sqrt(to[nearest == j, j].max()))
                    child.append(page(own, points[at[chosen[j]]]))
            pages[mine] = (False, len(keep), _blob(whole[keep], np.int32), _blob(np.array(parent), float), _blob(np.array(radius), float), _blob(np.array(child), np.int32), b"", b"")
            return mine

        page(np.arange(len(points)), None)
        tree = int(part["tree"].iloc[0])
        return pd.DataFrame([(tree, i, *p) for i, p in enumerate(pages)], columns=["tree", "page", "leaf", "n", "vectors", "parent", "radius", "child", "ids", "sizes"])

    return run


class Forest:
    """The pages of some trees, for searches."""

    def __init__(self, pages: pd.DataFrame, size: int) -> None:
        self.pages, self.roots, self.products = {}, [], 0
        for r in pages.itertuples():
            load = lambda b, kind: np.frombuffer(b, kind)
            v = load(r.vectors, np.int32).reshape(r.n, size)
            if r.leaf:
                ends = np.cumsum(load(r.sizes, np.int32))
                self.pages[r.tree, r.page] = (True, v.astype(float), load(r.parent, float), np.split(load(r.ids, np.int64), ends[:-1]))
            else:
                self.pages[r.tree, r.page] = (False, v.astype(float), load(r.parent, float), (load(r.radius, float), load(r.child, np.int32)))
            if r.page == 0:
                self.roots.append((r.tree, 0))

    def best(self, queries: np.ndarray, base: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the k pairs (-score, id) first in order, of rows whose score is `least` or more. base: |q|² + M².

        The queries of a batch take a page together, the one with the lowest bound of any of them first, so one product of
        matrices serves them all; which entries each of them needs is its own bounds' matter.
        """
        exact, least = queries.astype(float), least.astype(float)
        margin = 1e-9 * (base + 1)
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        reach = lambda i: np.sqrt(np.maximum(base[i] - 2 * least[i], 0.0) + margin[i])
        everyone = np.arange(len(queries))
        far = reach(everyone)
        heap = [(0.0, i, root, everyone, np.zeros(len(queries)), None) for i, root in enumerate(self.roots)]
        made = len(heap)
        while heap:
            _, _, at, who, bounds, above = heapq.heappop(heap)
            near = bounds <= far[who]  # bounds may have fallen since the page was put in line
            if not near.any():
                continue
            who, above = who[near], None if above is None else above[near]
            leaf, vectors, parent, rest = self.pages[at]
            radius = 0.0 if leaf else rest[0]
            needed = np.ones((len(who), len(vectors)), bool) if above is None else np.abs(above[:, None] - parent) - radius <= far[who, None]
            rows, columns = np.flatnonzero(needed.any(1)), np.flatnonzero(needed.any(0))
            if not len(rows):
                continue
            who, needed = who[rows], needed[np.ix_(rows, columns)]
            scores = exact[who] @ vectors[columns].T  # whole numbers below 2^53 are exact; larger ones are taken again below
            self.products += scores.size
            if leaf:
                hit = needed & (scores >= (least[who] - margin[who])[:, None])
                for i in np.flatnonzero(hit.any(1)):
                    own = found[who[i]]
                    for j in columns[hit[i]]:
                        score = int(vectors[j].astype(np.int64) @ queries[who[i]])
                        own += [(-score, int(x)) for x in rest[j]]
                    own.sort()
                    del own[k:]
                    if len(own) == k:
                        least[who[i]] = max(least[who[i]], -own[-1][0])
                far[who] = reach(who)
                continue
            away = np.sqrt(np.maximum(base[who, None] - 2 * scores, 0.0))
            low = np.maximum(away - rest[0][columns], 0.0)
            needed &= low <= far[who, None]
            for j in np.flatnonzero(needed.any(0)):
                own = needed[:, j]
                heapq.heappush(heap, (low[own, j].min(), made, (at[0], int(rest[1][columns[j]])), who[own], low[own, j], away[own, j]))
                made += 1
        return found


def searched(size: int, most: float, k: int, sample: np.ndarray):  # noqa: ANN201
    """For a cogroup of pages and queries (q, v): the k best (q, score, vec_id) of the pages for each query. Scores of the
    sample's rows bound the search from the start."""

    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            forest, seen = Forest(pages, size), sample.T.astype(float)
            for start in range(0, len(queries), BATCH):
                part = queries.iloc[start : start + BATCH]
                v = _matrix(part["v"].tolist(), size)
                lengths = (v.astype(float) ** 2).sum(1)
                first = np.partition(v.astype(float) @ seen, -k, axis=1)[:, -k] if len(sample) >= k else np.full(len(v), -1e300)
                found = forest.best(v, lengths + most, k, first)
                out += [(int(q), -s, i) for q, own in zip(part["q"], found, strict=True) for s, i in own]
        return pd.DataFrame(out, columns=["q", "score", "vec_id"]).astype("int64")

    return run


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def index(rows: DataFrame) -> tuple[DataFrame, dict]:
    """The pages of all rows (vec_id, v), and what a search must know: components, M², number of different vectors, sample.

    Equal vectors are one entry with all that a search can return of them: see `keep` in nearest. Pivots and first bounds
    come from SAMPLE vectors of the smallest hashes; every row is indexed.
    """
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))).alias("most")).first()
    n, size, most = about["n"], about["size"] or 0, about["most"] or 0.0
    sample = _matrix([r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()], size)  # of bounded size
    pivots = _lifted(sample[:PIVOTS], most)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _lifted(_matrix(b["v"].tolist(), size), most)
            yield b.assign(pivot=(((pivots * pivots).sum(1) - 2 * m @ pivots.T).argmin(1) if len(b) else np.empty(0)).astype("int32"))

    dealt = written(rows.mapInPandas(nearest, "v array<int>, ids array<long>, pivot int"), "dealt")
    parts = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts"))  # a row a pivot
    first = parts.withColumn("first", F.coalesce(F.sum("parts").over(Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = dealt.join(F.broadcast(first), "pivot").select((F.col("first") + F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts"))).cast("int").alias("tree"), "v", "ids")
    pages = written(trees.groupBy("tree").applyInPandas(grown(size, most), PAGES), "pages")
    return pages, {"size": size, "most": most, "n": n, "sample": sample}


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k rows of the largest integer inner
    product but itself, ties to the smaller id; all others, if there are fewer.

    Which rows take part is said at scaled(); vectors of different lengths are filled with zeros; an empty table gives no
    rows. Queries and rows meet in blocks, tree group by tree group: each pair of a block and a group is one task of bounded
    size, and only the k + 1 best of each query leave it.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    keep = k + 1  # a query's own row may be among them
    one = _first(rows, ["v"], [F.asc("vec_id")], keep).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    one = written(one, "different")
    pages, about = index(one)
    asked = rows.where(F.col("vec_id") % every == 0)
    named = written(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "asked")
    blocks = max(1, ceil(named.count() / QUERIES))
    groups = max(ceil(about["n"] / ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(about["n"] / 512)), 1)
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    here = pages.withColumn("group", F.pmod("tree", F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    there = named.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    task = searched(about["size"], about["most"], keep, about["sample"])
    hits = here.groupBy("group", "block").cogroup(there.groupBy("group", "block")).applyInPandas(task, "q long, score long, vec_id long")
    best = _first(hits, ["q"], [F.desc("score"), F.asc("vec_id")], keep).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    # many queries may share a vector: its answer goes to each part of them
    best = best.join(named, "q").select("v", "hits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = asked.select("v", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(best, ["v", "salt"]).select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def search_query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)


def search_sql() -> str:
    """The same rows for DuckDB, by all products of queries and rows."""
    return """with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, r.vec_id, cast(list_dot_product(q.v, r.v) as bigint) as score from e q join e r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

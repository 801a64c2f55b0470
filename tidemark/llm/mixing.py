"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to. A min-cost flow routes the patterns'
words to the sources' quotas: a pattern can give its words once at no cost, a second time at a cost, and so on, so
repetition is spread where it is cheapest. Whole documents are then selected, in a seeded order, until each pattern has
given its share.

Only sums by pattern and by source reach the driver, one row a pattern whatever their number, so the flow is the least cost
at any size; beyond MOST_PATTERNS what it gives is joined by a shuffle instead of a broadcast. Prefix sums over the seeded order are taken in two levels, within slices of the hash range and over the slices, so no task holds a
whole source.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, text_of, written

#: Patterns up to which shares are broadcast; results do not depend on it.
MOST_PATTERNS = 100_000
#: Slices of the hash range in which prefix sums are taken.
SLICE_BITS = 12
#: Times the seeded order is walked; each walk fills what the one before left with documents that still fit.
WALKS = 4


def water_filled(sizes: dict[str, int], weights: dict[str, float], *, share: float, most: float) -> dict[str, float]:
    """Targets by weight that together are `share` of all sizes and each at most `most` times its own."""
    left, open_ = share * sum(sizes.values()), set(sizes)
    targets: dict[str, float] = {}
    while open_:
        total = sum(weights[s] for s in open_)
        given = {s: left * weights[s] / total for s in sorted(open_)}
        full = {s for s in open_ if given[s] > most * sizes[s]}
        if not full:
            return targets | given
        for s in sorted(full):
            targets[s] = most * sizes[s]
            left -= targets[s]
        open_ -= full
    return targets


def min_cost_flow(supply: list[list[tuple[int, int]]], members: list[list[int]], quotas: list[int]) -> list[dict[int, int]]:
    """What each pattern gives to each of its sources. supply: per pattern its (words, cost) tiers, costs rising.

    Successive shortest paths: each augments from the cheapest open tier, possibly by moving earlier flow of another
    pattern to another of its sources, until the quotas are full or nothing can be added. Sources from which no open quota
    can be reached stay so, as no later path leaves them; they are not searched again.
    """
    p, q = len(supply), len(quotas)
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    givers: list[set[int]] = [set() for _ in range(q)]
    left = quotas[:]
    closed: set[int] = set()
    for cost, i, words in sorted((cost, i, words) for i in range(p) for words, cost in supply[i]):
        while words > 0 and not closed.issuperset(members[i]):
            # breadth-first over patterns: i -> one of its sources -> a pattern that gives to it -> ...
            came: dict[int, tuple[int, int] | None] = {i: None}
            queue, end = deque([i]), None
            while queue and end is None:
                a = queue.popleft()
                for s in members[a]:
                    if left[s] > 0:
                        end = (a, s)
                        break
                    if s in closed:
                        continue
                    for b in givers[s]:
                        if b not in came:
                            came[b] = (a, s)
                            queue.append(b)
            if end is None:
                closed.update(s for a in came for s in members[a])
                break
            path, (a, s) = [end], end
            amount = min(words, left[s])
            while came[a] is not None:
                before, via = came[a]
                amount = min(amount, flow[a][via])
                path.append((before, via))
                a = before
            for k, (a, s) in enumerate(path):
                flow[a][s] += amount
                givers[s].add(a)
                if k + 1 < len(path):
                    via = path[k + 1][1]
                    flow[a][via] -= amount
                    if not flow[a][via]:
                        givers[via].discard(a)
            left[path[0][1]] -= amount
            words -= amount
    return flow


def tagged(source: Column) -> Column:
    """A source's name as a key that is never null; null sorts last and is apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _few(df: DataFrame, patterns: int) -> DataFrame:
    """A table of one row a pattern, broadcast where there are few."""
    return F.broadcast(df) if patterns <= MOST_PATTERNS else df


def _walk(rows: DataFrame, patterns: int) -> DataFrame:
    """`rows` (id, size, sources, whole, rest, h, chosen; so many patterns) with more of them chosen: those that fit, in the order of
    (h, id, size), as long as their running sum within their pattern is at most `rest`; and `rest` less that sum."""
    fits = ~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    rows = rows.withColumn("_w", F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long"))).withColumn("_slice", F.shiftrightunsigned("h", 64 - SLICE_BITS))
    rows = rows.repartition("sources", "_slice")  # else the sums and the window would be dealt by source alone
    sums = rows.groupBy("sources", "_slice").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy("sources").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sources", "_slice", F.coalesce(F.sum("_s").over(before), F.lit(0).cast("long")).alias("_before"))
    inside = Window.partitionBy("sources", "_slice").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("_w").over(inside)).join(sums, ["sources", "_slice"])
    rows = rows.withColumn("_now", (F.col("_w") > 0) & (F.col("_before") + F.col("_in") <= F.col("rest")))
    rows = written(rows.select("id", "size", "sources", "whole", "rest", "h", (F.col("chosen") | F.col("_now")).alias("chosen"), "_now"), "walk")
    taken = rows.where("_now").groupBy("sources").agg(F.sum("size").alias("_taken"))
    return rows.join(_few(taken, patterns), "sources", "left").withColumn("rest", F.col("rest") - F.coalesce("_taken", F.lit(0).cast("long"))).drop("_taken", "_now")


def mix(sized: DataFrame, *, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents with copies, sources).

    `sized`: id, size (0 or more) and sources (an array of keys from tagged()). The first result has these columns and
    `copies`, 0 to `most`; the second source, source_size and target. Sources in code point order take the weights in
    turn. The same table and seed give the same result; repeated rows are selected each; a document of size 0 is never
    counted. An empty table gives empty results.
    """
    spark = sized.sparkSession
    sized = written(sized.select("id", "size", F.array_sort(F.array_distinct("sources")).alias("sources")), "sized")
    sums = written(sized.groupBy("sources").agg(F.sum("size").alias("size")), "patterns")
    patterns = sorted(((tuple(r["sources"]), r["size"]) for r in sums.collect()), key=lambda x: x[0])  # one row a pattern
    names = sorted({s for p, _ in patterns for s in p})
    sizes = dict.fromkeys(names, 0)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    targets = water_filled(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share=share, most=most)
    place = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([[(n, k) for k in range(most)] for _, n in patterns], [[place[s] for s in p] for p, _ in patterns], [round(targets[s]) for s in names])
    given = [(list(p), n and sum(f.values()) // n, sum(f.values()) % n if n else 0) for (p, n), f in zip(patterns, flow, strict=True)]
    shares = spark.createDataFrame(given, "sources array<string>, whole int, rest long")  # one row a pattern
    rows = sized.join(_few(shares, len(patterns)), "sources").withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("chosen", F.lit(False))
    for _ in range(WALKS):
        rows = _walk(rows, len(patterns))
    copies = F.col("whole") + F.col("chosen").cast("int")
    sources = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in names], "source string, source_size long, target double")
    return rows.select("id", "size", "sources", F.least(copies, F.lit(most)).alias("copies")), sources


def sized_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size in words (null text: 0) and the document's one source."""
    words = F.size(F.array_remove(F.split(text_of(f"`{text_col}`"), SPACE_RUN), "")).cast("long")
    return docs.select(F.col(f"`{id_col}`").alias("id"), words.alias("size"), F.array(tagged(F.col(f"`{source_col}`"))).alias("sources"))


def mixing_query(docs: DataFrame) -> DataFrame:
    rows, sources = mix(sized_documents(docs.select("doc_id", "text", "source")))
    joined = rows.withColumn("source", F.get("sources", F.lit(0))).join(F.broadcast(sources), "source")  # one row per source
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:  # noqa: ANN003
    """`docs` with each row as often as the mix takes it, and all its columns, whatever their names.

    Rows that share an id, or have none, are taken alike. A null source is a source of its own, the last in order; null and
    empty texts have no words and are never taken; very long texts count whole. Which of the documents that fit are taken is
    a matter of the seed's hash, then the id, then the size, so reruns agree. An empty table gives no rows."""
    rows, _ = mix(sized_documents(docs, id_col=id_col, text_col=text_col, source_col=source_col), **options)
    copies = rows.groupBy("id").agg(F.max("copies").alias("_copies")).where("_copies > 0").withColumnRenamed("id", "_id")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_own"))
    joined = whole.join(copies, F.col("_own").eqNullSafe(F.col("_id")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Fingerprints of 64 bits within a radius of r bits agree in at least 8 - r of their 8 bytes. With single bytes as keys
the lists would hold a 256th of all rows, so the index keys are triples of positional bytes, chosen so that any
8 - r = 4 shared positions contain one of them: the 20 triples of a covering of all 4-subsets of the 8 positions.
Within a list, the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum are dropped, and
the rest are verified by their differing bits.

Equal fingerprints are combined first and count once. A list is searched from a frontier outwards, each fingerprint
leaving the list when it is reached, and yields one edge per fingerprint to its group's smallest, never all pairs; a
list of thousands of near copies costs little more than its length. Memory is 8 bytes per different fingerprint of one
list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .graph import components
from .simhash import fingerprinter, majority, runs, shingle_hashes, whole_groups, words_of

POSITIONS = 8
#: Fingerprints compared with the rest of a list at once.
FRONTIER = 64
#: Parts of a component when its id goes to its members.
SALTS = 32


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any 4 positions contain one: with the positions in three classes, triples
    inside a class and those with two positions in a class and one in the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [t for c in classes for t in combinations(c, 3)]
    triples += [(*pair, x) for i, c in enumerate(classes) for pair in combinations(c, 2) for x in classes[(i + 1) % 3]]
    return triples


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes are equal, from the exclusive-or of two fingerprints."""
    some = differing | (differing >> np.uint64(4))
    some |= some >> np.uint64(2)
    some |= some >> np.uint64(1)
    return POSITIONS - np.bitwise_count(some & np.uint64(0x0101010101010101))


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For every b, whether any a is within the radius. Shared bytes are tallied for all pairs; only those that reach the
    minimum which the radius guarantees, one byte less per differing bit, are verified bit by bit."""
    differing = a[:, None] ^ b[None, :]
    rows, cols = np.nonzero(shared_bytes(differing) >= POSITIONS - radius)
    near = np.zeros(len(b), bool)
    near[cols[np.bitwise_count(differing[rows, cols]) <= radius]] = True
    return near


def list_groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the different fingerprints of one list, the position of the first one in its group."""
    n = len(fps)
    label = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), bool)
            for i in range(0, len(frontier), FRONTIER):
                open_ = np.flatnonzero(~reached)
                if not len(open_):
                    break
                for j in range(0, len(open_), 1 << 15):
                    part = open_[j : j + (1 << 15)]
                    reached[part] |= linked(fps[frontier[i : i + FRONTIER]], fps[rest[part]], radius)
            frontier, rest = rest[reached], rest[~reached]
            label[frontier] = root
    return label


def _edges(radius: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "key"):
            keys, fps = frame["key"].to_numpy(), frame["fp"].to_numpy()
            bits = fps.view(np.uint64)
            starts, stops = runs(keys)
            sizes = stops - starts
            us, vs = [], []
            twos = starts[sizes == 2]  # most lists with any pair at all
            differing = bits[twos] ^ bits[twos + 1]
            twos = twos[(shared_bytes(differing) >= POSITIONS - radius) & (np.bitwise_count(differing) <= radius)]
            us.append(fps[twos + 1])
            vs.append(fps[twos])
            for a, b in zip(starts[sizes > 2], stops[sizes > 2], strict=True):
                first = list_groups(bits[a:b], radius)
                moved = np.flatnonzero(first != np.arange(b - a))
                us.append(fps[a:b][moved])
                vs.append(fps[a:b][first[moved]])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def near_edges(fingerprints: DataFrame, *, radius: int = 4) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within `radius` bits. `fingerprints`: different values fp, none
    null. A fingerprint without neighbours has no edge; an empty table gives none."""
    if not 0 <= radius <= 4:
        raise ValueError("the covering guarantees radii up to 4")
    fp = F.col("fp")
    keys = [
        F.lit(t << 24).bitwiseOR(F.shiftleft(_byte(fp, i), 16)).bitwiseOR(F.shiftleft(_byte(fp, j), 8)).bitwiseOR(_byte(fp, k))
        for t, (i, j, k) in enumerate(covering_triples())
    ]
    index = fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))
    return index.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_edges(radius), "u long, v long").distinct()


def simhash_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id) for every row of `docs`.

    A null or empty text, or one of white space, has fingerprint 0 and is linked like any other. The component's id is
    the smallest id of its documents, null ids left out. Repeated rows return each; an empty table gives no rows; texts of
    any length count whole. A bit that exactly half of the hashes set is 0.
    """
    k = shingle
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    schema = rows.select("id", F.lit(0).cast("long").alias("fp")).schema
    rows = written(rows.mapInPandas(fingerprinter(lambda t: majority(shingle_hashes(words_of(t), k)), ["id"], "text", "fp"), schema), "simhash")
    different = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(components(near_edges(different.select("fp"), radius=radius)), "roots")
    # only fingerprints of larger components have edges; the others are their own
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = different.join(members, "fp").withColumn("salt", F.pmod("fp", F.lit(SALTS)))
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    dealt = smallest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))  # a large component is joined in SALTS parts
    named = members.join(dealt, ["root", "salt"]).select("fp", "component_id")
    named = different.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup_query(docs: DataFrame) -> DataFrame:
    out = simhash_classes(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

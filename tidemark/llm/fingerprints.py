"""SimHash document fingerprints with permuted block tables.

The terms of a text are its pairs of neighbouring words; each different term's hash votes on 64 signed bits with a
weight that grows with the logarithm of its count. A radius of r bits is searched exactly: the 64 bits are cut into
r + 2 blocks, so two of them agree in any pair within the radius. There is one table for each choice of two blocks,
keyed by those blocks moved to the front; a list of a table is compared bit by bit, and a pair found in several tables
counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .simhash import runs, shingle_hashes, signed, weighted, whole_groups, words_of

#: Documents of one window when each looks for its successor, and the most windows; beyond, windows grow.
NEIGHBOURS, MOST_WINDOWS = 4096, 10_000


def text_fingerprint(text: str) -> int:
    """A text of one word votes with that word; one without words has fingerprint 0."""
    return weighted(shingle_hashes(words_of(text), 2))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the radius + 2 blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(fp: Column, radius: int) -> Column:
    """The fingerprint's key in every table: the table's number and its two blocks."""
    cut = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in blocks(radius)]
    return F.array(*(F.xxhash64(F.lit(t), cut[i], cut[j]) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))))


def _first_table(differing: np.ndarray, radius: int) -> np.ndarray:
    """The first table that holds a pair, by the blocks on which it agrees."""
    equal = np.stack([(differing >> np.uint64(low)) & np.uint64((1 << width) - 1) == 0 for low, width in blocks(radius)])
    first = np.full(differing.shape, 1 << 30)
    for t, (i, j) in reversed(list(enumerate(combinations(range(radius + 2), 2)))):
        first[equal[i] & equal[j]] = t
    return first


def _search(radius: int, pairs: bool):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "key"):
            keys, tables = frame["key"].to_numpy(), frame["table"].to_numpy()
            fps, n, asked = frame["fp"].to_numpy().view(np.uint64), frame["n"].to_numpy(), frame["asked"].to_numpy(bool)
            out: list[pd.DataFrame] = []
            starts, stops = runs(keys)
            has = np.add.reduceat(asked.astype(np.int64), starts) > 0
            for a, b in zip(starts[has], stops[has], strict=True):
                for q in np.array_split(a + np.flatnonzero(asked[a:b]), max(1, (b - a) * int(asked[a:b].sum()) >> 20)):
                    differing = fps[q][:, None] ^ fps[None, a:b]
                    rows, cols = np.nonzero(np.bitwise_count(differing) <= radius)
                    mine = _first_table(differing[rows, cols], radius) == tables[q[rows]]
                    mine &= tables[a + cols] == tables[q[rows]]
                    rows, cols = rows[mine], cols[mine]
                    if pairs:
                        out.append(pd.DataFrame({"query": fps[q[rows]].view(np.int64), "fp": fps[a + cols].view(np.int64), "distance": np.bitwise_count(differing[rows, cols]).astype(np.int32)}))
                    else:
                        out.append(pd.DataFrame({"query": fps[q].view(np.int64), "n": np.bincount(rows, weights=n[a + cols], minlength=len(q)).astype(np.int64)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _tables(fingerprints: DataFrame, radius: int) -> DataFrame:
    rows = fingerprints.select("fp", "n", "asked", F.posexplode(block_keys(F.col("fp"), radius)).alias("table", "key"))
    return rows.repartition("key").sortWithinPartitions("key", "table", "fp")


def find_within(fingerprints: DataFrame, *, radius: int = 3) -> DataFrame:
    """(query, fp, distance): for every fingerprint with `asked`, all fingerprints within `radius` bits, itself included.

    `fingerprints`: different values fp, with n (documents that have it) and asked.
    """
    return _tables(fingerprints, radius).mapInPandas(_search(radius, True), "query long, fp long, distance int")


def count_within(fingerprints: DataFrame, *, radius: int = 3) -> DataFrame:
    """(query, n): as find_within, but only the number of documents, so a dense list yields one row per query."""
    found = _tables(fingerprints, radius).mapInPandas(_search(radius, False), "query long, n long")
    return found.groupBy("query").agg(F.sum("n").alias("n"))


def id_bounds(docs: DataFrame, id_col: str = "doc_id") -> tuple[int, list[int]]:
    """(shift, bounds): least values of id >> shift of windows of some NEIGHBOURS rows each, at most MOST_WINDOWS, by an
    approximate percentile of bounded size. All are values of rows, so no window is empty; no bounds where no row has an
    id. Percentiles are doubles, so wide ids are shifted to fit."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id IS NOT NULL")
    row = ids.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if not row["n"]:
        return 0, []
    shift = 11 if max(abs(row["low"]), abs(row["high"])) >> 53 else 0
    n = max(1, min(MOST_WINDOWS, row["n"] // NEIGHBOURS))
    at = ids.agg(F.percentile_approx(F.shiftright("id", shift), [i / n for i in range(n)], 10 * n).alias("at")).first()["at"]
    return shift, sorted({row["low"] >> shift, *at})


def fingerprint_documents(docs: DataFrame, bounds: tuple[int, list[int]] = (0, []), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, packed, window) per row, the text packed with zstd for the shuffle that follows, and the number of the
    window by `bounds` (the last number for a null id). Null texts count as empty, fingerprint 0. Equal texts have equal
    fingerprints; repeated rows give each."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    shift, least = bounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        edges = np.array(least, np.int64)
        for batch in batches:
            fps = signed([text_fingerprint(t) for t in batch["text"]])
            windows = [len(edges) if pd.isna(i) else int(np.searchsorted(edges, int(i) >> shift, "right")) - 1 for i in batch["id"]]
            yield pd.DataFrame({"id": batch["id"], "fp": fps, "packed": [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]], "window": windows})

    return rows.mapInPandas(run, rows.select("id", F.lit(0).cast("long").alias("fp"), F.lit(b"").alias("packed"), F.lit(0).cast("long").alias("window")).schema)


def edit_documents(rows: DataFrame) -> DataFrame:
    """From rows with their successors: id, n_chars, fp, next_fp, and the edited text's SHA-256 and fingerprint. In an
    edited text, the last quarter of the code points (rounded down) gives way to as many first ones of the next text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        text = lambda blob: unpacker.decompress(blob).decode("utf-8", "surrogatepass")
        for batch in batches:
            n_chars, digests, fps = [], [], []
            for own, following in zip(batch["packed"], batch["next_packed"], strict=True):
                t = text(own)
                part = len(t) // 4
                edited = t[: len(t) - part] + text(following)[:part]
                n_chars.append(len(t))
                digests.append(sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                fps.append(text_fingerprint(edited))
            yield batch[["id", "fp", "next_fp"]].assign(n_chars=n_chars, edited_sha256=digests, edited_fp=signed(fps))

    kept = rows.select("id", "fp", "next_fp", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"), F.lit(0).cast("long").alias("edited_fp"))
    return rows.mapInPandas(run, kept.schema)


def with_successor(rows: DataFrame, windows: int) -> DataFrame:
    """`rows` (id, fp, packed, window) with next_packed and next_fp of the following row by id; after the last, of the first.
    windows: the number of windows with ids, none of them empty; rows without an id are in the one after.

    Equal ids follow each other by their packed texts; null ids come last. Only the first and last rows of windows meet
    again, a last one under the window that follows its own.
    """
    order = Window.partitionBy("window").orderBy(F.asc("id"), F.asc("packed"))
    rows = rows.withColumn("next", F.lead(F.struct("packed", "fp")).over(order)).withColumn("_before", F.lag(F.lit(1)).over(order))
    edges = rows.where("next IS NULL OR _before IS NULL")
    # both the rows without an id, if any, and the first window follow the last one with ids: the nearest that exists counts
    follows = F.when(F.col("window") < windows - 1, F.array(F.col("window") + 1)).when(F.col("window") == windows - 1, F.array(F.lit(windows).cast("long"), F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(windows).cast("long")))
    first = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("window").alias("key"), F.lit(0).alias("last"), F.lit(0).alias("turn"))))
    last = F.when(F.col("next").isNull(), F.transform(follows, lambda k, i: F.struct(k.alias("key"), F.lit(1).alias("last"), i.alias("turn"))))
    met = edges.select("id", "fp", "packed", "window", F.explode(F.flatten(F.array_compact(F.array(first, last)))).alias("e"))
    at_key = Window.partitionBy("e.key").orderBy("e.last").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumn("next", F.first(F.when(F.col("e.last") == 0, F.struct("packed", "fp")), ignorenulls=True).over(at_key)).where("e.last = 1 AND next IS NOT NULL")
    met = met.groupBy("window").agg(F.min_by(F.struct("id", "fp", "packed", "next"), F.col("e.turn")).alias("r")).select("r.*")
    joined = rows.where("next IS NOT NULL").select("id", "fp", "packed", "next").union(met)
    return joined.select("id", "fp", "packed", F.col("next.packed").alias("next_packed"), F.col("next.fp").alias("next_fp"))


def fingerprint_query(docs: DataFrame, *, radius: int = 3) -> DataFrame:
    """op10, with n_within: for ids divisible by 50, how many documents (itself included) lie within `radius` bits.

    A null text is empty, fingerprint 0; a null id comes last and is not searched for; repeated rows give each; an empty
    table gives no rows.
    """
    bounds = id_bounds(docs.select("doc_id"))
    rows = edit_documents(with_successor(fingerprint_documents(docs.select("doc_id", "text"), bounds), len(bounds[1])))
    rows = written(rows.withColumnRenamed("id", "doc_id"), "fingerprints")
    different = rows.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))).alias("asked"))
    within = count_within(different, radius=radius).select(F.col("query").alias("fp"), F.col("n").alias("_within"))
    rows = rows.join(within, "fp", "left")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("_within")).alias("n_within"),
    )

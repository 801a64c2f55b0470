"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Documents are read in blocks, each with its own list of distinct words and, per document, the words' places in that
list. The words of all blocks are shuffled so that each distinct word of the table meets itself, and a fold over its
byte array merges the pieces of lowest rank, turn by turn, looking ranks up in a literal map. The ids go back to the
blocks, where the ids of a document are put together from its words, and its bytes from the binary pieces of the ids.

Only the distinct words of blocks, packed, and their ids are shuffled; a word has one place per block at most, so no key
is hot. Blocks have a bounded number of characters. They are written once, in buckets, so that a lost executor never
renumbers them and the documents' places need no shuffle.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import text_of, written

#: Characters of a block and of one row of its documents; a longer text is a row of its own.
BLOCK_CHARS, ROW_CHARS = 24 << 20, 1 << 18
#: Longer words are cut where no token reaches across, and their folds merge all places of a rank in one turn.
LONG = 64
#: Bits of an id in the rank map.
ID_BITS = 20
#: Lists in the rank map, a prime.
LISTS = 65521
MANY = 1 << 30
#: Tasks that the words are dealt to: for few partitions of input as many, for many a share of them, so a block's words are
#: not cut too small.
FEW_DEALT, DEALT_SHARE = 1024, 16
REF = np.dtype([("block", "<i8"), ("at", "<i4")])
#: Words of blocks that are gathered by word at once.
MOST_REFS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id, the last merge of every token of two bytes and more.

    In a trained vocabulary a token is made by merges of lower ranks and then its own, so whatever stands around its
    bytes, no other two pieces ever make it. That is proven here, token by token; other vocabularies are refused.
    """
    pairs = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            open_ = [(r, i) for i, (a, b) in enumerate(pairwise(parts)) if (r := ranks.get(a + b, rank)) < rank]
            if not open_:
                break
            i = min(open_)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) > 2:
            raise ValueError(f"token {rank} is not made by merges of lower ranks")
        if len(parts) == 2:
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return pairs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    """A rank table for Spark's functions: pieces are ids, a word is the array of the ids of its bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >> ID_BITS or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"ids need {ID_BITS} bits at most, and every byte one of its own")
        lists: list[list[int] | None] = [None] * LISTS
        for (a, b), rank in merges_of(ranks).items():
            above, at = divmod(a << ID_BITS | b, LISTS)
            lists[at] = [*(lists[at] or []), above << ID_BITS | rank]
        self.literal = json.dumps(lists)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for token in ranks:
            for a, b in pairwise(token):
                self.joined[a, b] = True

    def rank(self, lists: Column, a: Column, b: Column) -> Column:
        """The id that two pieces make together, null if none. The map has a list for each remainder of the pieces' key, of the
        rest of the key and the id as one number."""
        key = F.shiftleft(a, ID_BITS).bitwiseOR(b)
        above = F.floor(key / LISTS)
        found = F.filter(F.get(lists, (key % LISTS).cast("int")), lambda x: F.shiftright(x, ID_BITS) == above)
        return F.get(found, F.lit(0)).bitwiseAND(F.lit((1 << ID_BITS) - 1))

    def encode(self, word: Column) -> Column:
        """Token ids (array of bigint) of a binary word: a fold over its byte array. The rank map is a literal, named outside of
        all else: plans are written out again and again, and each expression around a literal copies its text of 1 MB."""
        return let(F.from_json(F.lit(self.literal), "array<array<bigint>>"), lambda lists: self._folded(word, lists))

    def _folded(self, word: Column, lists: Column) -> Column:
        digits = lambda i: F.conv(F.hex(F.substring(word, i + 1, F.lit(1))), 16, 10).cast("int")
        ids = F.array(*(F.lit(i).cast("bigint") for i in self.byte_ids))
        start = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.get(ids, digits(i)))

        def one_place(p: Column, r: Column, least: Column) -> Column:
            """The leftmost pair of the least rank becomes one piece."""
            at = F.array_position(r, least).cast("int")
            return F.concat(F.slice(p, 1, at - 1), F.array(least), F.slice(p, at + 2, MANY))

        def all_places(p: Column, r: Column, least: Column) -> Column:
            """All pairs of the least rank, from the left; in a run of equal pieces every second pair is free."""
            marks = F.array_join(F.transform(r, lambda x: F.when(x.eqNullSafe(least), "1").otherwise("0")), "")
            marks = F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")
            merged = lambda marks: F.transform(p, lambda x, i: F.when(F.get(marks, i) == "1", least).when(F.get(marks, i - 1) == "1", -1).otherwise(x))
            return F.filter(let(marks, merged), lambda x: x >= 0)

        size = F.octet_length(word)

        def turn(s: Column) -> Column:
            """The ranks are looked up in one place for short and long words, so a plan holds the map once."""
            p = s["p"]
            ranks = F.zip_with(p, F.slice(p, 2, MANY), lambda a, b: self.rank(lists, a, b))
            merge = lambda r, least: F.when(size <= LONG, one_place(p, r, least)).otherwise(all_places(p, r, least))
            after = lambda r: let(F.array_min(r), lambda least: F.struct(F.when(least.isNull(), p).otherwise(merge(r, least)).alias("p"), least.isNull().alias("done")))
            return F.when(s["done"], s).otherwise(let(ranks, after))

        # a word of n bytes has n - 1 merges at most; turns after the last one change nothing
        begin = F.struct(start.alias("p"), F.lit(False).alias("done"))
        folded = F.aggregate(F.sequence(F.lit(2), size), begin, lambda s, _: turn(s))["p"]
        return F.when(size == 0, F.array().cast("array<bigint>")).when(size == 1, start).otherwise(folded)

    def decode(self, ids: Column) -> Column:
        """The bytes of token ids: their binary pieces, concatenated."""
        pieces = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in self.pieces])), "array<binary>")
        return F.aggregate(ids, F.lit(b""), lambda a, i: F.concat(a, F.get(pieces, i.cast("int"))))

    def cut(self, word: str) -> list[bytes]:
        """A word in parts such that no token of the vocabulary reaches across their ends."""
        raw = word.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1
        return [raw[i:j] for i, j in pairwise([0, *ends.tolist(), len(raw)])]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def _packed_words(words: list[bytes], at: np.ndarray) -> bytes:
    sizes = np.array([len(w) for w in words], np.int32)
    return zstandard.compress(np.array([len(words)], np.int32).tobytes() + at.astype(np.int32).tobytes() + sizes.tobytes() + b"".join(words), 3)


def word_blocks(pattern: str, shared, parts: int, schema: pa.Schema):  # noqa: ANN001, ANN201
    """For mapInArrow over (id, text): rows of documents (block, ids, ends, places) and of words (block, part, words).

    shared: a broadcast of the vocabulary. places: of the documents' words in the block's list; ends: where a document's
    places end. words: those of one part of all words, packed with their places."""

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cut = regex.compile(pattern).findall, shared.value.cut
        place: dict[str | bytes, int] = {}
        held: dict[str, list] = {"ids": [], "index": []}
        block = [random.SystemRandom().getrandbits(62)]
        chars, total = 0, 0

        def documents() -> Iterator[pa.RecordBatch]:
            if held["ids"]:
                ends = np.cumsum([len(x) for x in held["index"]], dtype=np.int64)
                places = np.concatenate(held["index"])
                planes = places.view(np.uint8).reshape(-1, 4).T  # the bytes of equal weight together pack better
                yield rows_of([(block[0], None, held["ids"][:], ends.tobytes(), zstandard.compress(planes.tobytes(), 3), None)])
                held["ids"].clear()
                held["index"].clear()

        def words() -> Iterator[pa.RecordBatch]:
            listed = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in place]
            of = np.fromiter((zlib.crc32(w) % parts for w in listed), np.int32, len(listed))
            order = np.argsort(of, kind="stable")
            cuts = list(pairwise(np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True]))) if len(order) else []
            for k in range(0, len(cuts), 256):
                yield rows_of([(block[0], int(of[order[a]]), None, None, None, _packed_words([listed[i] for i in order[a:b]], order[a:b])) for a, b in cuts[k : k + 256]])
            place.clear()
            block[0] = random.SystemRandom().getrandbits(62)

        for batch in batches:
            for key, text in (pair for i in range(0, batch.num_rows, 256) for pair in zip(*(batch.column(k).slice(i, 256).to_pylist() for k in (0, 1)), strict=True)):
                found = find(text)
                if max(map(len, found), default=0) > LONG:
                    found = [p for w in found for p in (cut(w) if len(w) > LONG else (w,))]
                held["ids"].append(key)
                held["index"].append(np.array([place.setdefault(w, len(place)) for w in found], np.int32))
                chars, total = chars + len(text), total + len(text)
                if chars >= ROW_CHARS:
                    yield from documents()
                    chars = 0
                if total >= BLOCK_CHARS:
                    yield from documents()
                    yield from words()
                    chars = total = 0
        yield from documents()
        yield from words()

    return run


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (part, block, words) sorted by part: rows (word, refs), the places where a word stands as REF
    records. A part with more than MOST_REFS places is handed on in portions; its words are then folded in each."""
    held: list[bytes] = []
    refs: list[np.ndarray] = []

    def handed() -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        group = np.array([known.setdefault(w, len(known)) for w in held], np.int64)
        places = np.concatenate(refs)[np.argsort(group, kind="stable")].tobytes()
        ends = np.r_[0, np.cumsum(np.bincount(group))] * REF.itemsize
        words = list(known)
        for i in range(0, len(words), 10_000):
            offsets = ends[i : i + 10_001]
            own = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(places[offsets[0] : offsets[-1]])])
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 10_000], pa.binary()), own], names=["word", "refs"])
        held.clear()
        refs.clear()

    current = None
    for batch in batches:
        for part, block, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (part != current or len(held) > MOST_REFS):
                yield from handed()
            current = part
            raw = zstandard.decompress(packed)
            n = int(np.frombuffer(raw, np.int32, 1)[0])
            own = np.empty(n, REF)
            own["block"], own["at"] = block, np.frombuffer(raw, np.int32, n, 4)
            ends = np.cumsum(np.frombuffer(raw, np.int32, n, 4 + 4 * n)) + 4 + 8 * n
            refs.append(own)
            held += [raw[i:j] for i, j in pairwise([4 + 8 * n, *ends.tolist()])]
    if held:
        yield from handed()


def packed_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (refs, ids): a row (block, tokens) per block and batch, packed."""
    for batch in batches:
        refs, ids = batch.column(0).to_pylist(), batch.column(1)
        offsets, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy().astype(np.int32)
        row = np.repeat(np.arange(len(refs)), [len(r) // REF.itemsize for r in refs])
        rows = np.frombuffer(b"".join(refs), REF)
        order = np.lexsort((rows["at"], rows["block"]))
        rows, starts, sizes = rows[order], (offsets[:-1] - offsets[0])[row[order]], np.diff(offsets).astype(np.int32)[row[order]]
        out = []
        for a, b in pairwise(np.flatnonzero(np.r_[True, np.diff(rows["block"]) != 0, True])) if len(rows) else ():
            n = sizes[a:b]
            where = np.repeat(starts[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            out.append((int(rows["block"][a]), zstandard.compress(np.array([b - a], np.int32).tobytes() + rows["at"][a:b].tobytes() + n.tobytes() + flat[where].tobytes(), 3)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["block", "tokens"])


def documents_of_block(shared, schema: pa.Schema, digests: bool):  # noqa: ANN001, ANN201
    """For a cogroup by block of documents (ids, ends, places) and tokens: the documents' ids and bytes, or digests of both."""

    def run(documents: pa.Table, tokens: pa.Table) -> pa.Table:
        pieces = shared.value.pieces
        names = [str(i).encode() for i in range(len(pieces))]
        found = [zstandard.decompress(p) for p in tokens.column("tokens").to_pylist()]
        heads = [int(np.frombuffer(f, np.int32, 1)[0]) for f in found]
        total = sum(heads)
        listed: list = [None] * total
        raw, sizes = [b""] * total, np.zeros(total, np.int64)
        for f, n in zip(found, heads, strict=True):
            at, count = np.frombuffer(f, np.int32, n, 4), np.frombuffer(f, np.int32, n, 4 + 4 * n)
            sizes[at] = count
            own = np.frombuffer(f, np.int32, -1, 4 + 8 * n).tolist()
            ends = np.cumsum(count).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends[:-1]], ends, strict=True):
                ids = own[a:b]
                listed[i] = b",".join([names[k] for k in ids]) if digests else ids
                raw[i] = b"".join([pieces[k] for k in ids])
        tables = []
        for r in range(documents.num_rows):
            col = lambda name: documents.column(name)[r].as_py()  # noqa: B023, E731
            planes = np.frombuffer(zstandard.decompress(col("places")), np.uint8)
            places = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
            out: list[tuple] = []
            for a, b in pairwise([0, *np.frombuffer(col("ends"), np.int64).tolist()]):
                own = places[a:b]
                at = own.tolist()
                decoded = b"".join(map(raw.__getitem__, at))
                if digests:
                    joined = b",".join(map(listed.__getitem__, at))
                    out.append((int(sizes[own].sum()), sha256(joined).hexdigest(), sha256(decoded).hexdigest()))
                else:
                    out.append(([k for i in at for k in listed[i]], decoded))
            ids = pa.array(col("ids"), schema.field(0).type)
            tables.append(pa.Table.from_arrays([ids, *(pa.array([x[k] for x in out], schema.field(k + 1).type) for k in range(len(schema) - 1))], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def encoded(docs: DataFrame, own: Vocabulary, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id_col, ids, decoded) for every row of `docs`: the token ids of the text, each match of `pattern` encoded by itself,
    and the bytes that the ids decode to. With `digests` (id_col, n_tokens, ids_sha256, decoded_sha256) instead.

    A null text counts as empty: no tokens. Repeated rows give each, null ids stay null, an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType
    shared = spark.sparkContext.broadcast(own)  # of the vocabulary's size
    parts = rows.rdd.getNumPartitions()
    tasks = max(2 * spark.sparkContext.defaultParallelism, parts // 4)
    rows = rows.coalesce(tasks)  # the more text a block has, the fewer words are sent twice
    dealt = min(max(tasks, parts), max(FEW_DEALT, parts // DEALT_SHARE))  # a given number, as few bytes of packed words are much work
    listed = [("block", T.LongType()), ("part", T.IntegerType()), ("ids", T.ArrayType(kind)), ("ends", T.BinaryType()), ("places", T.BinaryType()), ("words", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in listed])
    blocks = written(rows.mapInArrow(word_blocks(pattern, shared, 4 * dealt, to_arrow_schema(schema)), schema), "blocks", bucket_by="block", buckets=2 * tasks)
    words = blocks.where("part IS NOT NULL").select("part", "block", "words").repartition(dealt, "part").sortWithinPartitions("part")
    words = words.mapInArrow(distinct_words, "word binary, refs binary")
    tokens = words.select("refs", own.encode(F.col("word")).alias("ids")).mapInArrow(packed_tokens, "block long, tokens binary")
    documents = blocks.where("part IS NULL").select("block", "ids", "ends", "places")
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, t) for n, t in fields)])
    return documents.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(documents_of_block(shared, to_arrow_schema(out), digests), out)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`; nulls, repeats and empty tables as encoded()."""
    return encoded(docs, vocabulary(ranks_path), pattern, id_col=id_col, text_col=text_col, digests=True)


def bpe_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

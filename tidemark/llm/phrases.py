"""Phrase collocations: bounded suffix automata of blocks of words, counts added up, scores by the weakest cut.

Each task turns its texts into word ids and, block by block and language by language, into the generalised suffix
automaton of the block's pieces, bounded to short depth: its states are the classes of substrings that end at the same
places. A state stands for the lengths above its suffix link's, each as frequent as its end places are many, so every
distinct substring of a block leaves the task once, with its count. The states come from sorting the reversed contexts,
depth by depth, instead of from one word after the other; nothing walks the automaton's transitions, so none are kept.

Phrases of three words are counted in a second pass, only where both of their pairs are frequent. The frequent pairs
reach the tasks as a Bloom filter of bounded size: a pair taken for frequent by mistake costs a row and changes nothing, as
the sums decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes that end a piece, and how a text is brought to lower-cased words between spaces and line feeds.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(ENDS))
#: Words of a block, and rows that leave it at once.
BLOCK, ROWS = 1_000_000, 100_000
#: Bits of the filter: for each frequent pair, and at most (32 MB); beyond, more pairs pass by mistake.
BITS_EACH, MOST_BITS = 16, 1 << 28
SALTS = 32
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # any two odd numbers


def suffix_states(words: np.ndarray, depth: int, passes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(end, shortest, longest, count, link) of the states of the bounded generalised suffix automaton of `words`, ids from
    1 with a 0 after each piece. `end` is the place of the last word of one of a state's strings, `count` that of its end places, `link` the
    state of its longest suffix that ends at more places, -1 for the empty one.

    passes: whether the pair that ends at a place is of interest; others, and what is longer and holds one, are left out.
    """
    width = np.int64(words.max(initial=0) + 1)
    ends = np.flatnonzero(words)
    n = np.bincount(words[ends], minlength=width)[1:]
    some, last = np.flatnonzero(n), np.empty(width, np.int64)
    last[words[ends]] = ends
    node = (np.cumsum(n > 0) - 1)[words[ends] - 1]  # a word's place among those that occur
    levels = [(last[some + 1], n[some], np.full(len(some), -1))]
    for d in range(2, depth + 1):
        before = np.where(ends >= d - 1, words[ends - (d - 1)], 0)
        alive = before > 0
        if passes is not None:
            alive &= passes[ends - (d - 2)]
        ends, under, before = ends[alive], node[alive], before[alive]
        _, first, node, n = np.unique(under * width + before, return_index=True, return_inverse=True, return_counts=True)
        levels.append((ends[first], n, under[first]))
    made, owner, total = [], np.empty(0, np.int64), 0
    shortest: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for d in range(depth, 0, -1):
        end, n, _ = levels[d - 1]
        own = np.full(len(end), -1, np.int64)
        if d < depth:
            _, longer, link = levels[d]
            same = longer == n[link]  # ends at the same places as its only extension to the left
            own[link[same]] = owner[same]
        new = own < 0
        own[new] = total + np.arange(new.sum())
        total += int(new.sum())
        made.append((end[new], np.full(int(new.sum()), d), n[new]))
        owners.append(own)
        owner = own
    end, longest, n = (np.concatenate(x) for x in zip(*made, strict=True))
    shortest, link = longest.copy(), np.full(total, -1, np.int64)
    for d in range(depth, 0, -1):
        own = owners[depth - d]
        shortest[own] = d
        link[own] = owners[depth - d + 1][levels[d - 1][2]] if d > 1 else -1
    return end, shortest, longest, n, link


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _bits(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of pairs by their words' hashes."""
    mixed = first * ODD[0] + (second ^ (second >> np.uint64(29))) * ODD[1]
    other = (mixed ^ (mixed >> np.uint64(31))) * ODD[0]
    return mixed >> np.uint64(65 - size.bit_length()), other >> np.uint64(65 - size.bit_length())


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def counted(lengths: tuple[int, ...], shared=None):  # noqa: ANN001, ANN201
    """For mapInArrow over lang and text (binary): rows (lang, phrase, size, n) of the distinct substrings of each block that
    have one of the lengths; with length 1 also (lang, empty, 0, words of the block). shared: a broadcast filter of pairs."""
    depth = max(lengths)

    def counts(lang: str, words: np.ndarray, vocab: list[bytes]) -> Iterator[pa.RecordBatch]:
        passes = None
        if shared is not None:
            bits = shared.value
            h = _hashes(lang, vocab)
            one, two = _bits(h[np.roll(words, 1)], h[words], 64 * len(bits))
            passes = _has(bits, one) & _has(bits, two)  # of places without a pair it may say anything
        end, shortest, longest, n, _ = suffix_states(words, depth, passes)
        texts = pa.array(vocab, pa.binary())
        if 1 in lengths:
            yield made(lang, pa.array([b""], pa.binary()), 0, np.array([np.count_nonzero(words)]))
        for size in lengths:
            has = np.flatnonzero((shortest <= size) & (size <= longest))
            for i in range(0, len(has), ROWS):
                at = has[i : i + ROWS]
                parts = [texts.take(pa.array(words[end[at] - k])) for k in reversed(range(size))]
                yield made(lang, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if size > 1 else parts[0], size, n[at])

    def made(lang: str, phrases: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.binary()), pa.array(np.full(len(phrases), size, np.int32)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        vocab, words = None, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            known = list(vocab)
            for lang, parts in held.items():
                yield from counts(lang, np.concatenate(parts), known)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if vocab is None:
                    vocab = defaultdict(count().__next__)
                    vocab[b"\n"]  # 0 ends a piece
                tokens = text.as_py().translate(TABLE).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(vocab.__getitem__, filter(None, tokens)), np.int64)
                held[lang.as_py()] += [ids, np.zeros(1, np.int64)]
                words += len(ids)
                if words >= BLOCK:
                    yield from flushed()
                    held, vocab, words = defaultdict(list), None, 0
        if vocab is not None:
            yield from flushed()

    return run


def _summed(rows: DataFrame, run, least: int) -> DataFrame:  # noqa: ANN001
    """(lang, phrase, size, n) added up over all blocks; the words of a language have size 0, rarer phrases go."""
    found = rows.mapInArrow(run, "lang string, phrase binary, size int, n long")
    sums = found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("n").alias("n"))
    return sums.where((F.col("size") == 0) | (F.col("n") >= least))


def pair_filter(pairs: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of `pairs` (lang, phrase of two words), of a bounded number of 64-bit words: bits are set in the
    tasks and joined by Spark, and only the filter reaches the driver."""
    size = 1 << 16
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            of: dict[str, list[list[bytes]]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of[lang].append(phrase.split(b" "))
            for lang, split in of.items():
                first, second = _hashes(lang, [p[0] for p in split]), _hashes(lang, [p[1] for p in split])
                for at in _bits(first, second, size):
                    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = pairs.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def weakest_cut(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """`candidates` (lang, phrase, size, a) with l, r and score floor(1000000 a a / (l r)) of the cut with the lowest score,
    after the fewest words among equals. counts: (lang, phrase, n) of all their parts. Decimals keep the arithmetic exact
    up to 10^15 occurrences."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.select("lang", "phrase", "size", "a", "l", "r", "k").withColumns({c: _wide(c) for c in ("a", "l", "r")})
    cuts = cuts.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (a * a) div (l * r)"))
    best = cuts.groupBy("lang", "phrase", "size").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("_c"))
    return best.select("lang", "phrase", "size", *(F.col(f"_c.{c}").cast("long").alias(c) for c in ("a", "l", "r", "score")))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase of two or three words that occurs `least` times in its
    language, unless it lies in a longer such phrase with at least `inside` per cent of its occurrences.

    A null language is `und`, a null or empty text has no words; repeated rows count each; an empty table gives no rows.
    Texts of any length are whole; a task holds the words of one text and one block. Ties need no rule here, as all rows are
    returned; a phrase's cut with the lowest score is the one after the fewest words among equals.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    short = written(_summed(rows, counted((1, 2)), least), "phrases")
    pairs = short.where("size = 2")
    shared = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs, pairs.count()))  # of bounded size
    triples = written(_summed(rows, counted((3,), shared), least), "triples")
    candidates = pairs.unionByName(triples).withColumnRenamed("n", "a")
    best = weakest_cut(candidates, short.where("size > 0").select("lang", "phrase", "n"))
    # a pair lies in a triple as what its suffix link drops a word to, or as its beginning
    parts = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    held = triples.select("lang", F.explode(parts).alias("phrase"), F.lit(2).alias("size"), "n").groupBy("lang", "phrase", "size").agg(F.max("n").alias("_longer"))
    best = best.join(held, ["lang", "phrase", "size"], "left").where(F.coalesce(100 * F.col("_longer") < inside * F.col("a"), F.lit(True)))
    words = short.where("size = 0").select("lang", "n")  # one row a language
    return best.join(words, "lang").select("lang", "phrase", "size", "a", "l", "r", "n", "score")


def top_phrases(found: DataFrame, first: int) -> DataFrame:
    """Each language's `first` phrases by score, then a, both descending, then phrase, with their rank. Parts of a language
    are cut to as many first, so no task holds a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)
    return salted.drop("_salt")


def phrases_query(docs: DataFrame) -> DataFrame:
    found = top_phrases(collocations(docs), 2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases_sql() -> str:
    """The same rows for DuckDB."""
    return r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from w, range(1, 4) t(size)),
f as materialized (select lang, size, phrase, count(*) as n from g group by all),
c as (select lang, size, phrase, n as a, unnest(range(1, size)) as k, string_split(phrase, ' ') as w from f where size > 1 and n >= 10),
s as (select c.lang, c.phrase, c.size, a, k, x.n as l, y.n as r, cast(1000000 * cast(a as hugeint) * a // (cast(x.n as hugeint) * y.n) as bigint) as score from c
 join f x on x.lang = c.lang and x.size = k and x.phrase = array_to_string(w[1:k], ' ') join f y on y.lang = c.lang and y.size = c.size - k and y.phrase = array_to_string(w[k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
h as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, n from (select lang, n, string_split(phrase, ' ') as w from f where size = 3 and n >= 10)),
t as (select lang, sum(n) as n from f where size = 1 group by lang)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score from b join t using (lang)
 where not exists (select 1 from h where b.size = 2 and h.lang = b.lang and h.phrase = b.phrase and 100 * h.n >= 50 * a)) where rank <= 2000"""

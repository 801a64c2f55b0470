"""Removing repeated passages with suffix arrays.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller id. Every 50-byte
window is dealt by its anchor, the 8 bytes in it with the smallest hash, so equal windows meet in one bucket; the
neighbouring windows of one anchor travel together as one context. In a bucket, contexts that share enough bytes
beside the anchor with another document are joined to one string, its suffix array is built by two-stage sorting
(sort the suffixes smaller than their successors, induce the rest by scanning the buckets of first bytes), and
adjacent suffixes with 50 common bytes show which windows repeat.

Equal contexts are combined before the shuffle and again in the bucket: only the one of the smallest document travels
on, the others are known to repeat it, so a passage of very many documents is one context per block of input. Hashes only
bring equal contexts and candidates together, and equal bytes have equal hashes; bytes decide. Rows between the steps
are packed blocks.

An anchor that would fill a bucket is dealt by more bytes: its windows are parted by the anchor's offset in them, and those of
one part go by all bytes that they have in common, 29 of them, then 40, then the window itself. Which anchors are that common
is counted beforehand in some of the documents, once for all tasks; it decides where windows meet, not which are found. A
bucket that is large all the same is parted in that way where it is searched, so memory is bounded by a portion.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW, ANCHOR = 50, 8
SPAN = WINDOW - ANCHOR + 1
#: One side of the anchor has this many bytes of any shared window.
SIDE = (WINDOW - ANCHOR) // 2
#: Bytes of input for one block, one bucket and one part of the results; they set the number of each.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 1 << 21, 2 << 20, 12 << 20
#: Bytes of contexts that are compared at once.
COMPARED = 1 << 20
#: Bytes of contexts that are hashed, and that are sorted at once.
HASHED, PORTION = 1 << 19, 3 << 20
#: Offsets of the anchor that a part of its windows has, by level; their windows share WINDOW + 1 less so many bytes.
WIDTHS = (SPAN, (SPAN + 1) // 2, (SPAN + 3) // 4, 1)
#: Bytes of documents in which common keys are counted, and bytes of a level's contexts from which one is dealt by more bytes.
COUNTED, COMMON_BYTES = 16 << 20, (2 << 20, 16 << 20, 64 << 20)
NO_ID = np.iinfo(np.int64).max
ENTRY = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("n", "u1"), ("off", "u1")])
CUT = np.dtype([("doc", "<i8"), ("a", "<i4"), ("b", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _eights(s: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number; the first seven positions from the end are left out."""
    out = np.zeros(max(0, len(s) - ANCHOR + 1), np.uint64)
    for k in range(ANCHOR):
        out |= s[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _fixed(s: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` bytes from each start."""
    out = np.zeros(len(start), np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + s[start + k] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return _mix(out)


class Rolling:
    """Hashes of any stretches of up to `n` bytes of arrays, from prefix sums modulo 2**64."""

    def __init__(self, n: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 4 + 3
        self.power, self.inverse = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        for x in (self.power, self.inverse):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def of(self, s: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(self.letters[s] * self.power[: len(s)], out=sums[1:])
        return _mix((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def _hashes(s: np.ndarray, start: np.ndarray, length: np.ndarray, seeds: tuple[int, ...] = (1, 2)) -> list[np.ndarray]:
    """Hashes of stretches in the order of their starts, for each seed, so many bytes of `s` at once."""
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in seeds]
    stop = start + length
    longest = HASHED + int(length.max())
    rolling = [Rolling(min(longest, int(stop.max() - start[0])), x) for x in seeds]
    out, at = [np.empty(len(start), np.uint64) for _ in seeds], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HASHED, "right")))
        low, part = int(start[at]), slice(at, to)
        for r, h in zip(rolling, out, strict=True):
            h[part] = r.of(s[low : int(stop[part].max())], start[part] - low, stop[part] - low)
        at = to
    return out


def contexts(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, anchor's offset) of the contexts of documents ending at `ends` in s."""
    starts = np.r_[0, ends[:-1]]
    none = np.zeros(0, np.int64)
    if len(s) < WINDOW:
        return none, none, none, none
    place = np.uint64((1 << 31) - 1)  # a string of Spark is shorter
    low = (_mix(_eights(s)) & ~place) | np.arange(len(s) - ANCHOR + 1, dtype=np.uint64)
    span = 1
    while span < SPAN:
        step = min(span, SPAN - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    anchor = (low & place).astype(np.int64)  # of the window at each start
    doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
    first = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= ends[doc])
    if not len(first):
        return none, none, none, none
    a, d = anchor[first], doc[first]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    n = np.diff(np.r_[new, len(first)])
    return d[new], first[new], n, a[new] - first[new]


def stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)


def copies(s: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which contexts, in the order of their starts, equal one of a smaller document. Hashes bring equal ones together; their
    bytes decide."""
    one, two = _hashes(s, start, length)
    order = np.lexsort((doc, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.zeros(0, bool)
    least = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each one's group the context of the smallest document
    out = np.zeros(len(doc), bool)
    maybe = np.flatnonzero((doc[order] > doc[least]) & (length[order] == length[least]))
    ends = np.cumsum(length[order[maybe]])
    at = 0
    while at < len(maybe):  # so many bytes at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        mine, other = order[maybe[at:to]], least[maybe[at:to]]
        size = length[mine]
        same = s[stretches(start[mine], size)] == s[stretches(start[other], size)]
        out[mine] = np.logical_and.reduceat(same, np.cumsum(size) - size)
        at = to
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Number of equal values from the positions a and b on, `most` at most, by words of eight."""
    out, going = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        differ = words[a[going] + k] ^ words[b[going] + k]
        equal = differ == 0
        rest = differ[~equal]
        lead = np.zeros(len(rest), np.int64)  # equal leading values of the first word that differs
        for shift in range(56, -1, -8):
            lead += (rest >> np.uint64(shift)) == 0
        out[going[~equal]] += lead
        going = going[equal]
        out[going] += 8
        if not len(going):
            break
    return np.minimum(out, most)


def ordered_words(c: np.ndarray, depth: int) -> np.ndarray:
    """The 8 values from each position as one number that sorts as they do; zeros follow the end."""
    padded = np.r_[c, np.zeros(depth + 16, c.dtype)].astype(np.uint8)  # UTF-8 has no byte over 0xF4
    out = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(out)]
    return out


def suffix_array(c: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of a sequence (bytes + 1; 0 ends each string) in the order of their suffixes, exact to `depth`.

    Suffixes smaller than their successor are sorted by their first `depth` bytes; every other suffix follows its
    successor and is placed when that one is met in a scan over the buckets of first bytes. words: ordered_words(c, depth).
    """
    words = ordered_words(c, depth) if words is None else words
    n = len(c)
    after = np.r_[c[1:], 0]
    change = np.flatnonzero(np.r_[c[1:] != c[:-1], True])
    run_end = np.repeat(change, np.diff(np.r_[-1, change]))  # equal neighbours share the type of the run's last
    smaller = c[run_end] < after[run_end]
    smaller[c == 0] = False
    direct = np.flatnonzero(smaller)
    direct = direct[np.lexsort([words[direct + k] for k in range(0, depth, 8)][::-1])]
    heads = np.searchsorted(c[direct], np.arange(258))
    held: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    for x in range(257):
        if x == 0:
            bucket = np.flatnonzero(c == 0)
        else:
            parts = held[x]
            while parts and len(frontier := parts[-1]):
                before = frontier[frontier > 0] - 1
                parts.append(before[(c[before] == x) & ~smaller[before]])
                if not len(parts[-1]):
                    break
            bucket = np.concatenate([*parts, direct[heads[x] : heads[x + 1]]]) if parts else direct[heads[x] : heads[x + 1]]
        held[x] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(c[before] > x) & ~smaller[before]]
        if len(before):
            before = before[np.argsort(c[before], kind="stable")]
            first = c[before]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(before)], strict=True):
                if held[first[a]] and len(held[first[a]][0]) and x:
                    held[first[a]][0] = np.concatenate([held[first[a]][0], before[a:b]])
                else:
                    held[first[a]] = [before[a:b]]
    return np.concatenate(out)


def repeated_starts(s: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For all starts of the contexts, in order, whether their window also starts in a smaller document."""
    length = n + WINDOW - 1
    # one string of all contexts, each closed by 0
    total = int(length.sum() + len(n))
    c = np.zeros(total, np.int16)
    at = np.cumsum(length + 1) - length - 1
    c[stretches(at, length)] = s[stretches(start, length)].astype(np.int16) + 1
    owner = np.full(total, -1)
    places = stretches(at, n)
    owner[places] = np.arange(len(places))
    words = ordered_words(c, WINDOW)
    order = owner[suffix_array(c, WINDOW, words)]
    order = order[order >= 0]
    where = places[order]
    fresh = np.ones(len(where), bool)  # fewer than WINDOW bytes in common with the suffix before
    for a in range(1, len(where), 1 << 18):
        b = min(len(where), a + (1 << 18))
        fresh[a:b] = common_prefix(words, where[a - 1 : b - 1], where[a:b], WINDOW) < WINDOW
    docs = np.repeat(doc, n)[order]
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(docs, heads) if len(heads) else docs
    out = np.zeros(len(places), bool)
    out[order] = docs > np.repeat(least, np.diff(np.r_[heads, len(where)]))
    return out


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which keys occur in more than one document."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, len(k)])
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(d[heads] != d[heads + sizes - 1], sizes) if len(k) else False
    return out


def _key(s: np.ndarray, anchor: np.ndarray, level: int, offset: np.ndarray) -> np.ndarray:
    """Hashes of the bytes that all windows of a level's part have in common. offset: the anchor's in any of the windows."""
    width = WIDTHS[level]
    return _fixed(s, anchor - offset // width * width, WINDOW + 1 - width)


def _parted(first: np.ndarray, n: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(context, first start, number of starts, anchor's offset) of the parts of contexts in order; a part's windows have the
    anchor at offsets of one multiple of `width`."""
    high, low = off // width, (off - n + 1) // width  # the first start has the largest offset
    count = high - low + 1
    owner = np.repeat(np.arange(len(n)), count)
    part = high[owner] - stretches(np.zeros(len(n), np.int64), count)
    top, least = np.minimum(off[owner], part * width + width - 1), np.maximum(off[owner] - n[owner] + 1, part * width)
    return owner, first[owner] + off[owner] - top, top - least + 1, top


def bucket_cuts(entries: np.ndarray, s: np.ndarray, portion: int = PORTION) -> np.ndarray:
    """Stretches (doc, a, b) of removed bytes found in one bucket. Contexts of over `portion` bytes are sorted by anchor, as
    many at once as make a portion; those of one anchor that are more are parted, level by level."""
    doc, n, off = entries["doc"].astype(np.int64), entries["n"].astype(np.int64), entries["off"].astype(np.int64)
    length = n + WINDOW - 1
    return np.concatenate(_searched(s, np.cumsum(length) - length, n, off, doc, entries["pos"].astype(np.int64), 0, portion))


def _searched(s: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, doc: np.ndarray, pos: np.ndarray, level: int, portion: int) -> list[np.ndarray]:
    """For bucket_cuts: the stretches of contexts in the order of their starts."""
    length = n + WINDOW - 1
    known = copies(s, start, length, doc)
    cuts = [_cut(doc[known], pos[known], pos[known] + length[known])]
    anchor = start + off
    chosen = np.zeros(len(doc), bool)
    if level:
        rest = np.flatnonzero(~known)
        chosen[rest] = _several(_key(s, anchor[rest], level, off[rest]), doc[rest])
    else:
        right = np.flatnonzero(~known & (off + ANCHOR + SIDE <= length))
        chosen[right] |= _several(_fixed(s, anchor[right], ANCHOR + SIDE), doc[right])
        left = np.flatnonzero(~known & (off >= SIDE))
        chosen[left] |= _several(_fixed(s, anchor[left] - SIDE, ANCHOR + SIDE), doc[left])
    chosen = np.flatnonzero(chosen)
    if length[chosen].sum() <= portion:
        return cuts + _repeats(s, start, n, doc, pos, chosen)
    key = _key(s, anchor[chosen], level, off[chosen])
    order = np.argsort(key, kind="stable")
    key, chosen = key[order], chosen[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[heads[1:], len(key)]
    size = np.add.reduceat(length[chosen], heads)
    large = (size > portion) & (level + 1 < len(WIDTHS))
    so_far, i = np.cumsum(np.where(large, 0, size)), 0
    while i < len(heads):
        j = max(i + 1, int(np.searchsorted(so_far, (so_far[i - 1] if i else 0) + portion, "right")))
        own = np.repeat(~large[i:j], (ends - heads)[i:j])
        cuts += _repeats(s, start, n, doc, pos, np.sort(chosen[heads[i] : ends[j - 1]][own]))
        i = j
    if large.any():
        more = np.sort(chosen[np.repeat(large, ends - heads)])
        owner, at, count, offset = _parted(start[more], n[more], off[more], WIDTHS[level + 1])
        cuts += _searched(s, at, count, offset, doc[more][owner], pos[more][owner] + at - start[more][owner], level + 1, portion)
    return cuts


def _repeats(s: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray, pos: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """For _searched: the stretches that a suffix array of the chosen contexts shows."""
    if len(chosen) < 2:
        return []
    hit = repeated_starts(s, start[chosen], n[chosen], doc[chosen])
    owner, place = np.repeat(chosen, n[chosen]), stretches(np.zeros(len(chosen), np.int64), n[chosen])
    owner, place = owner[hit], place[hit]
    if not len(owner):
        return []
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.r_[new[1:], len(owner)] - 1
    at = pos[owner[new]]
    return [_cut(doc[owner[new]], at + place[new], at + place[last] + WINDOW)]


def _cut(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), CUT)
    out["doc"], out["a"], out["b"] = doc, a, b
    return out


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    for a, b in zip(heads, [*heads[1:], len(k)] if len(k) else [], strict=True):
        yield int(k[a]), order[a:b]


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of so many bytes of input."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch["id"], batch["text"], strict=True):
            ids.append(NO_ID if pd.isna(key) else int(key))
            texts.append(text.encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, text): rows (level, key, size), the bytes of each key's contexts in a block."""
    for own, texts in _blocks(batches):
        s = np.frombuffer(b"".join(texts), np.uint8)
        d, first, n, off = contexts(s, np.cumsum([len(t) for t in texts]))
        known = copies(s, first, n + WINDOW - 1, own[d])
        first, n, off = first[~known], n[~known], off[~known]
        for level in range(len(COMMON_BYTES)):
            if level:
                _, first, n, off = _parted(first, n, off, WIDTHS[level])
            key, at = np.unique(_key(s, first + off, level, off), return_inverse=True)
            size = np.bincount(at, n + WINDOW - 1, len(key)).astype(np.int64)
            several = size > 2 * WINDOW + SPAN  # of one context alone nothing is known
            yield pd.DataFrame({"level": np.full(int(several.sum()), level, np.int32), "key": key[several].view(np.int64), "size": size[several]})


def common_keys(rows: DataFrame, total: int, counted: int = COUNTED, least: tuple[int, ...] = COMMON_BYTES) -> list[np.ndarray]:
    """For each level but the last the keys whose contexts, carried on from `counted` bytes of documents to all, have over
    `least` bytes. Every task deals by the same keys, so any choice of them finds the same windows."""
    if total <= least[0]:
        return [np.zeros(0, np.uint64) for _ in least]
    times = max(1, total // counted)
    some = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(6)), F.lit(times)) == 0)
    limit = F.element_at(F.array(*(F.lit(x / times) for x in least)), F.col("level") + 1)
    found = some.mapInPandas(_count, "level int, key long, size long").groupBy("level", "key").agg(F.sum("size").alias("size")).where(F.col("size") > limit).collect()  # one row for so many bytes
    return [np.sort(np.array([r["key"] for r in found if r["level"] == k], np.int64).view(np.uint64)) for k in range(len(least))]


def _deal(buckets: int, common: list[np.ndarray]):  # noqa: ANN202
    """For mapInPandas over (id, text): rows (bucket, entries, bytes, cuts), all packed. common: from common_keys()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress

        def block(own: np.ndarray, texts: list[bytes]) -> pd.DataFrame:
            s = np.frombuffer(b"".join(texts), np.uint8)
            d, first, n, off = contexts(s, np.cumsum([len(t) for t in texts]))
            begin = np.cumsum([0, *map(len, texts)])
            doc, pos, length = own[d], first - begin[d], n + WINDOW - 1
            known = copies(s, first, length, doc)
            cuts = _cut(doc[known], pos[known], pos[known] + length[known])
            d, first, n, off = (x[~known] for x in (d, first, n, off))
            key = _key(s, first + off, 0, off)
            for level, keys in enumerate(common):
                again = np.isin(key, keys)
                if not again.any():
                    break
                owner, *parts = _parted(first[again], n[again], off[again], WIDTHS[level + 1])
                kept = [(x[~again], y) for x, y in ((d, d[again][owner]), (first, parts[0]), (n, parts[1]), (off, parts[2]))]
                more = _key(s, parts[0] + parts[2], level + 1, parts[2])
                d, first, n, off = (np.concatenate(x) for x in kept)
                key = np.concatenate([key[~again], more])
            doc, pos, length = own[d], first - begin[d], n + WINDOW - 1
            rows = []
            for bucket, at in _groups((key % np.uint64(buckets)).astype(np.int64)):
                e = np.empty(len(at), ENTRY)
                e["doc"], e["pos"], e["n"], e["off"] = doc[at], pos[at], n[at], off[at]
                columns = b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names)
                rows.append((bucket, len(at), pack(columns), pack(s[stretches(first[at], length[at])].tobytes()), b""))
            if len(cuts):
                rows.append((int(_mix(np.array([own.min()], np.uint64))[0] % np.uint64(buckets)), 0, b"", b"", pack(cuts.tobytes())))
            return pd.DataFrame(rows, columns=["bucket", "n", "entries", "bytes", "cuts"])

        for own, texts in _blocks(batches):
            yield from (f for f in [block(own, texts)] if len(f))

    return run


def _entries(columns: bytes, n: int) -> np.ndarray:
    e, at = np.empty(n, ENTRY), 0
    for c in ENTRY.names:
        e[c] = np.frombuffer(columns, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return e


def _find(parts: int):  # noqa: ANN202
    """For applyInPandas by bucket: rows (part, cuts), packed."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        full = group[group["n"] > 0]
        cuts = [np.frombuffer(unpack(c), CUT) for c in group["cuts"] if c]
        if len(full):
            entries = np.concatenate([_entries(unpack(e), n) for e, n in zip(full["entries"], full["n"], strict=True)])
            cuts.append(bucket_cuts(entries, np.concatenate([np.frombuffer(unpack(b), np.uint8) for b in full["bytes"]])))
        found = np.concatenate(cuts) if cuts else np.zeros(0, CUT)
        rows = [(part, pack(np.sort(found[at], order=["doc", "a"]).tobytes())) for part, at in _groups(_part(found["doc"], parts))]
        return pd.DataFrame(rows, columns=["part", "cuts"]).astype({"part": "int64"})

    return run


def _pack_texts(parts: int):  # noqa: ANN202
    """For mapInPandas over (id, text): rows (part, ids, lengths, texts), packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            own = np.array([NO_ID if pd.isna(k) else int(k) for k in batch["id"]], np.int64)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            lengths = np.array([len(t) for t in texts], np.int64)
            rows = [(p, own[at].tobytes(), lengths[at].tobytes(), pack(b"".join([texts[i] for i in at]))) for p, at in _groups(_part(own, parts))]
            yield pd.DataFrame(rows, columns=["part", "ids", "lengths", "texts"])

    return run


def _cut_texts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For a cogroup of packed texts and cuts by part."""
    unpack = zstandard.ZstdDecompressor().decompress
    cuts = np.sort(np.concatenate([np.zeros(0, CUT), *(np.frombuffer(unpack(c), CUT) for c in right["cuts"])]), order=["doc", "a"])
    rows = []
    for ids, lengths, packed in zip(left["ids"], left["lengths"], left["texts"], strict=True):
        data, at = unpack(packed), 0
        for key, size in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(lengths, np.int64).tolist(), strict=True):
            text = data[at : at + size]
            at += size
            a, b = np.searchsorted(cuts["doc"], [key, key + 1 if key < NO_ID else key], "left")
            b = b if key < NO_ID else len(cuts)
            kept, done, removed, spans = [], 0, 0, 0
            reach = np.maximum.accumulate(cuts["b"][a:b])
            heads = np.flatnonzero(np.r_[True, cuts["a"][a + 1 : b] > reach[:-1]]) if b > a else np.zeros(0, np.int64)
            for i, j in zip(heads, np.r_[heads[1:], b - a], strict=False):
                x, y = int(cuts["a"][a + i]), min(int(reach[j - 1]), size)
                if x < y:
                    kept.append(text[done:x])
                    done, removed, spans = y, removed + y - x, spans + 1
            kept.append(text[done:])
            rows.append((None if key == NO_ID else key, size, removed, spans, sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
    return pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"id": "Int64"})


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; `kept` are the bytes that stay.

    A null or empty text has nothing to remove. Ids are whole numbers; a null id is greater than all and no id's
    smaller. Rows that share an id are taken for copies of one document, so none of them repeats another. Texts of any
    length are whole; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets, parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PART_BYTES))
    dealt = rows.mapInPandas(_deal(buckets, common_keys(rows, total)), "bucket long, n int, entries binary, bytes binary, cuts binary")
    cuts = dealt.groupBy("bucket").applyInPandas(_find(parts), "part long, cuts binary")
    texts = rows.mapInPandas(_pack_texts(parts), "part long, ids binary, lengths binary, texts binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _cut_texts(left, right)
        return out if with_text else out.drop(columns="kept")

    return texts.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(cut, schema).withColumnRenamed("id", id_col)


def suffix_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), with_text=False)

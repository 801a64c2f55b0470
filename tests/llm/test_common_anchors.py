"""A very common anchor fills no bucket and no memory, and the same windows are found."""

from __future__ import annotations

import tracemalloc
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import suffix


def removed(texts: dict[int, bytes]) -> dict[int, np.ndarray]:
    """By brute force which bytes of each text go."""
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    out = {}
    for i, b in texts.items():
        out[i] = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                out[i][k : k + 50] = True
    return out


def around_one_anchor(rng, n: int) -> dict[int, bytes]:
    """Texts around one of a few passages, so that contexts share an anchor and many bytes beside it, but not all."""
    letters = np.frombuffer(b"abcdefghij ", np.uint8)
    some = lambda k: rng.choice(letters, k).tobytes()
    passages = [some(70), some(70)]
    sides = [some(40) for _ in range(6)]
    return {i: some(rng.integers(0, 30)) + sides[rng.integers(6)][rng.integers(0, 40) :] + passages[i % 2][rng.integers(0, 30) :][: rng.integers(20, 60)] + sides[rng.integers(6)][: rng.integers(0, 40)] + some(3) for i in range(n)}


def packed(texts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids, s = np.array(list(texts)), np.frombuffer(b"".join(texts.values()), np.uint8)
    begin = np.cumsum([0, *map(len, texts.values())])
    d, first, n, off = suffix.contexts(s, begin[1:])
    e = np.empty(len(d), suffix.ENTRY)
    e["doc"], e["pos"], e["n"], e["off"] = ids[d], first - begin[d], n, off
    return e, s[suffix.stretches(first, n + suffix.WINDOW - 1)]


@pytest.mark.parametrize("portion", [60, 400, 3000, 1 << 20])
def test_a_large_bucket_is_parted_and_the_same_bytes_go(portion):
    texts = around_one_anchor(np.random.default_rng(2), 300)
    marks = {i: np.zeros(len(b), bool) for i, b in texts.items()}
    for doc, a, b in suffix.bucket_cuts(*packed(texts), portion):
        marks[int(doc)][a:b] = True
    want = removed(texts)
    assert all((marks[i] == want[i]).all() for i in texts) and sum(m.sum() for m in want.values()) > 5000


def test_common_keys_of_each_level_are_dealt_by_more_bytes(spark):
    texts = around_one_anchor(np.random.default_rng(3), 400)
    rows = spark.createDataFrame([(i, b.decode()) for i, b in texts.items()], "id long, text string").repartition(3)
    common = suffix.common_keys(rows, sum(map(len, texts.values())), least=(2000, 1000, 500))
    assert all(len(x) for x in common)
    buckets, dealt = 50, {}
    for name, keys in (("plain", [x[:0] for x in common]), ("parted", common)):
        found = rows.mapInPandas(suffix._deal(buckets, keys), "bucket long, n int, entries binary, bytes binary, cuts binary")
        dealt[name] = max(r["sum(n)"] for r in found.groupBy("bucket").sum("n").collect())
        cuts = np.sort(np.concatenate([np.frombuffer(suffix.zstandard.decompress(r["cuts"]), suffix.CUT) for r in found.groupBy("bucket").applyInPandas(suffix._find(1), "part long, cuts binary").collect()]))
        for i, want in removed(texts).items():
            mark = np.zeros(len(want), bool)
            for c in cuts[cuts["doc"] == i]:
                mark[c["a"] : c["b"]] = True
            assert (mark == want).all(), (name, i)


def test_memory_of_a_large_bucket_is_bounded():
    """150,000 contexts of one anchor, 14 MB of them, took over 60 bytes a byte before."""
    rng, n = np.random.default_rng(4), 150_000
    s = rng.integers(97, 123, (n, 92)).astype(np.uint8)
    s[:, 42:50] = np.frombuffer(b"anchored", np.uint8)
    s[:, 50:92] = s[rng.integers(0, 2000, n), 50:92]
    e = np.zeros(n, suffix.ENTRY)
    e["doc"], e["n"], e["off"] = np.arange(n), suffix.SPAN, 42
    tracemalloc.start()
    cuts = suffix.bucket_cuts(e, s.ravel())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = {}
    for i, right in enumerate(map(bytes, s[:, 42:92])):
        first.setdefault(sha256(right).digest(), i)
    assert len(np.unique(cuts["doc"])) == n - len(first) and peak < 480e6, peak

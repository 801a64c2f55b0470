"""Exact search, conversation repair and collocations against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mtree, phrases, repair


def brute_search(rows: list[tuple], k: int = 5) -> list[tuple]:
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        s = [math.floor(256 * x) for x in v]
        whole[i] = min(s, whole.get(i, s))
    out = []
    for q, v in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(n: int, kind: str) -> list[tuple]:
    rng = np.random.default_rng(5)
    if kind == "clusters":
        middles = rng.normal(size=(12, 8))
        m = middles[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 8))
    else:
        m = rng.integers(-2, 3, size=(n, 3)) / 256  # very many ties and equal vectors
    return [(i, [float(x) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize("kind", ["clusters", "ties"])
def test_search_equals_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "TREE", 200)
    monkeypatch.setattr(mtree, "ROWS", 300)
    monkeypatch.setattr(mtree, "PIVOTS", 4)
    monkeypatch.setattr(mtree, "QUERIES", 10)
    monkeypatch.setattr(mtree, "BATCH", 4)
    rows = vectors(1500, kind)
    rows += [(3000, None), (3050, [1.0, None]), (3100, [float("nan"), 1.0]), (3150, [float("inf")]), (None, [1.0, 2.0]), (3200, []), (3250, [4.0]), (50, rows[50][1]), (100, [9.0] * 3)]
    rows += [(4000 + i, rows[0][1]) for i in range(100)]  # copies, two of them queries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "q": F.lit("x"), "ids": F.lit(0), "score": F.lit(0)})
    got = mtree.search_query(df).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_search([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert df.schema["embedding"] and mtree.search_query(df.limit(0)).count() == 0


def test_search_gives_all_if_fewer_and_refuses_huge_components(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.search_query(df).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, 65536)]
    assert mtree.search_query(df.where("vec_id = 0")).count() == 0
    with pytest.raises(Exception, match="a component of"):
        mtree.search_query(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>")).collect()


def test_tree_bounds_hold_and_save_products():
    rng = np.random.default_rng(1)
    m = np.floor(256 * (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + 0.02 * rng.normal(size=(3000, 16)))).astype(int)
    most = float((m * m).sum(1).max())
    import pandas as pd

    part = pd.DataFrame({"tree": 0, "v": [list(x) for x in m], "ids": [[i] for i in range(len(m))]})
    pages = mtree.grown(16, most)(part)
    lifted = mtree._lifted(m, most)
    forest = mtree.Forest(pages, 16)

    def below(at: tuple) -> list[int]:
        leaf, _, _, rest = forest.pages[at]
        if leaf:
            return [int(i) for x in rest for i in x]
        return [i for c in rest[1] for i in below((at[0], int(c)))]

    assert sorted(below((0, 0))) == list(range(3000))
    for at, (leaf, v, parent, rest) in forest.pages.items():
        if not leaf:
            for p, radius, child in zip(mtree._lifted(v.astype(int), most), *rest, strict=True):
                own = lifted[below((at[0], int(child)))]
                assert np.sqrt(((own - p) ** 2).sum(1)).max() <= radius + 1e-6
                assert np.allclose(np.sqrt(((mtree._lifted(forest.pages[0, int(child)][1].astype(int), most) - p) ** 2).sum(1)), forest.pages[0, int(child)][2])
    asked = m[:20]
    found = forest.best(asked, (asked * asked).sum(1) + most, 6, np.full(20, -1e300))
    for q, own in zip(asked, found, strict=True):
        assert own == sorted((-int(s), i) for i, s in enumerate(m @ q))[:6]
    one = mtree.Forest(pages, 16)
    for q in asked:
        one.best(q[None], np.array([q @ q + most]), 6, np.array([-1e300]))
    assert one.products < 20 * 3000 / 2  # the rest was left out by bounds


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute_repair(signature: str) -> tuple[int, str]:
    """By cheapest path over (letters used, repaired initials' state as text so far), edits in order."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if at == len(signature) and LEGAL.match(made):
            return cost, audit
        if (audit, at, made) in seen or len(made) > len(signature) + 4:
            continue
        seen.add((audit, at, made))
        nexts = [("I", 3, r, 0) for r in "ua"]
        if at < len(signature):
            c = signature[at]
            nexts.append(("D", 4, "", 1))
            if c != "d":
                extra = 3 if c.isupper() else 0
                nexts += [("K", extra, c.lower(), 1), *(("R", 3 + extra, r, 1) for r in "ua")]
        for edit, price, role, used in nexts:
            text = made + role
            if re.match(r"s?(ua)*u?\Z", text):  # else no end is legal
                heapq.heappush(heap, (cost + price, audit + edit, at + used, text))
    raise AssertionError


def test_trie_equals_cheapest_paths_and_shares_prefixes():
    letters = "suaoSUAd"
    words = ["".join(w) for n in range(4) for w in product(letters, repeat=n)]
    rng = random.Random(4)
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    trie = repair.Trie()
    words = sorted(set(words))
    for w in words:
        assert trie.answer(w) == brute_repair(w), w
    assert trie.computed == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_trie_takes_long_signatures():
    cost, audit = repair.Trie().answer("ua" * 50_000 + "u")
    assert (cost, audit) == (3, "K" * 100_001 + "I")


def brute_conversations(rows: list[tuple]) -> dict:
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out[c] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    result = {}
    for c, turns in out.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        counts, seen, letters = Counter(), set(), ""
        for turn, role, text in turns:
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            bare = text.strip(" \t\n\x0b\x0c\r")
            if not bare:
                counts["blank"] += 1
                letters += "d"
            elif (role, text) in seen:
                counts["duplicate"] += 1
                letters += "d"
            elif bare[-1] not in ".!?":
                counts["truncated"] += 1
                letters += first.upper()
            else:
                letters += first
            seen.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = brute_repair(letters)
        made, lines, left = "", [], iter(turns)
        for e in audit:
            expected = "assistant" if made.endswith("u") else "user"
            if e == "I":
                lines.append(f"{expected}:")
                made += expected[0]
                continue
            _, role, text = next(left)
            if e != "D":
                role = role if e == "K" else expected
                made += role[0]
                lines.append(f"{role}:{text}")
        result[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return result


def test_repair_equals_brute_force(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No", "Well? ", " \t", "", "A!\x0b", "ünd.", "Long " * 3000 + ".", None]
    rows = []
    for c in [*range(60), None]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for t in range(rng.randrange(0, 9))]
    rows += [(100, 0, "user", "Only."), (101, None, None, None), (102, 2, "user", "x."), (102, 2, "user", "x."), (103, 9, "system", "s."), (103, 0, "user", "s.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "fault": F.lit("x"), "signature": F.lit("x"), "audit": F.lit("")})
    got = {r[0]: tuple(r)[1:] for r in repair.repair_query(df).collect()}
    assert got == brute_conversations(rows)
    assert repair.repair_query(df.limit(0)).count() == 0


def brute_phrases(rows: list[tuple], first: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b * 100 >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


def phrase_rows() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "city", "ünder", "Ünder", "a\x1cb", "日本", "x"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(0, 120)))) for _ in range(120)]
    return [*rows, ("en", None), ("en", ""), ("fr", " \t "), ("en", "go go " * 4000), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_phrases_equal_counts(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = phrase_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").withColumns({"phrase": F.lit("x"), "n": F.lit(1), "size": F.lit(1)}).repartition(3)
    assert sorted(tuple(r) for r in phrases.phrases_query(df).collect()) == brute_phrases(rows, 2000)
    few = phrases.top_phrases(phrases.collocations(df), 7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in few.collect()) == brute_phrases(rows, 7)
    assert phrases.phrases_query(df.limit(0)).count() == 0


def test_states_are_classes_of_equal_ends():
    rng = random.Random(2)
    words = np.array([rng.choice([0, 1, 2, 3, 3]) for _ in range(400)])
    ends: dict[tuple, set] = defaultdict(set)
    for i in range(len(words)):
        for k in (1, 2, 3):
            if i >= k - 1 and words[i - k + 1 : i + 1].all():
                ends[tuple(words[i - k + 1 : i + 1])].add(i)
    end, shortest, longest, n, link = phrases.suffix_states(words, 3)
    seen = {}
    for s in range(len(end)):
        for k in range(shortest[s], longest[s] + 1):
            p = tuple(words[end[s] - k + 1 : end[s] + 1])
            assert len(ends[p]) == n[s] and p not in seen
            seen[p] = s
        p = tuple(words[end[s] - shortest[s] + 2 : end[s] + 1])
        assert link[s] == (seen.get(p, link[s]) if p else -1) and (not p or len(ends[p]) > n[s])
    assert set(seen) == set(ends)


def test_weakest_cut_is_exact_beyond_64_bits(spark):
    a, l, r = 10**13 + 7, 3 * 10**13 + 1, 10**14 + 9
    cand = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, phrase string, n long")
    assert phrases.weakest_cut(cand, counts).first()["score"] == 10**6 * a * a // (l * r)


def test_filter_never_misses_a_pair(spark):
    pairs = [("en", f"w{i} v{i % 7}") for i in range(3000)]
    bits = phrases.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string"), len(pairs))
    h = lambda k: phrases._hashes("en", [p.split()[k].encode() for _, p in pairs])
    for at in phrases._bits(h(0), h(1), 64 * len(bits)):
        assert phrases._has(bits, at).all()
    assert pa.array(bits.view(np.int64)).nbytes == len(bits) * 8

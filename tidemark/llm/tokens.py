"""Token counts with a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that give one token are pre-tokens of
count one. In the tasks a text is cut into pre-tokens; the proven ones are counted directly, and only the others are
merged, by the vocabulary's own merge list, once per worker and word.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Counts kept in a worker besides the proven ones.
KEPT = 500_000


def merged_by_heap(parts: list, rank_of) -> list:  # noqa: ANN001
    """`parts` after all merges, lowest rank first and leftmost among equals; rank_of gives a pair's rank or None."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or rank_of(parts[i], parts[j]) != r:
            continue
        parts[i] = parts[i] + parts[j]
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (r := rank_of(parts[a], parts[right[a]])) is not None:
                heapq.heappush(heap, (r, a))
    return [p for p, live in zip(parts, alive, strict=True) if live]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def prove(path: str, pattern: str) -> dict:
    """What a task needs to count, in tables of the vocabulary's size. Read a tokenizer file, and find by the library which strings of its vocabulary are one token alone.

    The library cuts texts by the character classes of its own Unicode version; letters and digits that it does not
    know as such are found by asking it, and texts with one of those use a pattern without them.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parsed = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in parsed["added_tokens"]}
    strings = []
    for token in parsed["model"]["vocab"]:
        if token not in special:
            try:
                strings.append(bytes(byte_of[c] for c in token).decode("utf-8"))
            except (UnicodeDecodeError, KeyError):
                continue  # part of a character: never a pre-token
    cut = regex.compile(pattern)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    whole = {s: 1 for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and cut.findall(s) == [s]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
    young = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    unknown = [ord(c) for c in young if len(split("a" + c)) > 1 and len(split("1" + c)) > 1]
    starts = [c for c, before in zip(unknown, [-1, *unknown], strict=False) if c != before + 1]
    stops = [c for c, after in zip(unknown, [*unknown[1:], -1], strict=True) if c != after - 1]
    rare = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops, strict=True)) + "]" if unknown else r"(?!)"
    rare_pattern = pattern.replace(r"\p{L}+", rf"(?:(?!{rare})\p{{L}})+", 1).replace(r"\p{N}+", rf"(?:(?!{rare})\p{{N}})+", 1).replace(r"[^\s\p{L}\p{N}]+", rf"(?:{rare}|[^\s\p{{L}}\p{{N}}])+", 1)
    return {
        "whole": whole, "ranks": {tuple(m): i for i, m in enumerate(merges)}, "pattern": pattern, "rare": rare, "rare_pattern": rare_pattern,
        "special": "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)",
    }


class Counts(dict):
    """Tokens by pre-token; what is missing is merged and kept."""

    def __init__(self, table: dict) -> None:
        super().__init__(table["whole"])
        self.table, self.letters = table, byte_letters()

    def __missing__(self, word: str) -> int:
        rank, whole = self.table["ranks"].get, self.table["whole"]
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(merged_by_heap(parts, lambda a, b: rank((a, b))))
        if len(self) > len(whole) + KEPT:
            self.clear()
            self.update(whole)
        self[word] = n
        return n


def count_batches(shared, limit: int):  # noqa: ANN001, ANN201
    """For mapInPandas over id, text and n_bytes. shared: a broadcast of what prove() gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        counts = Counts(table)
        usual, rare, unusual = regex.compile(table["pattern"]).findall, regex.compile(table["rare"]).search, regex.compile(table["rare_pattern"]).findall
        special = regex.compile(table["special"])

        def tokens(text: str) -> int:
            pieces = special.split(text)
            return len(pieces) - 1 + sum(sum(map(counts.__getitem__, (unusual if not p.isascii() and rare(p) else usual)(p))) for p in pieces)

        for batch in batches:
            n = [tokens(t) for t in batch["text"]]
            yield batch[["id", "n_bytes"]].assign(n_tokens=n, over_limit=[x > limit for x in n])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row; special strings inside a text are one token each, as the
    library has it by default. A null text counts as empty: no bytes, no tokens. Repeated rows give each, null ids stay
    null, an empty table gives no rows."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(prove(path, pattern))  # of the vocabulary's size
    schema = rows.select("id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    return rows.mapInPandas(count_batches(shared, limit), schema).withColumnRenamed("id", id_col)


def tokens_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

"""Repair of conversations to an optional system turn and pairs of a user's and an assistant's turn, by cheapest edits.

The edits of a conversation depend on its signature alone, one letter a row for role and fault. Signatures are sorted and
walked as the paths of a prefix trie: the layers of the dynamic programme stay on a stack, a layer is computed once for each
prefix that the sorted signatures of a task share, and an answer is read off where a signature ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: States of a repaired beginning: nothing, a system turn, a user's turn last, an assistant's last; and where each role leads.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
SALTS = 16
#: Letters of a signature: s, u, a or o for the first letter of the role (o: another), upper-case where the row is truncated, d
#: where it must go.
MUST_GO = "d"

#: A layer: for each state that can be reached (cost above the layer's least, rank of its edits by text among the layer's).
Layer = tuple[tuple[int, int] | None, ...]


def _widened(layer: Layer) -> list[tuple[int, int, int, int, str]]:
    """(state, cost, state before, rank, inserts) for every state and number of inserts that can help."""
    out = []
    for s, entry in enumerate(layer):
        if entry is not None:
            out.append((s, entry[0], s, entry[1], ""))
            at, text = s, ""
            for _ in range(2):  # a user's turn, an assistant's; more only come back to the same states
                at, text = STEPS[at].get("u", 3), text + "I"
                out.append((at, entry[0] + INSERT * len(text), s, entry[1], text))
    return out


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, letter: str) -> tuple[int, Layer, tuple[tuple[int, str] | None, ...]]:
    """(growth of the least cost, the next layer, for each of its states the one before and the edits between).

    Edits of one state differ before either text ends, as the last edit of a layer is never an insert; so comparing the ranks
    of the texts so far, and then the edits added, compares whole texts.
    """
    moves: list[tuple[int, tuple[int, int, str], int, str]] = []
    fault = TRUNCATED if letter.isupper() else 0
    for state, cost, before, rank, inserts in _widened(layer):
        moves.append((state, (cost + DELETE, rank, inserts + "D"), before, inserts + "D"))
        if letter != MUST_GO:
            if (to := STEPS[state].get(letter.lower())) is not None:
                moves.append((to, (cost + fault, rank, inserts + "K"), before, inserts + "K"))
            for role in "ua":
                if (to := STEPS[state].get(role)) is not None:
                    moves.append((to, (cost + fault + REROLE, rank, inserts + "R"), before, inserts + "R"))
    best: list[tuple | None] = [None] * 4
    for to, key, before, edits in moves:
        if best[to] is None or key < best[to][0]:
            best[to] = (key, before, edits)
    least = min(b[0][0] for b in best if b)
    order = sorted(b[0][1:] for b in best if b)
    layer = tuple(None if b is None else (b[0][0] - least, order.index(b[0][1:])) for b in best)
    return least, layer, tuple(None if b is None else b[1:] for b in best)


START: Layer = ((0, 0), None, None, None)


class Trie:
    """The path of the last signature, layer by layer."""

    def __init__(self) -> None:
        self.path, self.layers, self.computed = "", [(0, START, ())], 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair, the first by text among equals."""
        shared = 0
        most = min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            grown, layer, back = step(self.layers[-1][1], letter)
            self.layers.append((self.layers[-1][0] + grown, layer, back))
            self.computed += 1
        self.path = signature
        base, layer, _ = self.layers[-1]
        cost, _, text, state = min((cost, rank, text, before) for s, cost, before, rank, text in _widened(layer) if s in ENDS)
        edits = [text]
        for _, _, back in reversed(self.layers[1:]):
            state, text = back[state]
            edits.append(text)
        return base + cost, "".join(reversed(edits))


def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over sorted signatures."""
    trie = Trie()
    for batch in batches:
        found = [trie.answer(s) for s in batch["signature"]]
        yield batch.assign(cost=[c for c, _ in found], audit=[a for _, a in found])


def has_text(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def turns_with_faults(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with their place in the conversation from 1, by turn (null first), role and text; the
    letter of the signature; the first fault; and whether the role may not follow the one before."""
    own, same = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "role", "text")
    by_turn = [F.asc_nulls_first("turn"), "role", "text"]
    first = F.substring("role", 1, 1)
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(*by_turn))).withColumn("again", F.row_number().over(same.orderBy("place")) > 1)
    rows = rows.withColumn("illegal", (F.col("place") > 1) & ~F.concat(F.lag(first).over(own.orderBy("place")), first).isin("su", "ua", "au"))
    fault = F.when(~has_text(F.col("text")), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    rows = rows.withColumn("fault", fault).withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))
    return rows.select("conv_id", "turn", "place", "role", "text", "fault", "letter", "illegal")


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation, from turns_with_faults.

    A conversation sends one letter a row, and the trie sees each signature once; many conversations of one signature get
    its answer in parts.
    """
    number = lambda c: F.count(F.when(c, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "")
    figures = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *(number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), number(F.col("illegal")).alias("illegal"), letters.alias("signature"))
    figures = written(figures, "signatures")
    every = figures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    found = every.mapInPandas(answers, "signature string, cost long, audit string")
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = figures.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return salted.join(found, ["signature", "salt"]).drop("signature", "salt")


def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over each conversation's audit (place 0) and then its rows, in order: the repaired rows."""
    conv, audit, at, state, place = None, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal state, place
            state, place = STEPS[state][role[0]], place + 1
            out.append((conv, place, edit, role, text))

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", ROLES["u" if state != 2 else "a"], "")
                at += 1

        for c, row, role, text, plan in zip(batch["conv_id"], batch["place"], batch["role"], batch["text"], batch["audit"], strict=True):
            if row == 0:
                conv, audit, at, state, place = c, plan, 0, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, role if edit == "K" else ROLES["u" if state != 2 else "a"], text)
            inserts()
        yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"]).astype({"conv_id": "Int64", "place": "int32"})


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, each conversation's in order in one
    partition. Rows pass through a task one batch after the other; no conversation is gathered."""
    heads = planned.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    body = rows.select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return both.mapInPandas(edited, "conv_id long, place int, edit string, role string, text string")


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over repaired(): (conv_id, repaired_sha256) of each conversation's `role:text` lines."""
    nothing = object()
    conv, state = nothing, sha256()
    for batch in batches:
        out = []
        for c, place, role, text in zip(batch["conv_id"], batch["place"], batch["role"], batch["text"], strict=True):
            if place == 1:
                if conv is not nothing:
                    out.append((conv, state.hexdigest()))
                conv, state = (None if pd.isna(c) else c), sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
    if conv is not nothing:
        yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})


def given(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with null roles and texts as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of given() damaged by crc32 of `conv_id:turn` modulo 20: 0 goes, 1 loses its text, 2 its full stops, question and
    exclamation marks, 3 comes twice, 4 becomes the user's. A null id or turn is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("damage", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "damage", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).drop("damage", "copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired turns) of conversations (conv_id, turn, role, text; role and text not null).

    A null conv_id is a conversation of its own; a null turn comes first; rows of one turn stand by role and text, repeated
    ones side by side; an empty table gives no rows. Texts may be of any length. Ties of cost go to the audit first by ASCII.
    """
    rows = written(turns_with_faults(rows), "turns")
    planned = written(plans(rows), "plans")
    return planned, repaired(rows, planned)


def repair_query(conversations: DataFrame) -> DataFrame:
    rows = given(conversations)
    planned, turns = repair(damaged(rows))
    done = turns.mapInPandas(digests, "conv_id long, repaired_sha256 string")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    every = rows.select("conv_id").distinct()
    out = every.join(planned, same(every, planned), "left").join(done, same(every, done), "left")
    return out.select(every["conv_id"], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))

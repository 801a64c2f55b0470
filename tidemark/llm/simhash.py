"""SimHash fingerprints in Arrow batches, and walks over sorted batches of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest

#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 18


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, joined by spaces; of all words where there are fewer; of nothing for none."""
    n = len(words)
    if n <= k:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if n else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, stops = [0, *ends[: n - k].tolist()], (ends[k - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """n x 64, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    votes = sum(bit_rows(hashes[i : i + BLOCK]).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), BLOCK))
    return packed(2 * votes > len(hashes))


def weighted(hashes: np.ndarray) -> int:
    """Each different hash votes on every bit, for or against, with 1 + log2 of its count; 0 for none."""
    if not len(hashes):
        return 0
    terms, counts = np.unique(hashes, return_counts=True)
    weight = 1 + np.log2(counts)
    votes = sum(weight[i : i + BLOCK] @ bit_rows(terms[i : i + BLOCK]) for i in range(0, len(terms), BLOCK))
    return packed(2 * votes > weight.sum())


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by `key`, in frames that never cut a key's rows apart."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pd.concat([*held, batch[:cut]], ignore_index=True)
            held = [batch[cut:]]
        elif held and held[-1][key].iloc[-1] != keys[-1]:
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
    return starts, np.r_[starts[1:], len(keys)]


def fingerprinter(of_text: Callable[[str], int], id_cols: list[str], text_col: str, out_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[id_cols].copy()
            out[out_col] = signed([of_text(t) if isinstance(t, str) else 0 for t in batch[text_col]])
            yield out

    return run

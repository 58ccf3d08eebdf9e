"""Periodic runs of words, found by probing a harmonic grid.

A run of period p and at least four periods has at least 3p places x whose word
equals the word at x + p, all in a row, so three neighbouring multiples of p are
among them. For each p only the multiples of p are looked at (n/p of them, so
n log n for all p together): jp and (j+1)p must hold equal words for three j in
a row, and so must the middles between them. What survives is extended to both
sides by comparing chunks of the word array with the chunk p further on. Grid
points within a run already found whose period divides p are skipped: they would
only find that run again, under a multiple of its period.

The texts of a batch lie in one array, with separators that equal no word, so
that a probe of one p serves them all.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pick, tidy, words

#: A run has so many words at least, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words compared at a time while a run is extended: at first, and at most.
CHUNK, LONGEST_CHUNK = 64, 1 << 16


def _stretch(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest [low, high) around `at` in which every word equals the one p places on."""
    last, high, size = len(ids) - p, at, CHUNK
    while high < last:
        differ = ids[high : min(high + size, last)] != ids[high + p : min(high + size, last) + p]
        k = int(differ.argmax())
        if differ[k]:
            high += k
            break
        high += len(differ)
        size = min(2 * size, LONGEST_CHUNK)
    low, size = at, CHUNK
    while low > 0:
        begin = max(low - size, 0)
        differ = (ids[begin:low] != ids[begin + p : low + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            low -= k
            break
        low = begin
        size = min(2 * size, LONGEST_CHUNK)
    return low, high


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array whose texts have at most `longest` words."""
    found: list[tuple[int, int, int]] = []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by period: starts and ends
    for p in range(1, longest // MIN_PERIODS + 1):
        grid = ids[::p]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not at.size:
            continue
        at *= p
        middle = at + p // 2
        at = at[(ids[middle] == ids[middle + p]) & (ids[middle + p] == ids[middle + 2 * p])]
        for q, (starts, ends) in known.items():
            if at.size and p % q == 0:
                run = np.searchsorted(starts, at, "right") - 1
                at = at[(run < 0) | (at + p >= ends[run])]
        new = []
        while at.size:
            low, high = _stretch(ids, int(at[0]), p)
            if high - low + p >= max(MIN_WORDS, MIN_PERIODS * p):
                new.append((low, high + p - low, p))
            at = at[np.searchsorted(at, max(high, int(at[0]) + 1)) :]
        if new:
            known[p] = (np.array([s for s, _, _ in new]), np.array([s + n for s, n, _ in new]))
            found += new
    return found


def _batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period; starts are word numbers of the text."""
    names = dict.fromkeys(w for t in texts for w in t)
    for i, w in enumerate(names):
        names[w] = i
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if texts else np.zeros(0, np.int64)
    ids = np.empty(int(sizes.sum()) + len(texts), np.int32)
    for k, (t, a) in enumerate(zip(texts, firsts.tolist())):
        ids[a : a + len(t)] = np.fromiter(map(names.__getitem__, t), np.int32, len(t))
        ids[a + len(t)] = -1 - k
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(ids, int(sizes.max(initial=0)))
    owners = np.searchsorted(firsts, np.array([s for s, _, _ in found], np.int64), "right") - 1
    for (start, length, p), k in zip(found, owners.tolist()):
        out[k].append((start - int(firsts[k]), length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(text), bool)
    for start, length, p in runs:
        keep[start + p : start + length] = False
    return b" ".join(compress(text, keep.tolist())) if runs else b" ".join(text)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, runs, best, collapsed.

    runs: (start, length, period) of each run by start, then period; a run is a
    longest stretch of words with that smallest period, at least MIN_PERIODS of
    them and MIN_WORDS words; start is a word number from 0. best: the run with
    the greatest length/period, of equal ones the first, then that of the least
    period; null without runs. collapsed: the words but for those that come after
    the first period of some run, joined by one space.

    Null and empty texts have no runs and an empty collapsed text; nulls in
    doc_id stay; repeated rows each give a row; texts may be of any length, the
    memory of a task grows with its longest text only; extra columns, whatever
    their names, don't matter; an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: dict(zip(("start", "length", "period"), r))

    def whole(batches):
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in b.column(1)]
            found = _batch_runs(texts)
            best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in found]
            arrays = [
                b.column(0),
                pa.array([[named(x) for x in r] for r in found], pa.list_(run)),
                pa.array([x and named(x) for x in best], run),
                pa.array([_collapse(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts, found)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "runs", "best", "collapsed"])

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(tidy(whole), f"doc_id {kind}, runs array<{one}>, best {one}, collapsed string")


def plant_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text: with h the CRC-32 of the decimal doc_id, each tenth document (h % 10 = 0) that has words repeats from some word on.

    With n words and g = h div 10, every word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Texts so changed are
    joined by one space; rows without a doc_id, and texts without words, stay.
    """
    rows = pick(docs, "doc_id", text).toDF("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(F.lit(0), (n - a - 1).cast("int")), lambda i: F.get(w, (a + i % p).cast("int"))))

    rows = rows.withColumn("__w", F.when(chosen, words(F.col("text"))))
    return rows.select("doc_id", F.when(F.size("__w") > 0, F.array_join(repeated(F.col("__w")), " ")).otherwise(F.col("text")).alias("text"))

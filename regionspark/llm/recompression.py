"""Exact substring dedup by recompression.

Recompression shortens a sequence in rounds. A round first replaces each
maximal run of one symbol by a name of (symbol, length), then each adjacent
pair whose first symbol is a left one and whose second is a right one by a name
of the pair. Names are made from what they stand for, and whether a symbol is
left or right from its name, so every task gives the same name to the same run
or pair without a dictionary, and equal substrings are parsed alike except for
at most two symbols at either end of each level.

A window's canonical form therefore consists of the symbols that its two ends
lose on each level and the high-level symbols left inside. Two windows hold the
same words if and only if these forms are equal, wherever they stand. The form
is folded into the window's name, so long repeats show up as shared names:

1. Tasks parse their documents, name every window, keep one row per distinct
   name (with its least doc_id) and settle repeats among their own documents.
2. Names meet by their leading bits. Copies of a common passage arrive once a
   task, not once a document; of each name all but the least doc_id are marked.
3. Marks return to their documents, which are parsed again: the marked names
   are found among the document's own windows and their words are removed.

The words are counted first, and names are as long as that number needs: with
n windows at most 0.01 wrong merges are expected in all of them, at any n.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, pick, tidy

WINDOW = 13
LEVELS = 2
#: Bytes of text parsed at a time, and windows collected before they are sent.
PIECE = 2 << 20
FLUSH = 2_000_000
#: Bytes of text that meet in one group of the last step.
GROUP = 16 << 20

_U = np.uint64
# multipliers of the 64-bit mixing function (fixed values) and of the folds (any odd numbers)
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_P = 0x2545F4914F6CDD1D
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1024), _U(base))
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def word_names(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(name of each word, number of its text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = ~_WS[data]
    edge = np.diff(np.concatenate([[False], solid]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    letters = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64)
    values = letters[data[solid]] * _powers(_P, int(length.max()))[np.arange(int(length.sum())) - np.repeat(first, length)]
    names = _mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _A)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return names, np.searchsorted(ends, start, side="right")


class Level:
    """One round over a sequence of symbols; doc says whose they are, for nothing joins over its border."""

    def __init__(self, sym: np.ndarray, doc: np.ndarray, number: int):
        n = len(sym)
        new = np.ones(n, bool)
        new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        self.sym = sym
        self.run_of = np.cumsum(new) - 1
        self.run_start = np.flatnonzero(new)
        self.run_end = np.append(self.run_start[1:], n)
        length = (self.run_end - self.run_start).astype(np.uint64)
        first = sym[self.run_start]
        self.run = np.where(length > 1, _mix(first * _A + length * _B + _U(2 * number + 1)), first)
        self.left = (_mix(self.run + _U(number * int(_C) % (1 << 64))) & _U(1)).astype(bool)
        owner = doc[self.run_start]
        second = np.zeros(len(self.run), bool)
        second[1:] = self.left[:-1] & ~self.left[1:] & (owner[1:] == owner[:-1])
        self.phrase_of = np.cumsum(~second) - 1
        head = np.flatnonzero(~second)
        has = np.append(second[1:], False)[head]
        after = self.run[np.minimum(head + 1, len(self.run) - 1)]
        self.phrases = np.where(has, _mix(self.run[head] * _B + _mix(after) * _C + _U(2 * number + 2)), self.run[head])
        self.owner = owner[head]


def parse(sym: np.ndarray, doc: np.ndarray, levels: int) -> tuple[list[Level], np.ndarray]:
    """The levels and the symbols above the last of them."""
    found = []
    for k in range(levels):
        found.append(Level(sym, doc, k))
        sym, doc = found[-1].phrases, found[-1].owner
    return found, sym


def window_names(sym: np.ndarray, doc: np.ndarray, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of every window of `window` words inside one document."""
    if len(sym) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[window - 1 :] == doc[: len(doc) - window + 1])
    if not len(start):
        return start, np.zeros(0, np.uint64)
    rounds, top = parse(sym, doc, levels)
    a, b = start, start + window
    name = np.full(len(start), _U(window))

    def fold(name, symbol, count):
        return _mix(name * _A + symbol * _B + count.astype(np.uint64) * _C)

    for lv in rounds:
        some = a < b
        a, b = np.where(some, a, 0), np.where(some, b, 1)
        ra, rb = lv.run_of[a], lv.run_of[b - 1]
        # the runs at both ends may go on outside: they leave with the length seen here
        name = fold(name, np.where(some, lv.sym[lv.run_start[ra]], _U(0)), np.where(some, np.minimum(lv.run_end[ra], b) - a, 0))
        two = some & (ra != rb)
        name = fold(name, np.where(two, lv.sym[lv.run_start[rb]], _U(0)), np.where(two, b - lv.run_start[rb], 0))
        x, y = ra + 1, np.where(two, rb, ra + 1)
        # a right symbol may pair with the run before it, a left one with the run after it
        at = np.minimum(x, len(lv.run) - 1)
        pop = (x < y) & ~lv.left[at]
        name = fold(name, np.where(pop, lv.run[at], _U(0)), pop)
        x = x + pop
        at = np.maximum(y - 1, 0)
        pop = (x < y) & lv.left[at]
        name = fold(name, np.where(pop, lv.run[at], _U(0)), pop)
        y = y - pop
        inside = x < y
        a = np.where(inside, lv.phrase_of[np.minimum(x, len(lv.run) - 1)], 0)
        b = np.where(inside, lv.phrase_of[np.maximum(y - 1, 0)] + 1, 0)
    power, back = _powers(_P, len(top) + 1), _powers(pow(_P, -1, 1 << 64), len(top) + 1)
    prefix = np.concatenate([[_U(0)], np.cumsum(_mix(top) * power[:-1], dtype=np.uint64)])
    core = (prefix[b] - prefix[a]) * back[a]
    return start, fold(name, core, b - a)


class Plan:
    """How many leading bits choose where a name is sent, and how many bytes of it follow."""

    def __init__(self, n_words: int, n_bytes: int, window: int, levels: int):
        n = max(n_words, 1 << 16)  # there are no more windows than words
        self.window, self.levels = window, levels
        self.bucket_bits = min(max(round(math.log2(n / (1 << 14))), 4), 24)
        self.rest = max(1, math.ceil((2 * math.log2(n) - 1 + math.log2(100) - self.bucket_bits) / 8))
        self.groups = max(1, math.ceil(n_bytes / GROUP))

    @property
    def wide(self) -> bool:
        return self.bucket_bits + 8 * self.rest > 64

    def names(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word in it, name, low half of the name if one word is too short else zeros)."""
        sym, doc = word_names(texts, 11)
        at, name = window_names(sym, doc, self.window, self.levels)
        low = np.zeros(len(at), np.uint64)
        if self.wide:
            low = window_names(word_names(texts, 12)[0], doc, self.window, self.levels)[1]
            keep = 8 * self.rest - (64 - self.bucket_bits)
            low = low >> _U(max(0, 64 - keep))
        else:
            name = name >> _U(64 - self.bucket_bits - 8 * self.rest)
        owner = doc[at] if len(at) else np.zeros(0, np.int64)
        first = np.searchsorted(doc, np.arange(len(texts)))
        return owner, at - first[owner], name, low

    def bucket(self, name: np.ndarray) -> np.ndarray:
        bits = 64 if self.wide else self.bucket_bits + 8 * self.rest
        return (name >> _U(bits - self.bucket_bits)).astype(np.int64)


def _pack(doc: np.ndarray, name: np.ndarray, low: np.ndarray, plan: Plan) -> bytes:
    """doc ascending; the part of each name that its bucket does not tell."""
    step = np.diff(doc, prepend=doc[:1])
    top = int(step.max()) if len(step) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
    head = np.array([len(doc), width], "<i4").tobytes() + np.array(doc[:1], "<i8").tobytes()
    size = min(plan.rest, 8) if not plan.wide else 8
    rest = name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    return head + step.astype(f"<u{width}").tobytes() + rest + (low.astype("<u8").tobytes() if plan.wide else b"")


def _unpack(blob: bytes, plan: Plan, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = np.frombuffer(blob, "<i4", 2)
    n, width = int(n), int(width)
    doc = np.frombuffer(blob, "<i8", 1, 8) + np.cumsum(np.frombuffer(blob, f"<u{width}", n, 16).astype(np.int64))
    size = min(plan.rest, 8) if not plan.wide else 8
    at = 16 + n * width
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
    name = raw.view("<u8").ravel().astype(np.uint64)
    if not plan.wide:
        name = (name & _U((1 << (8 * plan.rest)) - 1)) | (_U(bucket) << _U(8 * plan.rest))
    low = np.frombuffer(blob, "<u8", n, at + n * size).astype(np.uint64) if plan.wide else np.zeros(n, np.uint64)
    return doc, name, low


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64) + _A) % _U(groups)).astype(np.int64)


def _stamp(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def _ordered(name: np.ndarray, low: np.ndarray, wide: bool) -> np.ndarray:
    return np.lexsort((low, name)) if wide else np.argsort(name, kind="stable")


def _heads(name: np.ndarray, low: np.ndarray) -> np.ndarray:
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (low[1:] != low[:-1])
    return new


def _spans(row: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words that windows at pos cover, overlapping ones joined."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + window)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], pos[at], pos[last] + window


def _pieces(ids: Iterator, texts: Iterator) -> Iterator[tuple[list, list[bytes]]]:
    keys, part, size = [], [], 0
    for i, t in zip(ids, texts):
        keys.append(i)
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= PIECE:
            yield keys, part
            keys, part, size = [], [], 0
    if keys:
        yield keys, part


_SENT = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])


def _send(plan: Plan):
    """Documents -> a row for each bucket with the task's distinct names, and spans already settled."""

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            doc, row, pos, name, low = (np.concatenate(x) for x in zip(*(h[:5] for h in held)))
            stamps = np.concatenate([h[5] for h in held])
            doc_of = np.concatenate([h[6] for h in held])
            order = _ordered(name, low, plan.wide)
            doc, row, pos, name, low = doc[order], row[order], pos[order], name[order], low[order]
            new = _heads(name, low)
            at = np.flatnonzero(new)
            least = np.minimum.reduceat(doc, at)
            later = doc > np.repeat(least, np.diff(np.append(at, len(doc))))
            keys, kinds, blobs = [], [], []
            name, low = name[at], low[at]
            bucket = plan.bucket(name)
            order = np.lexsort((least, bucket))
            bucket, name, low, least = bucket[order], name[order], low[order], least[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for s, e in zip(cut, np.append(cut[1:], len(bucket))):
                keys.append(int(bucket[s]))
                kinds.append(0)
                blobs.append(_pack(least[s:e], name[s:e], low[s:e], plan))
            if later.any():
                r, s, e = _spans(row[later], pos[later], plan.window)
                group = _group_of(doc_of[r], plan.groups)
                table = np.stack([doc_of[r], stamps[r], s, e], axis=1).astype("<i8")
                order = np.argsort(group, kind="stable")
                group, table = group[order], table[order]
                cut = np.flatnonzero(np.diff(group, prepend=-1))
                for s, e in zip(cut, np.append(cut[1:], len(group))):
                    keys.append(-1 - int(group[s]))
                    kinds.append(1)
                    blobs.append(table[s:e].tobytes())
            for i in range(0, len(keys), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2048], pa.int64()), pa.array(kinds[i : i + 2048], pa.int8()), pa.array(blobs[i : i + 2048], pa.binary())], schema=_SENT)

        rows = 0
        for b in batches:
            for ids, texts in _pieces((x.as_py() for x in b.column(0)), (x.as_py() for x in b.column(1))):
                ids = np.array(ids, np.int64)
                owner, pos, name, low = plan.names(texts)
                held.append((ids[owner], owner + rows, pos, name, low, np.array([_stamp(t) for t in texts], np.int64), ids))
                rows += len(ids)
                count += len(pos)
                if count >= FLUSH:
                    yield from flush()
                    held, count, rows = [], 0, 0
        if count:
            yield from flush()

    return run


_MARKED = "grp long, kind byte, payload binary"


def _mark(plan: Plan):
    """All rows of a bucket -> its marked (doc, name), by group of documents; settled spans pass."""

    def run(key, table):
        bucket = key[0].as_py()
        out_group, out_kind, out = [], [], []
        blobs = table.column("payload").to_pylist()
        if bucket < 0:
            out_group, out_kind, out = [-1 - bucket] * len(blobs), [1] * len(blobs), blobs
        else:
            doc, name, low = (np.concatenate(x) for x in zip(*(_unpack(x, plan, bucket) for x in blobs)))
            order = _ordered(name, low, plan.wide)
            doc, name, low = doc[order], name[order], low[order]
            at = np.flatnonzero(_heads(name, low))
            size = np.diff(np.append(at, len(doc)))
            marked = doc > np.repeat(np.minimum.reduceat(doc, at), size)
            doc, name, low = doc[marked], name[marked], low[marked]
            group = _group_of(doc, plan.groups)
            order = np.lexsort((doc, group))
            doc, name, low, group = doc[order], name[order], low[order], group[order]
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for s, e in zip(cut, np.append(cut[1:], len(group))):
                out_group.append(int(group[s]))
                out_kind.append(0)
                out.append(np.array([bucket], "<i8").tobytes() + _pack(doc[s:e], name[s:e], low[s:e], plan))
        return pa.table([pa.array(out_group, pa.int64()), pa.array(out_kind, pa.int8()), pa.array(out, pa.binary())], names=["grp", "kind", "payload"])

    return run


def _remove(plan: Plan):
    """A group's documents and marks -> what is left of each document."""

    def run(left, right):
        ids, texts = left.column("doc_id"), left.column("text")
        marks, spans = [], []
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist()):
            if kind:
                spans.append(np.frombuffer(blob, "<i8").reshape(-1, 4))
            else:
                marks.append(_unpack(blob[8:], plan, int(np.frombuffer(blob, "<i8", 1)[0])))
        mdoc, mname, mlow = (np.concatenate(x) for x in zip(*marks)) if marks else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        wanted = np.unique(_mix(mdoc.view(np.uint64) * _A + mname) ^ _mix(mlow + _B))
        touched = set(mdoc.tolist())
        settled: dict[tuple[int, int], list] = {}
        for t in spans:
            for d, stamp, s, e in t.tolist():
                settled.setdefault((d, stamp), []).append((s, e))
        known = {d for d, _ in settled}
        n_words, n_removed, kept = [], [], []
        for keys, part in _pieces((x.as_py() for x in ids), (x.as_py() for x in texts)):
            found: dict[int, list] = {}
            redo = [k for k, i in enumerate(keys) if i in touched]
            if redo:
                owner, pos, name, low = plan.names([part[k] for k in redo])
                doc = np.array([keys[k] for k in redo], np.int64)[owner]
                mine = _mix(doc.view(np.uint64) * _A + name) ^ _mix(low + _B)
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine) if len(mine) else []
                if len(hit):
                    for r, s, e in zip(*(x.tolist() for x in _spans(owner[hit], pos[hit], plan.window))):
                        found.setdefault(redo[r], []).append((s, e))
            for k, (i, t) in enumerate(zip(keys, part)):
                words = t.split()
                cover = found.get(k, [])
                if i in known:
                    cover = cover + settled.get((i, _stamp(t)), [])
                n_words.append(len(words))
                if cover:
                    keep = np.ones(len(words), bool)
                    for s, e in cover:
                        keep[s:e] = False
                    words = list(itertools.compress(words, keep.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.table([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    Every word in a window of `window` words whose sequence also starts in a
    document with a smaller doc_id is removed; windows are judged on the input.
    kept_text joins the rest by single spaces. Repeats inside one document, and
    rows with the same doc_id, do not count against each other. A null or empty
    text, or one shorter than the window, keeps all it has; a null doc_id is
    neither smaller nor larger than any, so its row keeps all. Texts may be of any
    length; extra columns don't matter. An empty table gives no rows. `levels` may be any number; more than 2 leave a window of 13
    words nothing to parse.
    """
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.sum(F.octet_length("text").cast("long"))).first()
    plan = Plan(size[0] or 0, size[1] or 0, window, levels)
    sent = rows.where("doc_id is not null and text is not null").mapInArrow(tidy(_send(plan)), "key long, kind byte, payload binary")
    marks = sent.groupBy("key").applyInArrow(_mark(plan), _MARKED)

    def place(batches):
        for b in batches:
            doc = np.array(b.column(0).fill_null(0))
            for k in np.flatnonzero(np.asarray(b.column(0).is_null())):
                doc[k] = _stamp((b.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass"))  # no mark waits for these; anywhere will do
            yield pa.RecordBatch.from_arrays([pa.array(_group_of(doc, plan.groups)), b.column(0), b.column(1)], names=["grp", "doc_id", "text"])

    placed = rows.mapInArrow(place, "grp long, doc_id long, text string")
    return placed.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(_remove(plan), "doc_id long, n_words long, n_removed long, kept_text string")

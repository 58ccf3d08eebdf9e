"""Token ids as flat binary shards, with 64-bit document offsets, read back memory-mapped.

A shard holds the documents of one range of doc_id in ascending order:
``<shard>.ids`` is their ids end to end, unsigned little-endian integers (16
bits if the vocabulary fits, else 32); ``<shard>.idx`` is the magic
``TOKIDX02``, the id width, the number of documents n, how many of them, the
last ones, have no doc_id, and the shard's number as four int64, then n + 1
int64 offsets in ids and n int64 doc_ids.
The shards' bases are the prefix sums of their id counts.

Executors write shards under names of their own attempt, and only the rows that
finished tasks return name the shards that count; a lost or repeated task leaves
a file that nothing refers to.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, pick, scratch, shuffle_partitions, tidy, worker_memory

MAGIC = b"TOKIDX02"
END_ID = 2
#: Unicode White_Space (fixed value). Byte-level pre-tokenization never joins a character
#: before one of these to it, so a text may be cut before each run of them.
_SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))
#: Letters that a piece may end with where white space or ASCII punctuation follows: a run of letters
#: is never joined to either, so "word," and "word" share a piece.
_LETTER = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_PIECES = re.compile(f"[{_SPACE}]*[{_LETTER}]+(?=[{_SPACE}!-/:-@\\[-`{{-~]|\\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Bytes of a worker's memory of encoded pieces, which starts anew when full; pieces of more characters are not remembered.
CACHE_BYTES, LONG = 64 << 20, 256
#: New pieces that are encoded as one text; they can be told apart again by their bytes.
TOGETHER = 200


class PieceEncoder:
    """Encodes whole texts with a byte-level tokenizer, each distinct piece once.

    The tokenizer sees every distinct piece; only repeats are looked up. Ids
    are kept as bytes of the file's integer type.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        # a byte-level token has a character for each of its bytes
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        known, kind = self.known, f"<u{self.width}"
        # a piece of white space and then others follows any other piece without changing its ids
        plain = [p for p in new if p[0] in _SPACES and p[-1] not in _SPACES and not any(s in p for s in self.special)]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for i in range(0, len(groups), 64):
            part = groups[i : i + 64]
            for g, e in zip(part, self.tokenizer.encode_batch_fast(["".join(g) for g in part], add_special_tokens=False)):
                ids = np.array(e.ids)
                ends = np.cumsum(self.bytes[ids])
                cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in g]), side="left") + 1
                raw = ids.astype(kind).tobytes()
                start = 0
                for p, stop in zip(g, (cuts * self.width).tolist()):
                    known[p] = raw[start:stop]
                    start = stop
        rest = list(set(new).difference(plain))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[p] = np.array(e.ids, kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        pieces = [_PIECES.findall(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = set(itertools.chain.from_iterable(pieces)).difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known
        out = [b"".join(map(known.__getitem__, ps)) for ps in pieces]
        for p in new:
            if len(p) > LONG:
                del known[p]
            else:
                # an entry's share of the table takes some 100 bytes
                self.held += sys.getsizeof(p) + sys.getsizeof(known[p]) + 100
        return out


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 1 << 19) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of a task's rows, some characters at a time."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def write_token_shards(docs: DataFrame, out_dir: str, tokenizer: str, text: str = "text", end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write docs as shards under out_dir; returns their manifest (shard, ids_path, idx_path, n_docs, n_ids, width, base).

    Null texts are empty, an empty document is its end id alone, rows with a
    null doc_id come last, equal doc_ids (and null ones) follow each other in an
    order that their texts fix, and an empty table has an empty manifest. Texts
    may be of any length; extra columns don't matter. The path of the
    tokenizer's file must exist on every executor.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    # the hash spreads many rows of one id, or without one, over ranges
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc = worker_memory(f"pieces of {tokenizer}", lambda: PieceEncoder(tokenizer))
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        stem = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        width = max(enc.width, 2 if end_id < 1 << 16 else 4)
        end = np.array([end_id], f"<u{width}").tobytes()
        lengths, keys, missing = [], [], 0
        sink = None
        for ids, texts in _blocks(batches):
            if sink is None:
                sink = store.open_output_stream(f"{stem}.ids")
            encoded = enc.encode(texts)
            if width != enc.width:
                encoded = [np.frombuffer(e, f"<u{enc.width}").astype(f"<u{width}").tobytes() for e in encoded]
            lengths.append(np.fromiter((len(e) // width + 1 for e in encoded), np.int64, len(encoded)))
            missing += ids.count(None)
            keys.append(np.array([0 if i is None else i for i in ids], np.int64))
            sink.write(end.join(encoded) + end)
        if sink is None:
            return
        sink.close()
        length, key = np.concatenate(lengths), np.concatenate(keys)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype("<i8")
        with store.open_output_stream(f"{stem}.idx") as f:
            f.write(MAGIC + np.array([width, len(key), missing, shard], "<i8").tobytes() + offsets.tobytes() + key.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "ids_path": [f"{stem}.ids"], "idx_path": [f"{stem}.idx"], "n_docs": [len(key)], "n_ids": [int(offsets[-1])], "width": [width]},
            schema=pa.schema([("shard", pa.int64()), ("ids_path", pa.string()), ("idx_path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int64())]),
        )

    manifest = rows.mapInArrow(tidy(write), "shard long, ids_path string, idx_path string, n_docs long, n_ids long, width long")
    # written once: what later jobs read are the files of the attempts that this write saw finish
    manifest = materialize(manifest, "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _open(store, path: str) -> np.ndarray:
    """A file's bytes: memory-mapped where the store is a file system of this machine, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def read_token_shards(manifest: DataFrame, out_dir: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the unsigned
    CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession

    def read(batches):
        store, _ = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for row in b.to_pylist():
                idx = _open(store, row["idx_path"])
                if idx[:8].tobytes() != MAGIC:
                    raise ValueError(f"{row['idx_path']}: not an index of token ids")
                width, n, missing, _ = (int(x) for x in idx[8:40].view("<i8"))
                offsets, keys = idx[40 : 48 + 8 * n].view("<i8"), idx[48 + 8 * n : 48 + 16 * n].view("<i8")
                ids = _open(store, row["ids_path"]).view(f"<u{width}")
                if len(ids) != offsets[-1]:
                    raise ValueError(f"{row['ids_path']}: {len(ids)} ids, its index says {offsets[-1]}")
                for at in range(0, n, 8192):
                    o = offsets[at : at + 8193]
                    block = ids[o[0] : o[-1]].astype("<u4")
                    crc = [zlib.crc32(block[a - o[0] : z - o[0]]) for a, z in zip(o[:-1], o[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(keys[at : at + 8192]), mask=np.arange(at, at + len(crc)) >= n - missing), pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(shuffle_partitions(spark), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_binary(docs: DataFrame, tokenizer: str, out_dir: str | None = None, **options) -> tuple[DataFrame, DataFrame, str]:
    """Write and reread: (documents, manifest, folder); the documents are as read_token_shards gives them, a row per row of docs.

    Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns are as in write_token_shards.
    """
    out_dir = out_dir or scratch(docs.sparkSession, "token-ids")
    manifest = write_token_shards(docs, out_dir, tokenizer, **options)
    return read_token_shards(manifest, out_dir), manifest, out_dir

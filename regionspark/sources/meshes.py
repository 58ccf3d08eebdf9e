"""The binary mesh format and its batch container.

A mesh is a 32-byte header - magic TKMS, version, flags, vertex and index
counts, box - then float32 x, y of the vertices and 16- or 32-bit indices, all
little-endian. A batch is magic TKMB, version, flags, numbers of found and
missing ids, a table of contents in id order, then the meshes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the format
MAGIC, BATCH_MAGIC, VERSION, WIDE_INDICES, ZIPPED = b"TKMS", b"TKMB", 1, 1, 1
HEADER = "<4sHHIIffff"
BATCH_HEADER = "<4sHHII"
HEADER_SIZE, BATCH_HEADER_SIZE = 32, 16
MAX_NARROW = 65_535


class MeshError(ValueError):
    """Bytes that are no mesh, or numbers that cannot become one."""


def clockwise(vertices: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Triangles (k, 3) turned clockwise; one without area is an error."""
    a, b, c = (vertices[triangles[:, i]] for i in range(3))
    cross = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    if (cross == 0).any():
        raise MeshError("a triangle has no area")
    out = triangles.copy()
    turn = cross > 0
    out[turn, 1], out[turn, 2] = triangles[turn, 2], triangles[turn, 1]
    return out


def encode(vertices: np.ndarray, triangles: np.ndarray) -> bytes:
    """vertices (n, 2), triangles (k, 3)."""
    v, t = np.asarray(vertices, np.float64), np.asarray(triangles)
    if v.ndim != 2 or v.shape[1] != 2 or len(v) < 3 or not np.isfinite(v).all():
        raise MeshError("a mesh needs three finite vertices or more")
    if t.ndim != 2 or t.shape[1] != 3 or not len(t) or not np.issubdtype(t.dtype, np.integer) or t.min() < 0 or t.max() >= len(v):
        raise MeshError("indices are not whole triangles of the vertices")
    stored = v.astype("<f4")
    t = clockwise(stored.astype(np.float64), t.astype(np.int64))
    wide = len(v) > MAX_NARROW
    low, high = stored.min(axis=0), stored.max(axis=0)
    head = struct.pack(HEADER, MAGIC, VERSION, WIDE_INDICES if wide else 0, len(v), t.size, low[0], low[1], high[0], high[1])
    return head + stored.tobytes() + t.astype("<u4" if wide else "<u2").tobytes()


def decode(payload: bytes, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(vertices float32, triangles); bytes after the mesh are left alone, unknown flags are ignored."""
    if len(payload) < HEADER_SIZE:
        raise MeshError("too short for a header")
    magic, version, flags, n, m, *box = struct.unpack_from(HEADER, payload)
    if magic != MAGIC or version != VERSION or n < 3 or m < 3 or m % 3:
        raise MeshError("not a mesh of this version")
    width = 4 if flags & WIDE_INDICES else 2
    if len(payload) < HEADER_SIZE + 8 * n + width * m:
        raise MeshError("shorter than its header says")
    v = np.frombuffer(payload, "<f4", 2 * n, HEADER_SIZE).reshape(n, 2)
    t = np.frombuffer(payload, f"<u{width}", m, HEADER_SIZE + 8 * n).reshape(-1, 3).astype(np.int64)
    if not np.isfinite(v).all() or t.max() >= n or not np.array_equal(np.float32(box), np.concatenate([v.min(axis=0), v.max(axis=0)])):
        raise MeshError("vertices, indices or box are wrong")
    if strict and not np.array_equal(clockwise(v.astype(np.float64), t), t):
        raise MeshError("a triangle is not clockwise")
    return v, t


def payload_length(n_vertices: Column, n_indices: Column) -> Column:
    return F.lit(32) + n_vertices * 8 + n_indices * F.when(n_vertices > MAX_NARROW, 4).otherwise(2)


def encode_batch(found: dict[str, bytes], missing: list[str], zipped: bool = False) -> bytes:
    """Entries and missing ids in id order; offsets count from the first entry's first byte and are 32 bits."""
    import gzip

    ids = sorted(found, key=lambda i: i.encode())
    body = [gzip.compress(found[i], 9, mtime=0) if zipped else found[i] for i in ids]
    starts = np.cumsum([0, *map(len, body)])
    if starts[-1] > 0xFFFFFFFF:
        raise MeshError("batch_too_large")
    gone = sorted({i.encode() for i in missing})
    head = [struct.pack(BATCH_HEADER, BATCH_MAGIC, VERSION, ZIPPED if zipped else 0, len(ids), len(gone))]
    head += [struct.pack("<H", len(i.encode())) + i.encode() + struct.pack("<II", at, len(x)) for i, at, x in zip(ids, starts.tolist(), body)]
    head += [struct.pack("<H", len(i)) + i for i in gone]
    return b"".join([*head, *body])


def decode_batch(payload: bytes) -> tuple[dict[str, bytes], list[str]]:
    import gzip

    if len(payload) < BATCH_HEADER_SIZE:
        raise MeshError("too short for a batch")
    magic, version, flags, n, m = struct.unpack_from(BATCH_HEADER, payload)
    if magic != BATCH_MAGIC or version != VERSION:
        raise MeshError("not a batch of this version")
    at, entries, missing = BATCH_HEADER_SIZE, [], []
    try:
        for k in range(n + m):
            (size,) = struct.unpack_from("<H", payload, at)
            name = payload[at + 2 : at + 2 + size].decode()
            at += 2 + size
            if k < n:
                entries.append((name, *struct.unpack_from("<II", payload, at)))
                at += 8
            else:
                missing.append(name)
    except struct.error:
        raise MeshError("the table of contents is cut off") from None
    found = {}
    for name, start, length in entries:
        if at + start + length > len(payload):
            raise MeshError(f"{name} lies outside the batch")
        raw = payload[at + start : at + start + length]
        found[name] = gzip.decompress(raw) if flags & ZIPPED else raw
    return found, missing


def batch_meshes(requested: DataFrame, meshes: DataFrame, zipped: bool = False) -> DataFrame:
    """requested (batch, id), meshes (id, payload) -> batch, container: found ones and what is missing.

    A batch has at most some hundred ids (requests are cut to that), so a group is small.
    """
    wanted = requested.select("batch", "id").distinct().join(meshes.select("id", "payload"), "id", "left")

    def pack(key, table):
        rows = zip(table.column("id").to_pylist(), table.column("payload").to_pylist())
        found, missing = {}, []
        for i, x in rows:
            if x is None:
                missing.append(i)
            else:
                found[i] = x
        return pa.table({"batch": pa.array([key[0].as_py()], key[0].type), "container": pa.array([encode_batch(found, missing, zipped)], pa.binary())})

    kind = requested.schema["batch"].dataType.simpleString()
    return wanted.groupBy("batch").applyInArrow(pack, f"batch {kind}, container binary")


def encode_meshes(meshes: DataFrame) -> DataFrame:
    """territory, vertices array<struct<x,y>>, indices array<int> -> territory, payload."""

    def run(batches):
        for b in batches:
            out = []
            for vs, ix in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.append(encode(np.array([(p["x"], p["y"]) for p in vs]), np.array(ix, np.int64).reshape(-1, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["territory", "payload"])

    return meshes.select("territory", "vertices", "indices").mapInArrow(run, "territory string, payload binary")


def mesh_triangles(payloads: DataFrame) -> DataFrame:
    """territory, payload -> a row per triangle: territory, tri, ax, ay, bx, by, cx, cy."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, t = decode(raw)
                p = v.astype(np.float64)[t].reshape(len(t), 6)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(np.arange(len(t))), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(6)]], names=["territory", "tri", "ax", "ay", "bx", "by", "cx", "cy"])

    return payloads.select("territory", "payload").mapInArrow(run, "territory string, tri long, ax double, ay double, bx double, by double, cx double, cy double")

"""The prefix trie of conversations: which beginnings they share, and what sharing them saves.

Distinct turns (role and text) get dense ids, so a conversation is an array of
ids; equal conversations are one record with a multiplicity. The records are
partitioned by the most significant digit first: those of a bucket share all turns
up to its depth and split by the next one. A bucket of more than LOCAL_TURNS turns
is a node that Spark keeps ("large"): its records go on to the next round, after the
longest beginning that all of them share, which is that of its least and its
greatest array; so rounds count branchings, not turns. All other buckets are local:
a task finishes each by multikey quicksort (less, equal, greater by the id at one
depth), whose equal parts are the nodes below.

Sums over subtrees meet in one aggregation: every local bucket and every large
node adds what it holds to each large node above it. Texts are never shuffled,
only their SHA-256 keys, ids and lengths.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, materialize, pick, shuffle_partitions, tidy

#: A bucket of more turns than this, and more than one record, is split by Spark.
LOCAL_TURNS = 1 << 14
#: Conversation ids that are hashed as one piece.
PIECE = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [c.split()[0] for c in NODE.split(", ")]
_NOBODY = hashlib.sha256(b"").hexdigest()


def encode_turns(turns: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, ids, chars: a row per conversation, its turns in order as dense ids with the code points of their texts.

    The dictionary is exact as far as SHA-256 tells contents apart. Turns go by
    `turn`, null first, ties by role and then by content's key. Rows without a
    conv_id are left out: they belong to no conversation.
    """
    rows = pick(turns, "conv_id", "turn", "role", text).toDF("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, said = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, said).cast("binary"), 256))
    keyed = materialize(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.char_length(said).alias("chars")), "trie-turns")
    n = shuffle_partitions(turns.sparkSession)
    known = keyed.groupBy("key").agg(F.first("chars").alias("chars")).select("key", F.pmod(F.xxhash64("key"), F.lit(8 * n)).alias("bucket"))
    sizes = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("key")))
    ids = ranked.join(base, "bucket").select("key", (F.col("base") + F.col("rank")).alias("id"))
    return (
        keyed.join(ids, "key")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "id", "chars"))).alias("t"))
        .select("conv_id", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"))
    )


def rebuild(encoded: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of c - c % every in place of its own first h, h = CRC-32 of the decimal c, modulo heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % every
    own = encoded.select("conv_id", "ids", "chars", first.alias("first"), h.alias("h"))
    lead = encoded.where(first == F.col("conv_id")).select(F.col("conv_id").alias("first"), *[F.slice(c, 1, heads - 1).alias(f"lead_{c}") for c in ("ids", "chars")])
    joined = own.join(lead, "first", "left")

    def together(c: str) -> Column:
        lead = F.coalesce(F.col(f"lead_{c}"), F.array().cast(encoded.schema[c].dataType))
        return F.concat(F.slice(lead, F.lit(1), F.col("h")), F.slice(F.col(c), F.col("h") + 1, F.size(c))).alias(c)

    return joined.select("conv_id", together("ids"), together("chars"))


def _end_digests(members: DataFrame) -> DataFrame:
    """k, digest: SHA-256 of the decimal conv_ids of each k, ascending, comma-joined.

    A range sort by k and conv_id splits even a k that most rows have; its ids
    are joined to pieces there, and only pieces meet in one task, as a stream.
    """
    ordered = members.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id")

    def pieces(batches):
        rows = ((k, c) for b in batches for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        out = []
        for k, group in itertools.groupby(rows, key=lambda r: r[0]):
            while part := list(itertools.islice(group, PIECE)):
                out.append((k, part[0][1], ",".join(str(c) for _, c in part)))
                if len(out) >= 256:
                    yield _batch(out, ("k", pa.binary()), ("first", pa.int64()), ("piece", pa.string()))
                    out = []
        yield _batch(out, ("k", pa.binary()), ("first", pa.int64()), ("piece", pa.string()))

    def digests(batches):
        rows = ((k, p) for b in batches for k, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        out = []
        for k, group in itertools.groupby(rows, key=lambda r: r[0]):
            sha, comma = hashlib.sha256(), b""
            for _, p in group:
                sha.update(comma + p.encode())
                comma = b","
            out.append((k, sha.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, ("k", pa.binary()), ("digest", pa.string()))
                out = []
        yield _batch(out, ("k", pa.binary()), ("digest", pa.string()))

    joined = ordered.mapInArrow(tidy(pieces), "k binary, first long, piece string")
    return joined.repartition("k").sortWithinPartitions("k", "first").mapInArrow(tidy(digests), "k binary, digest string")


def _batch(rows: list[tuple], *fields) -> pa.RecordBatch:
    schema = pa.schema(fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def multikey_nodes(records: list[tuple], depth: int, parent: int | None) -> list[list]:
    """The nodes of a bucket whose records share their first `depth` turns (depth >= 1), its top first.

    records: distinct (ids, chars, conv_id, n, digest). A node is a list in the
    order of NODE. The stack holds groups that share a beginning and are to be
    split by the id at one depth, or are the equal part of such a split: a node.
    """
    nodes: list[list] = []
    above: list[int | None] = []
    stack: list[tuple[list[tuple], int, int | None, bool]] = [(records, depth, None, True)]
    while stack:
        group, d, under, equal_part = stack.pop()
        if equal_part:
            ended = [r for r in group if len(r[0]) == d]
            n = sum(r[3] for r in group)
            above.append(under)
            nodes.append([min(r[2] for r in group), d, parent if under is None else nodes[under][0], n, 0, 0, (n - 1) * group[0][1][d - 1], ended[0][4] if ended else _NOBODY])
            if under is not None:
                nodes[under][4] += 1
            if len(ended) < len(group):
                stack.append(([r for r in group if len(r[0]) > d] if ended else group, d, len(nodes) - 1, False))
        else:
            pivot = group[len(group) // 2][0][d]
            less, equal, greater = [], [], []
            for r in group:
                (less if r[0][d] < pivot else greater if r[0][d] > pivot else equal).append(r)
            stack += [(part, d, under, False) for part in (greater, less) if part]
            stack.append((equal, d + 1, under, True))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        nodes[i][5] = nodes[i][5] or 1
        up = above[i]
        if up is not None:
            nodes[up][5] += nodes[i][5]
            nodes[up][6] += nodes[i][6]
    return nodes


def _finish(local: DataFrame) -> DataFrame:
    """All nodes of the local buckets; a bucket's top also carries `path`, the large nodes above it."""
    order = ["bucket", "next"]
    rows = local.select(*order, "depth", "parent", "path", "ids", "chars", "conv_id", "n", "digest").repartition(*order).sortWithinPartitions(*order)
    fields = [(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _NODE] + [("path", pa.list_(pa.int64()))]

    def whole(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(10))))
        out = []
        for _, group in itertools.groupby(rows, key=lambda r: (r[0], r[1])):
            group = list(group)
            _, _, depth, parent, path = group[0][:5]
            nodes = multikey_nodes([r[5:] for r in group], depth + 1, parent)
            out += [(*x, path if i == 0 else None) for i, x in enumerate(nodes)]
            if len(out) >= 4096:
                yield _batch(out, *fields)
                out = []
        yield _batch(out, *fields)

    return rows.mapInArrow(tidy(whole), f"{NODE}, path array<bigint>")


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the beginning."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def prefix_trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie over conv_id, ids, chars (see encode_turns), with the columns of NODE.

    A node is a distinct sequence of first turns; the textless root has depth 0.
    conv_id: its smallest member, which with the depth names it; n_leaves and
    saved_tokens are over its subtree, itself included: childless nodes, and
    (n_convs - 1) times the code points of a node's last text. ends_sha256: of the
    conv_ids that end there. Without conversations there are no nodes.
    """
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256))
    members = materialize(sequences.select("conv_id", "ids", "chars", key.alias("k")), "trie-members")
    distinct = members.groupBy("k").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("chars").alias("chars"))
    records = distinct.join(_end_digests(members), "k").select("ids", "chars", "conv_id", "n", "digest")
    # bucket: the number of a large node; -1 stands above the root, which is kept as large however small
    active = records.select("*", F.lit(-1).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("next"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<bigint>").alias("path"))
    active = materialize(active, "trie-active")
    larges: list[DataFrame] = []
    locals_: list[DataFrame] = []
    while True:
        groups = active.groupBy("bucket", "next").agg(
            F.min("conv_id").alias("conv"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("records"), F.sum(F.size("ids") - F.col("depth")).alias("turns"),
            F.min("ids").alias("least"), F.max("ids").alias("greatest"), F.first("depth").alias("above"), F.first("parent").alias("up"), F.first("path").alias("path"),
            F.min_by("chars", "ids").alias("chars"),
        )
        large = groups.where(((F.col("turns") > local_turns) & (F.col("records") > 1)) | (F.col("bucket") == -1))
        # unique numbers: 50 bits within a round, which are settled when they are written
        number = F.monotonically_increasing_id() + (len(larges) << 50)
        large = large.select("bucket", "next", number.alias("number"), "conv", "members", "above", "up", "path", _shared(F.col("least"), F.col("greatest")).alias("to"), "chars")
        large = materialize(large, "trie-large")
        if large.isEmpty():
            locals_.append(active)
            if not larges:  # no conversations
                larges.append(large.withColumn("digest", F.lit(None).cast("string")))
            break
        larges.append(large)
        mark = bounded(large.select("bucket", "next", "number", "conv", "to", F.col("path").alias("__path")))
        if len(larges) > 1:
            locals_.append(active.join(mark.select("bucket", "next"), ["bucket", "next"], "left_anti"))
        goes_on = active.join(mark, ["bucket", "next"]).select(
            "ids", "chars", "conv_id", "n", "digest", F.col("number").alias("bucket"), F.get("ids", F.col("to")).alias("next"), F.col("to").alias("depth"), F.col("conv").alias("parent"),
            F.concat("__path", F.array("number")).alias("path"),
        )
        active = materialize(goes_on, "trie-active")
        # a record without a next turn ends at the large node
        larges[-1] = larges[-1].join(active.where("next IS NULL").select(F.col("bucket").alias("number"), "digest"), "number", "left")
        active = active.where("next IS NOT NULL")
    local = locals_[0]
    for more in locals_[1:]:
        local = local.unionByName(more)
    small = materialize(_finish(local), "trie-local")
    large = larges[0]
    for more in larges[1:]:
        large = large.unionByName(more)
    chain = F.slice("chars", F.col("above") + 1, F.col("to") - F.col("above"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    large = large.withColumn("own", (F.col("members") - 1) * total(chain))
    tops = small.where("path IS NOT NULL")
    adds = tops.select(F.explode("path").alias("number"), "n_leaves", "saved_tokens", (F.element_at("path", -1) == F.col("number")).cast("long").alias("child"))
    up = large.select("number", "own", "path").where(F.size("path") > 0)
    adds = adds.unionByName(up.select(F.explode("path").alias("__over"), "own", "path").select(F.col("__over").alias("number"), F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"), (F.element_at("path", -1) == F.col("__over")).cast("long").alias("child")))
    below = adds.groupBy("number").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.sum("child").alias("children"))
    large = large.join(below, "number", "left")
    # a node for each depth of the stretch that all records share: the root, or those after the node above
    depths = F.sequence(F.when(F.col("bucket") == -1, F.lit(0)).otherwise(F.col("above") + 1), F.col("to"))
    last = F.col("depth") == F.col("to")
    nodes = large.withColumn("depth", F.explode(depths))
    rest = F.slice("chars", F.greatest(F.col("depth"), F.lit(1)), F.when(F.col("depth") == 0, F.col("to")).otherwise(F.col("to") - F.col("depth") + 1))
    nodes = nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("above") + 1, F.coalesce("up", "conv")).otherwise(F.col("conv")).cast("long").alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("members") - 1) * total(rest)).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("digest", F.lit(_NOBODY))).otherwise(F.lit(_NOBODY)).alias("ends_sha256"),
    )
    return nodes.unionByName(small.select(*_NODE))


def conversation_trie(turns: DataFrame, text: str = "text", local_turns: int = LOCAL_TURNS) -> DataFrame:
    """prefix_trie of the conversations as they are: turns has conv_id (an integer), turn, role and `text`.

    Null roles and texts are empty; rows without a conv_id are left out; ties
    in `turn` go by role and content; repeated rows are turns of their own; texts
    may be of any length; a conversation's ids and lengths, 12 bytes a turn, lie in
    one record; extra columns, whatever their names, don't matter; an empty table
    gives no rows.
    """
    return prefix_trie(encode_turns(turns, text), local_turns)

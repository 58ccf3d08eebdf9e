"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, mixing, periodic, pii, quality, recompression, simhash, tokenbin, toxicity, trie, viterbi
from ._common import pick, table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are on this machine; they are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    said = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["stop"].cast("string"))
    base = F.transform("spans", lambda s: said(s["kind"], s))
    added = F.transform("terms", lambda s: said(s["kind"], s))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.tokenize_to_binary(table(spark, sf_dir, "documents"), tokenizer_file())[0]


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_positions(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.plant_runs(table(spark, sf_dir, "documents")))
    listed = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A conversation whose texts look like markers and escapes.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HARD_TEXT))
    return chat.read_back(chat.format_conversations(turns.union(hard)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuild(trie.encode_turns(table(spark, sf_dir, "conversations"))))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op10_mixing by source."""
    docs = table(spark, sf_dir, "documents").select("source", mixing.n_words(F.col("text")).alias("size"))
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recompression": op1_recompression,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_ann": op4_ann,
    "op5_token_binary": op5_token_binary,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_prefix_trie": op13_prefix_trie,
    "mixing_targets": mixing_targets,
}

#: CRC-32 of a decimal id: over its characters, then eight steps a character.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))),
lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS UBIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS UBIGINT))"""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

#: The others need hashes, regular expression offsets, tokenizers or fits that SQL has not; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_recompression": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
spot AS MATERIALIZED (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM spot WHERE p + 12 <= len(ws)),
owner AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT doc_id, p FROM win JOIN owner USING (k) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM bad CROSS JOIN (SELECT unnest(range(0, 13)) AS j)),
word AS (SELECT spot.doc_id, spot.p, ws[spot.p] AS x, gone.p IS NOT NULL AS out FROM spot LEFT JOIN gone ON spot.doc_id = gone.doc_id AND spot.p = gone.p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT out) AS t FROM word GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": f"""
WITH iw AS (SELECT DISTINCT item_id, {_WORDS.format("lower(text)")} AS ws FROM benchmark),
ish AS (SELECT item_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS q, ws FROM iw WHERE len(ws) >= 5),
ih AS (SELECT item_id, n, array_to_string(ws[q:q + 4], ' ') AS h, count(*) AS times FROM ish GROUP BY ALL),
dw AS (SELECT DISTINCT doc_id, {_WORDS.format("lower(text)")} AS ws FROM documents),
dsh AS (SELECT doc_id, len(ws) AS nd, unnest(range(1, len(ws) - 3)) AS p, ws FROM dw WHERE len(ws) >= 5),
dh AS MATERIALIZED (SELECT doc_id, nd, p - 1 AS p, array_to_string(ws[p:p + 4], ' ') AS h FROM dsh),
hit AS (SELECT doc_id, item_id, n, p, h, times, least(n, nd) - 4 AS k, greatest(nd - n, 0) AS last FROM dh JOIN ih USING (h)),
place AS (SELECT doc_id, item_id, n, k, h, times, unnest(range(greatest(p - k + 1, 0), least(p, last) + 1)) AS s FROM hit),
wc AS (SELECT doc_id, item_id, n, k, s, h, times, count(*) AS c FROM place GROUP BY ALL),
sh AS (SELECT doc_id, item_id, n, k, s, CAST(sum(least(c, times)) AS BIGINT) AS n_shared FROM wc GROUP BY ALL),
sim AS (SELECT *, k + n - 4 - n_shared AS n_all, n_shared / (k + n - 4 - n_shared) AS similarity FROM sh),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim)
SELECT doc_id, item_id, n_shared, n_all, similarity, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words FROM best WHERE r = 1 AND similarity >= CAST(0.8 AS DOUBLE)""",
    # periods of which three neighbouring grid points match, then all their places, in stretches
    "op11_periodic_runs": f"""
WITH t AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws, CAST({_CRC32.format('doc_id')} AS BIGINT) AS h FROM documents),
m AS (SELECT *, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g FROM t),
k AS (SELECT *, h % 10 = 0 AND n > 0 AS chosen, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM m),
w AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN chosen AND i >= a THEN ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE ws[i + 1] END AS x
  FROM (SELECT *, unnest(range(0, n)) AS i FROM k)),
per AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS p FROM k),
probe AS (SELECT per.doc_id, p, j FROM (SELECT *, unnest(range(0, (n - 1) // p)) AS j FROM per) AS per JOIN w AS a ON a.doc_id = per.doc_id AND a.i = per.j * p JOIN w AS b ON b.doc_id = per.doc_id AND b.i = (per.j + 1) * p WHERE a.x = b.x),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, j - lag(j, 2) OVER (PARTITION BY doc_id, p ORDER BY j) AS d FROM probe) WHERE d = 2),
same AS (SELECT a.doc_id, p, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, p ORDER BY a.i) AS island FROM hit JOIN w AS a ON a.doc_id = hit.doc_id JOIN w AS b ON b.doc_id = a.doc_id AND b.i = a.i + p WHERE a.x = b.x),
long AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM same GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
run AS MATERIALIZED (SELECT doc_id, s, l, min(p) AS p FROM long GROUP BY doc_id, s, l),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DOUBLE) / p DESC, s, p) AS r FROM run),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM run),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS c FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS rs FROM run GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, best.p AS period, 1000 * l // best.p AS exponent_milli, sha256(coalesce(rs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN best ON best.doc_id = t.doc_id AND r = 1 LEFT JOIN kept ON kept.doc_id = t.doc_id""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS named FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(named) + 1 + length(shown) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, role) AS ks,
  list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, role) AS ls FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT *, CAST({_CRC32.format('conv_id')} % 6 AS INTEGER) AS h FROM t),
rb AS (SELECT c.conv_id, list_concat(coalesce(b.ks[1:h], []), c.ks[h + 1:]) AS ks, list_concat(coalesce(b.ls[1:h], []), c.ls[h + 1:]) AS ls FROM c LEFT JOIN t AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, ks, ls, unnest(range(0, len(ks) + 1)) AS d FROM rb),
node AS (SELECT array_to_string(ks[1:d], ',') AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(ks) AS ks, coalesce(any_value(ls[d]), 0) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ks) = d), '')) AS ends_sha256 FROM pre GROUP BY 1, 2),
child AS (SELECT array_to_string(ks[1:d - 1], ',') AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
leafy AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
up AS (SELECT array_to_string(ks[1:e], ',') AS k, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM leafy) GROUP BY 1)
SELECT leafy.conv_id, leafy.d AS depth, p.conv_id AS parent_conv_id, leafy.n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, leafy.ends_sha256
FROM leafy JOIN up USING (k) LEFT JOIN node AS p ON leafy.d > 0 AND p.k = array_to_string(leafy.ks[1:leafy.d - 1], ',')""",
    # the level at which the targets add up to all words, by trying each source as the last one below its bound
    "mixing_targets": f"""
WITH s AS (SELECT source, CAST(sum(len({_WORDS.format("text")})) AS BIGINT) AS source_size FROM documents GROUP BY source),
r AS (SELECT *, CAST(([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM s),
try AS (SELECT 3 * source_size / w AS fill FROM r),
level AS (SELECT fill, (SELECT sum(least(3 * source_size, w * fill)) FROM r) AS held, (SELECT sum(source_size) FROM r) AS total FROM try),
top AS (SELECT coalesce(max(fill) FILTER (WHERE held <= total), 0) AS full_at FROM level),
free AS (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size / w <= full_at), 0)) / sum(w) FILTER (WHERE 3 * source_size / w > full_at) AS lvl FROM r, top)
SELECT source, source_size, round(least(3 * source_size, coalesce(lvl, 1e300) * w), 3) AS target FROM r, free""",
}

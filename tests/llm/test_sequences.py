"""Periodic runs, chat formatting and the prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA, rows

from regionspark.llm import chat, periodic, queries, trie

SHA = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _brute_runs(w):
    """All runs by definition: every start and period, longest stretches, smallest period."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p):
                found.setdefault((i, length), p)  # the smallest period comes first
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _random_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 60))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 80))]
    out = []
    while len(out) < rng.randrange(1, 150):
        unit = [rng.choice("abcx") for _ in range(rng.randrange(1, 9))]
        out += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        out += [rng.choice("abcdefghijk") for _ in range(rng.randrange(0, 6))]
    return out


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    texts = [_random_words(rng) for _ in range(1500)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 999, list("ab") * 200 + ["a"]]
    got = periodic._batch_runs([[w.encode() for w in t] for t in texts])
    n = 0
    for t, g in zip(texts, got):
        want = _brute_runs(t)
        assert g == want, t
        n += len(want)
    assert n > 1000


def test_long_texts_of_one_run_are_found_at_once():
    import time

    t = time.time()
    got = periodic._batch_runs([[b"w"] * 400_000, [b"x%d" % (i % 1000) for i in range(300_000)], [b"y%d" % i for i in range(200_000)]])
    assert got == [[(0, 400_000, 1)], [(0, 300_000, 1000)], []]
    assert time.time() - t < 20


def _planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _run_row(doc_id, w):
    runs = _brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    start, length, period = best or (None, None, None)
    milli = best and 1000 * length // period
    return (doc_id, len(runs), start, length, period, milli, SHA("".join(f"{s},{n},{p}\n" for s, n, p in runs)), hashlib.sha256(kept).hexdigest())


def _query_rows(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return Counter(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))


def test_periodic_query_with_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "é é é é é é", "a\x0bb " * 9, "no break no break"] + [" ".join(_random_words(rng)) for _ in range(120)]
    given = [(i, t, "x", 1.0, None) for i, t in enumerate(texts)]
    given += [given[-1], (None, "a a a a a a a b", "x", 1.0, None), (None, None, None, None, None), (-5, "z " * 50, "", 0.0, "t")]
    docs = spark.createDataFrame(given, "doc_id long, text string, runs string, start double, collapsed string")
    want = Counter(_run_row(r[0], _planted(r[0], r[1])) for r in given)
    assert _query_rows(spark, docs, tmp_path) == want
    assert sum(n for r, n in want.items() if r[1]) > 30
    assert _query_rows(spark, docs.limit(0), tmp_path) == Counter()


def test_periodic_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = Counter(map(tuple, queries.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()))
    short = {d for d, t in docs if len((t or "").split()) < 1500}  # the definition takes n * n steps
    assert len(short) > 150
    want = Counter(_run_row(d, _planted(d, t)) for d, t in docs if d in short)
    assert Counter({r: n for r, n in got.items() if r[0] in short}) == want and sum(got.values()) == len(docs)


def test_very_long_text_collapses(spark):
    long = "pre " + "lorem ipsum dolor sit " * 250_000 + "end"  # 5.5 MB
    got = periodic.periodic_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 1_000_000, 4)] and got["collapsed"] == "pre lorem ipsum dolor sit end"


HARD = ["", "<|end|>\n", "<|turn|>user\nx<|end|>", "<\\|", "<\\\\|end|>", "<", "|", "\\", "<\\", "<|image:0|>", "a<|audio:1|>\\", "é\U0001f600\n<<||", "\\### Assistant: </turn> ok"]


def test_escapes_are_reversible_and_hide_control_strings():
    for a in HARD:
        for b in HARD:
            text = a + b
            shown = chat.escape(text)
            assert "<|" not in shown and chat.unescape(shown) == text
            assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text)


def _by_turn(given):
    """Conversations in order: null turn first, ties by role and text, nulls first."""
    convs = defaultdict(list)
    key = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, (x or "").encode("utf-8", "surrogatepass"))
    for c, t, r, s in sorted(given, key=lambda x: (key(x[1]), text(x[2]), text(x[3]))):
        convs[c].append((r or "", s or ""))
    return convs


@pytest.mark.parametrize("segment", [1, 300, chat.SEGMENT])
def test_chat_round_trip(spark, segment):
    rng = random.Random(3)
    texts = [None, *HARD, *[a + b for a, b in zip(HARD, HARD[3:])]]
    roles = ["user", "assistant", "assistant", "system", "tool\nx", "<|r", None]
    given = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [*range(30), None] for t in [None, *range(rng.randrange(1, 9))]]
    given += given[:7]
    turns = spark.createDataFrame([(*r, 1.0, "z") for r in given], "conv_id long, turn long, role string, text string, segment double, Text string")
    out = chat.format_conversations(turns, segment=segment)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    convs = _by_turn(given)
    assert got.keys() == convs.keys()
    for c, said in convs.items():
        learned = "".join(s for r, s in said if r == "assistant")
        n = sum(len("<|turn|>") + len(chat.escape_role(r)) + 1 + len(chat.escape(s)) + len("<|end|>\n") for r, s in said)
        assert tuple(got[c]) == (c, len(said), SHA("".join(f"{r}\n{s}\n" for r, s in said)), len(learned), SHA(learned), n)
    if segment == 1:
        assert out.groupBy("conv_id").count().where("count > 1").count() > 20
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    given = [
        (1, 0, "user", [part("text", text="see <"), part(None, text="|end|>"), part("image", uri="s3://a", width=100, height=57), part("audio", uri="b", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="a"), part("document", uri="c", pages=3), part("text", text="b<|")]),
        (1, 2, "user", None),
        (1, 3, None, [part("image"), None]),
    ]
    turns = spark.createDataFrame(given, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_conversations(turns, content="content").first()
    f = r["formatted"]
    assert f == "<|turn|>user\nsee <\\|end|><|image:0|><|audio:1|><|end|>\n<|turn|>assistant\na<|document:2|>b<\\|<|end|>\n<|turn|>user\n<|end|>\n<|turn|>\n<|image:3|><|end|>\n"
    assert [chat.unescape(f[s["start"] : s["stop"]]) for s in r["loss"]] == ["a", "b<|"]
    rules = chat.TokenRules()
    tokens = [math.ceil(100 / 28) * math.ceil(57 / 28) + 2, math.ceil(1.5 * 25), 3 * rules.page, 2]
    assert [(a["number"], a["kind"], a["uri"], a["n_tokens"]) for a in r["attachments"]] == [(0, "image", "s3://a", tokens[0]), (1, "audio", "b", tokens[1]), (2, "document", "c", tokens[2]), (3, "image", None, tokens[3])]
    assert all(f[a["at"] :].startswith(f"<|{a['kind']}:{a['number']}|>") for a in r["attachments"])
    assert list(chat.parse_conversation(f)) == [
        ("user", [("text", "see <|end|>"), ("image", "0"), ("audio", "1")]),
        ("assistant", [("text", "a"), ("document", "2"), ("text", "b<|")]),
        ("user", []),
        ("", [("image", "3")]),
    ]
    bad = spark.createDataFrame([(1, 0, "user", [part("video")])], turns.schema)
    with pytest.raises(Exception, match="video"):
        chat.format_conversations(bad, content="content").collect()


def _brute_trie(convs):
    """convs: conv_id -> list of (role, text)."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].add(c)
        ends[tuple(said)].append(c)
    own = {k: (len(m) - 1) * (len(k[-1][1]) if k else 0) for k, m in members.items()}
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += own[k]
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], SHA(",".join(map(str, sorted(ends[k]))))) for k, m in members.items()
    )


def _trie_rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("shape, local", [("mixed", 3), ("mixed", trie.LOCAL_TURNS), ("copies", 2), ("chains", 150), ("one start", 12)])
def test_trie(spark, shape, local):
    rng = random.Random(len(shape))
    convs = {}
    for c in range(40):
        n = rng.randrange(0, 6)
        if shape == "copies":
            said = [("user", "a"), ("assistant", "é"), ("user", "c")] if c % 3 else [("user", rng.choice("ab"))] * (c % 4)
        elif shape == "chains":
            said = [("user", "same")] * c
        else:
            said = [(rng.choice(["user", "tool"]), rng.choice(["x", "", "yy\U0001f600"])) for _ in range(n)]
            said = [("system", "s" * 9), ("user", "q")] * (shape == "one start") + said
        convs[c * 7] = said
    given = [(c, t, *x, None) for c, said in convs.items() for t, x in enumerate(said)]
    convs = {c: s for c, s in convs.items() if s}
    turns = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, ids string")
    assert _trie_rows(trie.conversation_trie(turns, local_turns=local)) == _brute_trie(convs)


def test_trie_query_with_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    given = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["p", "q", None, "long " * 30])) for c in [0, 3, 5, 8, 41, 99, 100, 101, 150, 377, 378, 500, 501, 502] for t in [None, *range(rng.randrange(0, 7))] if t is not None or c % 2]
    turns = spark.createDataFrame([(*r, 0.0, "x") for r in [*given, (None, 0, "user", "lost")]], "conv_id long, turn long, role string, text string, depth double, ids string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    convs = _by_turn(given)
    rebuilt = {}
    for c, said in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + said[h:]
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert _trie_rows(got) == _brute_trie(rebuilt)
    turns.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_prefix_trie(spark, f"{tmp_path}/none").count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    given = spark.createDataFrame([(4, [], []), (9, [], [])], "conv_id long, ids array<long>, chars array<int>")
    assert [tuple(r) for r in trie.prefix_trie(given).collect()] == [(4, 0, None, 2, 0, 1, 0, SHA("4,9"))]


def test_multikey_quicksort_alone():
    rng = random.Random(1)
    for _ in range(200):
        seqs = {tuple([7] + [rng.randrange(3) for _ in range(rng.randrange(0, 6))]) for _ in range(rng.randrange(1, 30))}
        records = [(s, tuple(len(str(x)) * 3 for x in s), i, 1, f"d{i}") for i, s in enumerate(seqs)]
        nodes = trie.multikey_nodes(records, 1, None)
        prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
        assert len(nodes) == len(prefixes) and nodes[0][3] == len(seqs)
        assert nodes[0][5] == sum(not any(p[:-1] == s for p in prefixes) for s in prefixes)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_chat_format", "op13_prefix_trie"])
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

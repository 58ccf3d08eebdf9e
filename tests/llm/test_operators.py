"""Corpus operators against brute-force versions on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from regionspark.llm import ann, components, decontam, mixing, pii, quality, queries, recompression, simhash, tokenbin, toxicity, viterbi
from regionspark.llm._common import pick, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def _texts(seed=1, n=60):
    """Texts with shared passages, copies, runs, empties and nulls."""
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "é", "x,", "Word", "end.", "\U0001f600"] + [f"w{i}" for i in range(30)]
    base = [rng.choice(vocab) for _ in range(300)]
    out = [None, "", "   \n", "one", "a " * 40, "a\x0b" * 25 + "b"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.6:
                s = rng.randrange(280)
                parts += base[s : s + rng.randrange(8, 60)]
            else:
                parts += [rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
        out.append(rng.choice([" ", "  ", "\n"]).join(parts))
    return out + out[-4:]


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id (with a null and a repeated row), text, source, and columns whose names clash with internal ones."""
    texts = _texts()
    rows = [(i, t, ["s2", None, "s10", "s1"][i % 4], "x", 1.5, t) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id", "s1", "x", 1.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, component_id double, Text string")


def _plain(docs):
    return [(r["doc_id"], r[1], r["source"]) for r in docs.collect()]


def _empty(docs):
    return docs.limit(0)


def test_pick_takes_the_exact_name(docs):
    assert pick(docs, "text").columns == ["text"] and pick(docs, "Text").columns == ["Text"]


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(docs, window):
    rows = _plain(docs)
    first = {}
    words = [[w for w in WORD.findall(t or "")] for _, t, _ in rows]
    for (i, _, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    want = []
    for (i, _, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in recompression.substring_dedup(docs, window=window).collect()]
    assert Counter(got) == Counter(want)
    assert sum(x[2] for x in want) > 100
    assert recompression.substring_dedup(_empty(docs)).count() == 0


def test_windows_have_equal_names_if_and_only_if_equal_words():
    texts = [(t or "").encode() for t in _texts(3, 80)]
    for levels in (0, 1, 2, 3):
        sym, doc = recompression.word_names(texts, 11)
        at, names = recompression.window_names(sym, doc, 13, levels)
        flat = [w for t in texts for w in t.split()]
        seen = {}
        for a, n in zip(at.tolist(), names.tolist()):
            assert seen.setdefault(tuple(flat[a : a + 13]), n) == n
        assert len(set(seen.values())) == len(seen) > 100


def test_wide_names(docs):
    plan = recompression.Plan(1 << 50, 1 << 52, 13, 2)
    assert plan.wide
    _, _, name, low = plan.names([b"a b c d e f g h i j k l m n"])
    blob = recompression._pack(np.array([5, 9]), name, low, plan)
    doc, n, lo = recompression._unpack(blob, plan, int(plan.bucket(name)[0]))
    assert doc.tolist() == [5, 9] and (n == name).all() and (lo == low).all()


def _fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, bits):
    label = {i: i for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = label[i], label[j]
                label = {k: (b if v == a else v) for k, v in label.items()}
    return label


@pytest.mark.parametrize("bits", [2, 3])
def test_simhash(spark, docs, bits):
    rows = _plain(docs)
    fps = [_fingerprint(t) for _, t, _ in rows]
    label = _components(fps, bits)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = [(i, f if f < 1 << 63 else f - (1 << 64), least.get(label[k])) for k, ((i, _, _), f) in enumerate(zip(rows, fps))]
    got = [tuple(r) for r in simhash.simhash_classes(docs, bits=bits).collect()]
    assert Counter(got) == Counter(want)
    assert simhash.simhash_classes(_empty(docs)).count() == 0


@pytest.mark.parametrize("triples", [0, 7, 21])
@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_keep_all_connections(spark, triples, bits, monkeypatch):
    rng = np.random.default_rng(triples + bits)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(int(c) for c in centre)
    for c in centre[:4]:
        for _ in range(120):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f if f < 1 << 63 else f - (1 << 64) for f in fps]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, rep long")
    monkeypatch.setattr(simhash.AnchorCode, "for_count", classmethod(lambda cls, n, bits=64: cls(triples)))
    monkeypatch.setattr(simhash, "PAIRWISE", 20)
    links = simhash.near_links(df, bits).collect()
    got = {frozenset((r.u, r.v)) for r in links}
    label = _components(fps, bits)
    mine = {k: k for k in range(len(fps))}
    for pair in got:
        a, b = (mine[x] for x in pair)
        mine = {k: (a if v == b else v) for k, v in mine.items()}
    group = lambda l: {frozenset(k for k in l if l[k] == v) for v in set(l.values())}  # noqa: E741, E731
    assert group(mine) == group(label)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _similar_classes(texts, least=0.8):
    """doc_id -> least doc_id of its class under similarity of five-word shingle sets; also the number of linked pairs."""
    label, sets, n = {i: i for i in texts}, {i: _shingles(t) for i, t in texts.items()}, 0
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                n += 1
                a, b = sorted((label[i], label[j]))
                if a != b:
                    label = {x: (a if v == b else v) for x, v in label.items()}
    return label, n


def test_drop_near_duplicates_keeps_one(spark, docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    label, _ = _similar_classes({i: t for i, t, _ in _plain(docs) if i is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))
    assert simhash.drop_near_duplicates(_empty(docs)).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(6)
    texts = {i: " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 200, 500]))) for i in range(120)}
    for i in range(120, 420):
        w = texts[rng.randrange(120)].split()
        for _ in range(rng.randrange(0, max(2, len(w) // 40))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label, n = _similar_classes(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    assert n > 300 and all(label[got[i]] == label[i] for i in texts)  # nothing is joined that should not be
    assert len(set(got.values())) <= 1.08 * len(set(label.values()))


def test_hubs_are_the_least_of_their_class():
    root, rep = np.array([0, 0, 2, 0, 2, 5]), np.array([9, 4, 7, 8, 1, 3])
    assert simhash._hubs(root, rep).tolist() == [1, 1, 4, 1, 4, 5]


def test_a_crowd_whose_ends_differ_is_one_class(spark):
    """Each text is near the next one only: links beyond the first of a document are needed, and none is lost."""
    rng = random.Random(12)
    w = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = {}
    for i in range(80):
        texts[i] = " ".join(w)
        for _ in range(2):
            w[rng.randrange(400)] = f"n{i}"
    texts |= {100 + i: texts[i].upper() for i in range(5)} | {200: None, 201: "", 202: " \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label, _ = _similar_classes(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    assert got == label and set(got.values()) == {0, 200}


def test_links_of_crowded_anchors_are_not_lost(spark, monkeypatch):
    """Members that a hub brings together stay linked, though neither is similar to the hub."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(300)]
    texts = {0: " ".join(base)}
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(300), 14):
            w[k] = f"c{i}x{k}"
        texts[2 * i + 1] = " ".join(w)
        w[rng.randrange(300)] = "z"
        texts[2 * i + 2] = " ".join(w)
    # all fingerprints alike: one anchor a piece holds all
    monkeypatch.setattr(simhash, "_long_fingerprint", lambda h: np.zeros(simhash.PIECES, np.int64))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label, n = _similar_classes(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    assert n >= 30 and len(set(label.values())) > 20 and got == label


def test_repeats_do_not_move_fingerprints_apart(spark):
    """A text and the same with its last part repeated many times have nearly equal sets, so near fingerprints, too."""
    rng = random.Random(9)
    w = [f"r{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(w), " ".join(w + w[-60:] * 20)]
    near = [simhash._long_fingerprint(simhash._sketched(t, 5, simhash.SEED)) for t in texts]
    assert np.bitwise_count(near[0] ^ near[1]).sum() <= simhash.FAR_BITS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicate_classes(df).collect()} == {0}


def test_every_lone_pair_is_found(spark, monkeypatch):
    """Lone pairs at the least similarity and just above it, short ones among them, are all joined; those just below are not."""
    texts, want, k = {}, {}, 0
    for n, both, times in ((4, 4, 40), (80, 64, 60), (80, 66, 40), (9, 7, 40), (80, 63, 20)):
        # sets of `n` shingles and of `both`, all of these in the first; or one less in common than is needed
        for _ in range(times):
            w = [f"p{k}w{j}" for j in range(n + 5)]
            if n == 4:
                texts[k], texts[k + 1] = " ".join(w), " ".join(w[:-1])
            else:
                texts[k], texts[k + 1] = " ".join(w[: n + 4]), " ".join(w[: both + 4])
            want[k], want[k + 1] = k, k if n == 4 or both >= 0.8 * n else k + 1
            k += 2
    # a passage that many texts share, compared in blocks
    texts |= {k + i: " ".join([*(f"q{i}w{j}" for j in range(4)), *(f"line{j}" for j in range(60))]) for i in range(60)}
    for name in ("HOT", "SMALL", "PART"):
        monkeypatch.setattr(simhash, name, 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label, _ = _similar_classes(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    assert got == label and {i: got[i] for i in range(k)} == want
    monkeypatch.setattr(simhash, "_piece_links", lambda reps, bits: reps.selectExpr("rep u", "rep v").limit(0))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()} == label


def test_crowds_of_a_shingle_lose_no_similar_pair():
    """Sets around one another, each a class of its own: all similar pairs leave the tasks, and none that parities rule out."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    sets = []
    for _ in range(60):
        gone = rng.choice(60, rng.integers(2, 12), replace=False)
        sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 1 << 63, len(gone), dtype=np.uint64)])))
    sets += [rng.integers(0, 1 << 63, 60, dtype=np.uint64) for _ in range(20)]
    heads = [simhash._head(x, 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.int64))).view(np.int64).tolist() for x in sets]
    hot = {h for h in itertools.chain(*heads) if h % 3 == 0}
    names = ["h", "hot", "rep", "cls", "n", "at"]
    rows = [(h, 0, i, i, len(x), k) for i, x in enumerate(sets) for k, h in enumerate(heads[i]) if h not in hot]
    rows += [(i, 1, i, i, len(x), min(k for k, h in enumerate(heads[i]) if h in hot)) for i, x in enumerate(sets) if hot & set(heads[i])]
    sorted_rows = pa.table({c: list(x) for c, x in zip(names, zip(*sorted(rows)))})
    met = pa.Table.from_batches(list(simhash._meet(sorted_rows.to_batches(max_chunksize=37), 0.8))).to_pylist()
    pairs = {(r["u"], r["v"]) for r in met if r["u"] is not None}
    first = {}
    for r in met:
        if r["u"] is None:
            first[r["rep"]] = min(first.get(r["rep"], r["at"]), r["at"])
    assert first
    buckets = {}
    for i in first:
        for k in simhash._bands(sets[i], 0.8, 7).tolist():
            buckets.setdefault(k, []).append(i)
    rows = []
    for k, members in buckets.items():
        # the largest class is dealt over two parts, others are in both
        for i in members:
            lead = int(i == members[0])
            rows += [(k, part, lead, i, i, len(sets[i]), len(sets[i]) - first[i]) for part in ([i % 2] if lead else [0, 1])]
    names = ["key", "part", "lead", "rep", "cls", "n", "left"]
    sorted_rows = pa.table({c: list(x) for c, x in zip(names, zip(*sorted(rows)))})
    for b in simhash._meet_buckets(sorted_rows.to_batches(max_chunksize=29), 0.8):
        pairs |= {(r["u"], r["v"]) for r in b.to_pylist()}
    assert len(pairs) < len(sets) * len(sets) // 2
    similar = set()
    for u, v in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[u], sets[v]))
        if both >= 0.8 * (len(sets[u]) + len(sets[v]) - both):
            similar.add((u, v))
    assert len(similar) > 20 and similar <= pairs


def test_a_crowd_of_unlike_documents_costs_no_square():
    """Documents that share some shingles and are unlike otherwise: the bands of thousands name next to no pair."""
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 63, 15, dtype=np.uint64)
    counts = []
    for size in (500, 2000):
        met = Counter()
        for i in range(size):
            met.update(simhash._bands(np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 35, dtype=np.uint64)])), 0.8, 7).tolist())
        counts.append(sum(c * (c - 1) // 2 for c in met.values()))
    assert counts[1] < 2000
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    for k in range(40):
        other = np.unique(np.concatenate([a[rng.permutation(900)[:800]], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
        assert set(simhash._bands(a, 0.8, 7).tolist()) & set(simhash._bands(other, 0.8, 7).tolist())


def test_near_copies_that_are_too_unlike_leave_no_square():
    """Edits of one text share a band with each other: of those below the least similarity no pairs leave a task, others are all there."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 140, dtype=np.uint64) * np.uint64(2)
    left = []
    for size in (150, 300):
        sets = []
        for _ in range(size):
            gone = rng.choice(140, 13, replace=False)
            sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 1 << 63, 13, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])))
        # the last ones are near one each
        for x in sets[:20]:
            sets.append(np.unique(np.concatenate([x[3:], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])))
        names = ["key", "part", "lead", "rep", "cls", "n", "left", "parity"]
        rows = [(9, 0, int(i == 0), i, i, len(x), len(x), simhash._parity(x).tolist()) for i, x in enumerate(sets)]
        batches = pa.table({c: list(x) for c, x in zip(names, zip(*rows))}).to_batches(max_chunksize=64)
        got = [r for b in simhash._meet_buckets(batches, 0.8) for r in b.to_pylist()]
        similar = {}
        for u, v in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[u], sets[v]))
            if both >= 0.8 * (len(sets[u]) + len(sets[v]) - both):
                similar[u, v] = len(sets[u]) + len(sets[v]) - 2 * both
        pairs = {(r["u"], r["v"]): r["apart"] for r in got}
        assert len(similar) >= 20 and set(similar) <= set(pairs) and all(pairs[p] <= similar[p] for p in similar)
        left.append(len(pairs) - len(similar))
        assert left[-1] < size * size // 20
        parities = [simhash._parity(x).view(np.uint64) for x in sets]
        assert all(a == int(np.bitwise_count(parities[u] ^ parities[v]).sum()) for (u, v), a in pairs.items())


def test_hot_buckets_of_unlike_rows_are_dealt_by_blocks(spark, monkeypatch):
    """Many classes of one bucket meet block by block: each pair in some part, and no part holds more than two blocks and some of the largest class."""
    monkeypatch.setattr(simhash, "PART", 8)
    monkeypatch.setattr(simhash, "_bands", lambda h, similarity, seed: np.array([5]))
    sizes = []
    meet = simhash._meet_buckets

    def seen(batches, similarity):
        batches = list(batches)
        for b in batches:
            sizes.extend(Counter(zip(b.column(0).to_pylist(), b.column(1).to_pylist())).values())
        yield from meet(iter(batches), similarity)
        assert max(sizes, default=0) <= 40

    monkeypatch.setattr(simhash, "_meet_buckets", seen)
    reps = spark.createDataFrame([(i, i, 0, [0] * 16) for i in range(60)], "same long, doc_id long, stamp long, parity array<long>")
    rows = spark.createDataFrame([(i, 0, f"t{i}") for i in range(60)], "doc_id long, stamp long, text string")
    crowd = spark.createDataFrame([(i, max(i, 20), 10, 10, [0] * 16) for i in range(60)], "rep long, cls long, n int, left int, parity array<long>")
    got = sorted((r.u, r.v) for r in simhash._crowd_pairs(crowd, rows, reps, 5, 0.8, 7).collect())
    assert got == [(u, v) for u, v in itertools.combinations(range(60), 2) if v > 20]


def test_personal_data_spans():
    mail, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        out = [("email", *m.span()) for m in mail.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in card.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@-1 2+%3(4)5\n9é٣") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain(t)
    some = "x 4111 1111 1111 1111 y +49 (30) 123-456.78 z é 10.0.0.256 1.2.3.4 a.b@c.de."
    assert pii.base_spans(some) == plain(some) and len(plain(some)) == 4
    long = "a" * 200_000 + "@" + "1" * 200_000
    assert pii.base_spans(long) == []


def test_revealing_terms(spark):
    rows = [(i, f"please ask zanzibar kiosk about me@x{i % 2}.org today okay") for i in range(6)]
    rows += [(10 + i, "please come today or another day, zanzibarless okay") for i in range(20)] + [(40, None), (41, ""), (None, "a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert len(got) == 29 and [s.kind for s in got[0].spans] == ["email"] and got[40].spans == [] and [s.kind for s in got[None].spans] == ["email"]
    text = rows[0][1]
    told = {text[t.start : t.stop] for t in got[0].terms}
    assert told == {"ask", "zanzibar", "kiosk", "about"} and got[10].terms == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zanzibar " not in clean[0] and "<EMAIL>" in clean[0] and clean[10] == rows[6][1] and clean[40] is None
    small = pii.find_personal_data(df.limit(0))
    assert small.count() == 0
    pii_small = pii.MAX_BROADCAST
    try:
        pii.MAX_BROADCAST = 0  # the shuffle way counts the same
        again = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.find_personal_data(df).collect()}
    finally:
        pii.MAX_BROADCAST = pii_small
    assert again == {k: [tuple(t) for t in r.terms] for k, r in got.items()}


def test_disclosure_by_brute_force(spark):
    """n, df, P and bits of every term and entity from all documents, one word rule, eight words whatever lies between."""
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(40)] + ["to", "a\u00a0b", "x" * 700]
    texts = [None, ""]
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w)), rng.choice([f"me@x{i % 3}.org,", "10.1.2.3", "+49 30 1234567", "k9X2b7Qw4Zt8Lm1Pr6Vs"]))
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = "rareterm"
            w.insert(rng.randrange(len(w)), "10.1.2.9")
        texts.append("  ".join(w))
    near, df, ne = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        base = pii.base_spans(t)
        base += pii.secret_spans(t, lambda s, e: any(x < e and s < y for _, x, y in base))
        words = [m.span() for m in WORD.finditer(t)]
        df.update({pii._term(t[a:z]) for a, z in words})
        ents, pairs = set(), set()
        for k, s, e in base:
            own = pii._entities(k, t[s:e])
            ents.update(own)
            around = [w for w in words if w[1] <= s][-8:] + [w for w in words if w[0] >= e][:8]
            for a, z in around:
                term = pii._term(t[a:z])
                if len(term) >= 3 and not any(x < z and a < y for _, x, y in base):
                    pairs.update((term, x) for x in own)
        near.update(pairs)
        ne.update(ents)
    want = {}
    for (term, e), n in near.items():
        p = n / df[term]
        bits = np.log2(p * len(texts) / ne[e])
        if n >= 3 and p >= 0.5 and bits > 0:
            want[term, e] = (n, df[term], p)
    frame = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = {(r.term, r.entity): (r.n, r.df, r.p) for r in pii.disclosure(frame).collect()}
    assert got == want and {("rareterm", "ip~10.1.2."), ("rareterm", "ip*")} <= set(want)


def test_terms_far_off_and_without_the_value(spark):
    far = [(i, "mail joe@ex.com " + "x" * 600 + " zebra") for i in range(6)] + [(10 + i, "a\u00a0b joe@ex.com") for i in range(6)]
    far += [(100 + i, f"nothing {i}") for i in range(30)]
    far += [(20, "the zebra stands alone"), (20, "other text of that id, me@org.example"), (None, "zebra again"), (31, 'token = "908038b7daaf91e730d2f64001c52934d43908aa" end')]
    df = spark.createDataFrame(far, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.spans, r.terms) for r in pii._marked(df, "text", 8, 3, 0.5, 0.9).collect()]
    said = lambda t, terms: {t[x.start : x.stop] for x in terms}
    by_text = {t: said(t, terms) for _, t, _, terms in got}
    assert by_text[far[0][1]] == {"mail", "x" * 600, "zebra"} and by_text[far[6][1]] == {"a\u00a0b"}
    assert by_text["the zebra stands alone"] == {"zebra"} and by_text["zebra again"] == {"zebra"} and by_text["other text of that id, me@org.example"] == set()
    assert by_text[far[-1][1]] == {"908038b7daaf91e730d2f64001c52934d43908aa"}
    clean = sorted((str(r.doc_id), r.text) for r in pii.sanitise(df).collect())
    assert [t for i, t in clean if i == "20"] == ["other text of that id, <EMAIL>", "the <TERM> stands alone"] and not any("joe@" in t for _, t in clean)


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    odd = spark.createDataFrame([(500, "it's <|endoftext|> a  b　c \x85d\n\n word,word Жw-x"), (501, "\n \n"), (-5, "minus")], "doc_id long, text string")
    both = pick(docs, "doc_id", "text").unionByName(odd)
    t = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in both.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert rows[-1][0] is None and rows[-2][0] is not None
    start, want = 0, []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got, manifest, _ = tokenbin.tokenize_to_binary(both, path, f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    files = manifest.collect()
    assert sum(f.n_ids for f in files) == start and sorted(f.base for f in files)[0] == 0
    assert tokenbin.tokenize_to_binary(_empty(docs), path)[0].count() == 0


def test_pieces_never_change_ids():
    e = tokenbin.PieceEncoder(queries.tokenizer_file())
    rng = random.Random(5)
    al = ["a", "Bc", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "Ж", "<|endoftext|>", "1", "!", "'s", ",", "  ", "　", "中", " the", "<|end", "\x00", "."]
    texts = ["".join(rng.choice(al) for _ in range(rng.randrange(25))) for _ in range(8000)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == want


def test_token_counts_equal_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = viterbi.load_pieces(path)
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.SPACE, prepend_scheme="always", split=True)
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in _plain(docs))
    assert Counter((r.doc_id, r.n_tokens) for r in viterbi.count_tokens(docs, path).collect()) == want
    rng = random.Random(1)
    for _ in range(20):
        small = {"".join(rng.choice("abc" + viterbi.SPACE) for _ in range(rng.randrange(1, 4))): float(rng.randrange(-4, 0)) for _ in range(12)}
        vocab = [("<unk>", 0.0), *small.items()]
        t = Tokenizer(models.Unigram(vocab, unk_id=0))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.SPACE, prepend_scheme="always", split=True)
        c = viterbi.UnigramCounter(vocab)
        for _ in range(200):
            x = "".join(rng.choice("abcd ") for _ in range(rng.randrange(14)))
            assert c.count(x)[0] == len(t.encode(x, add_special_tokens=False).ids)


def _contaminated(docs, items):
    """(doc, item) -> similarity, -start, shared and all shingles of the best of all windows."""
    out, cut = {}, lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    held = [(i, len(w), Counter(cut(w))) for i, w in ((i, (t or "").lower().split()) for i, t in items) if len(w) >= 5]
    for d, text in docs:
        v = (text or "").lower().split()
        own = cut(v)
        for i, n, sh in held:
            if sh.keys().isdisjoint(own):
                continue
            for s in range(max(1, len(v) - n + 1)):
                got = Counter(own[s : s + n - 4])
                both = sum((got & sh).values())
                every = sum(got.values()) + sum(sh.values()) - both
                if both / every >= 0.8 and (both / every, -s) > out.get((d, i), (0, 0))[:2]:
                    out[d, i] = (both / every, -s, both, every)
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 6
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([5, 18, 30, 30, 55])))) for k in range(12)] + [(20, "too short"), (21, None), (22, ""), (None, " ".join(say(20))), (23, "the " * 12)]
    docs = [(0, None), (1, ""), (2, items[0][1].upper()), (None, items[1][1])]
    for k in range(40):
        w = items[k % 12][1].split()
        if k % 5 == 1:
            w = w[: len(w) * 9 // 10]
        if k % 5 == 2:
            w[rng.randrange(len(w))] = "other"
        if k % 5 == 3:
            w = w[:3] + ["in"] + w[3:]
        if k % 5 == 4:
            w = say(20)
        docs.append((10 + k, " ".join(say(rng.randrange(30)) + w + say(rng.randrange(30)))))
    docs += [docs[-1], (99, "the " * 30)]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    want = _contaminated([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start, r.n_shared, r.n_all) for r in decontam.contaminated(d, b).collect()}
    assert got == want and len(want) > 10
    clean = decontam.decontaminate(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {x[0] for x in docs} - {k for k, _ in want} - {None}
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_of_passages_in_another_order(spark):
    """Windows at every start are judged: halves that have changed places, and a cut beginning with a gap, stand at no offset of the item's."""
    rng = random.Random(10)
    say = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = [(0, say("a", 50)), (1, say("b", 100)), (2, say("c", 120)), (3, say("d", 60)), (4, (["the", "of"] * 20)[:33])]
    a, b, c, d = (x for _, x in items[:4])
    docs = [say("x", 20) + a[25:] + a[:25] + say("y", 20), a[25:] + a[:25], say("x", 3) + b[50:] + b[:50], say("x", 9) + c[5:60] + say("g", 8) + c[60:] + say("y", 9)]
    docs += [d[:50], d[30:] + d[:30] + say("z", 1), say("x", 70), ["the", "of"] * 40, say("x", 9) + d[4:20] + ["g"] + d[20:40] + d[44:] + say("y", 9)]
    for _ in range(20):
        w = list(rng.choice(items)[1])
        cut = rng.randrange(len(w))
        docs.append(say("x", rng.randrange(9)) + w[cut:] + say("g", rng.randrange(4)) + w[:cut] + say("y", rng.randrange(9)))
    want = {}
    for i, w in items:
        sh = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for n, v in enumerate(docs):
            for s in range(max(1, len(v) - len(w) + 1)):
                part = v[s : s + len(w)]
                got = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                both = sum((got & sh).values())
                share = both / (sum(got.values()) + sum(sh.values()) - both)
                if share >= 0.8:
                    want[n, i] = max(share, want.get((n, i), 0))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df, bench).collect()}
    assert got == want and {(0, 0), (1, 0), (2, 1)} <= set(got)
    # first and last word changed and two put into the middle: the best window stands at no offset of the item's shingles
    w = [f"w{k}" for k in range(58)]
    item = spark.createDataFrame([(7, " ".join(w)), (7, " ".join(reversed(w)))], "item_id long, text string")
    text = " ".join([*say("x", 20), "first", *w[1:28], "two", "more", *w[28:57], "last", *say("y", 20)])
    want = _contaminated([(1, text)], [(7, " ".join(w))])
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start, r.n_shared, r.n_all) for r in decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), item).collect()}
    assert got == want and len(want) == 1
    # each row is judged by its own text, with or without an id
    both = spark.createDataFrame([(1, text, "a"), (1, "another text of this id stays here", "b"), (None, text, "c"), (None, None, "d"), (2, "", "e")], "doc_id long, text string, stamp string")
    assert {r.stamp for r in decontam.decontaminate(both, item).collect()} == {"b", "d", "e"}


def test_texts_without_white_space_are_no_burden(spark):
    """5 MB in one word, or in words of one letter: operators that look into words hold bounded memory and agree with small texts."""
    long = "ab" * 2_500_000
    c = viterbi.UnigramCounter([("<unk>", 0.0), ("ab", -1.0), ("a", -2.0), (viterbi.SPACE, -1.0)])
    assert c.count(long)[0] == 2_500_001 and not c.known and c.count("\u4e00" * 300_000)[0] == 2
    e = tokenbin.PieceEncoder(queries.tokenizer_file())
    text = "é" * 50_000
    assert np.frombuffer(e.encode([text])[0], "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids and not e.known
    assert pii.base_spans(long) == [] and pii.secret_spans(long, lambda s, z: False) == []
    rows = [(0, long), (1, "a b " * 1_000_000), (2, "a b " * 20), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in recompression.substring_dedup(df).orderBy("doc_id").collect()] == [(1, 0), (2_000_000, 2_000_000 * 0), (40, 40), (1, 0)]


def _targets(sizes, weights=(5, 2, 1), most=3):
    total = sum(sizes.values())
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    full = set()
    while True:
        rest = total - sum(most * sizes[n] for n in full)
        free = [n for n in names if n not in full]
        share = {n: rest * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n] + 1e-9]
        if not over:
            return {**{n: float(most * sizes[n]) for n in full}, **share}
        full |= set(over)


def test_mixing(docs):
    rows = _plain(docs)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    got = mixing.mix_positions(docs).collect()
    assert len(got) == len(rows)
    want = _targets(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r["size"] * len(r.positions) and r.taken <= 3 * r["size"] and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    most = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= most for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_positions(docs).collect()))
    passes = mixing.mixed_documents(docs)
    assert passes.columns == docs.columns and passes.count() == sum(len(r.positions) for r in got)
    assert mixing.mix_positions(_empty(docs)).count() == 0


def test_mixing_spreads_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    df = spark.createDataFrame([(None, f"w {i} " * (i % 9), "a") for i in range(400)], "doc_id long, text string, source string")
    laid = mixing._laid_out(df, "text", 7, mixing.WEIGHTS, 3, mixing.SCHEDULES, False)
    assert laid.select("__chunk").distinct().count() > 15
    a, b = (sorted(map(str, mixing.mix_positions(df).collect())) for _ in range(2))
    assert a == b


def test_mixing_targets_as_sql(spark, duck):
    from conftest import rows

    got = queries.QUERIES["mixing_targets"](spark, f"{DATA}/sf0.001").toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL["mixing_targets"]).df())


def test_near_duplicates_of_one_id(spark):
    """Different texts that share a doc_id, or have none, are judged for themselves."""
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, say("a", 40)), (1, say("b", 40)), (1, say("a", 40)), (2, say("B", 40)), (None, say("b", 40)), (None, say("c", 40)), (None, say("c", 40)), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted([("1", say("a", 40)), ("1", say("b", 40)), ("None", say("c", 40)), ("3", "")])
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicate_classes(df).collect())
    assert got == Counter({(1, 1): 3, (2, 1): 1, (None, 1): 1, (None, None): 2, (3, 3): 1, (4, 3): 1})


def test_mixing_many_chunks_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(i, "w " * (i % 9), "a" if i % 90 == 0 else "b" if i % 2 else f"c{i % 8}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want, taken = _targets(size), Counter()
    for r in mixing.mix_positions(df).collect():
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    assert all(abs(taken[s] - want[s]) <= 8 for s in want) and any(abs(want[s] - 3 * size[s]) < 1e-9 for s in want)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:140] = x[100]  # copies: ties go to smaller ids
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1100, [0.0] * 24, 0), (1200, [float("nan")] * 24, 0), (1300, [1.0, None] * 12, 0), (1400, [1.0] * 5, 0), (None, x[0].tolist(), 0), rows[3], (1500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    hit = 0
    for q, found in got.items():
        dist = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(len(x)), dist)).tolist() if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and np.allclose([f[2] for f in found], dist[[f[1] for f in found]], rtol=1e-14)
        hit += len({f[1] for f in found} & set(best))
    assert hit >= 0.9 * 70
    assert [f[1] for f in sorted(got[100])] == list(range(101, 111))
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    one = few.where("vec_id = 0")
    assert ann.nearest(one).count() == 0
    back = ann.rotated(np.eye(8), 0, 1)
    assert np.allclose(back @ back.T, np.eye(8))


@pytest.mark.parametrize("name", ["op2_toxicity", "op9_quality"])
def test_classifiers_on_held_out_rows(spark, name):
    d = f"{DATA}/sf0.01"
    label = {"op2_toxicity": "toxic", "op9_quality": "quality"}[name]
    y = {r.doc_id: r[label] for r in table(spark, d, "labels").collect()}
    got = queries.QUERIES[name](spark, d).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.93 * len(held)


def test_classifiers_without_labels_and_with_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (7, 0, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    n = docs.count()
    for labels in (none, odd):
        assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
        assert {r.score for r in quality.score_quality(docs, labels).collect()} == {quality.UNKNOWN}
        assert quality.keep_quality(docs, labels).count() == n
    assert toxicity.score_toxicity(_empty(docs), none).count() == 0 and quality.score_quality(_empty(docs), odd).count() == 0


def test_risk_and_gradient_by_finite_differences():
    """The non-negative risk by its definition, and its gradient; where the negative part is below 0 only that part leads the step, upwards."""
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(0.5, 1, (13, 4)), rng.normal(0, 1, (29, 4))
    loss = lambda z: np.log1p(np.exp(-z))
    signs = set()
    for prior in (None, 0.3, 0.97):
        for k in range(6):
            w = [rng.normal(0, 1 + k, (4, 5)), rng.normal(size=5), rng.normal(0, 1 + k, 5), rng.normal(size=1)]

            def parts(w):
                f = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]
                share = 1.0 if prior is None else prior
                return share * loss(f(xp)).mean(), loss(-f(xu)).mean() - (0.0 if prior is None else prior * loss(-f(xp)).mean())

            positive, negative, grads = quality.risk_gradient(w, xp, xu, prior)
            assert np.allclose((positive, negative), parts(w))
            signs.add(negative >= 0)
            risk = (lambda w: sum(parts(w))) if negative >= 0 else (lambda w: -parts(w)[1])
            for i, g in enumerate(grads):
                for at in np.ndindex(g.shape):
                    up, down = [x.copy() for x in w], [x.copy() for x in w]
                    up[i][at] += 1e-5
                    down[i][at] -= 1e-5
                    assert abs((risk(up) - risk(down)) / 2e-5 - g[at]) < 1e-6
    assert signs == {True, False}


def test_toxicity_by_brute_force(spark):
    """Scores recomputed from each text's features: trees summed one by one, then interpolation between isotonic steps found by pooling."""
    d = f"{DATA}/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels)
    look = toxicity.ToxicLexicon(model.learned)
    margin = lambda x: sum(w * t.predict(Vectors.dense(x)) for w, t in zip(model.trees.treeWeights, model.trees.trees))
    chance = lambda t: 1 / (1 + np.exp(-2 * margin(look.features(t or ""))))
    from pyspark.ml.linalg import Vectors

    texts = {r.doc_id: r.text for r in docs.collect()}
    held = sorted((chance(r.text), r.y) for r in toxicity._labelled(docs, labels, "text", "toxic").where("part = 4").collect())
    pools = []
    for x, y in held:
        pools.append([y, 1, x, x])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            y, n, _, z = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + y * n) / (pools[-1][1] + n), pools[-1][1] + n, pools[-1][2], z]
    at, value = [x for p in pools for x in p[2:]], [p[0] for p in pools for _ in range(2)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - np.interp(chance(t), at, value)) < 1e-6 for i, t in texts.items())


def test_held_out_labels_change_nothing(spark):
    """Flipping the labels of held-out rows leaves every score as it is."""
    d = f"{DATA}/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    from pyspark.sql import functions as F

    from regionspark.llm._common import held_out

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()}


def test_digest_columns(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_pii"](spark, f"{DATA}/sf0.001").collect()}
    for r in table(spark, f"{DATA}/sf0.001", "documents").collect():
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in pii.base_spans(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = f"{DATA}/sf0.001"
    docs = table(spark, d, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    all_rows = {r.doc_id: r for r in docs.collect()}
    kept = cp.quality_stage(spark, docs, d)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    scored = {r.doc_id for r in queries.QUERIES["op9_quality"](spark, d).collect() if r.predicted}
    assert ids == scored and sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)
    near = cp.near_dedup_stage(spark, docs, d)
    label, _ = _similar_classes({i: r.text for i, r in all_rows.items()})
    left = {r.doc_id for r in near.collect()}
    assert left == set(label.values())
    bench = [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()]
    bad = {k for k, _ in _contaminated([(i, r.text) for i, r in all_rows.items()], bench)}
    clean = cp.decontamination_stage(spark, docs, d)
    assert {r.doc_id for r in clean.collect()} == set(all_rows) - bad
    mixed = cp.mixing_stage(spark, docs, d)
    times = Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: len(r.positions) for r in mixing.mix_positions(docs).collect()}
    assert times == Counter(want) and mixed.columns == docs.columns
    out = cp.run(spark, d).collect()
    assert len(out) > 0 and len({(r.doc_id, r.start) for r in out}) == len(out)


def test_short_items_at_the_least_similarity_are_all_found(spark):
    """Items of nine words, documents with the first eight of them: four of five shingles."""
    n = 20_000
    said = lambda words: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.lit("w"), F.hex(F.xxhash64("id", k)))), " ")
    items = spark.range(n).select(F.col("id").alias("item_id"), said(9).alias("text"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), said(8).alias("text"))
    found = decontam.contaminated(docs, items)
    assert found.where("doc_id = item_id").count() == found.count() == n

"""Near-duplicates are the same whatever is known about common shingles: the list orders the exact search and takes nothing from it."""

import itertools
import random

import numpy as np
import pytest

from regionspark.llm import simhash


def _texts():
    """Texts of a common opening and words of their own, and copies at similarities around the least one."""
    rnd = random.Random(17)
    opening = [f"w{k}" for k in range(12)]
    out = []
    for k in range(24):
        words = opening + [f"t{k}x{i}" for i in range(30)]
        out.append(words)
        for changes in (1, 2, 3):
            near = list(words)
            for i in rnd.sample(range(len(near)), changes):
                near[i] = f"c{k}y{changes}z{i}"
            out.append(near)
    return [" ".join(w) for w in out]


def _classes(texts, width, similarity):
    """The least number of each text's class, all pairs by brute force."""
    sets = [{tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("known", ["as counted", "none", "any"])
def test_the_list_of_common_shingles_takes_no_pair_away(spark, monkeypatch, known):
    texts = _texts()
    every = np.unique(np.concatenate([simhash._shingle_hashes(t, simhash.SHINGLE, simhash.SEED) for t in texts]))
    some = np.random.default_rng(3)
    lists = {"none": (every[:0], np.zeros(0, np.int64)), "any": (every[::2], some.choice([3, 50, 5000], len(every[::2])))}
    if known in lists:
        monkeypatch.setattr(simhash, "_common_shingles", lambda *_: lists[known])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _classes(texts, simhash.SHINGLE, simhash.SIMILARITY)
    assert 24 < len(set(want.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()} == want

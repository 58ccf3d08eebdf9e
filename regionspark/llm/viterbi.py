"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each
character; dynamic programming carries the best score of the text so far and
the number of ids on that path. No path is kept, for only the count is asked.

Ties follow the unigram model of the tokenizers library: of paths that reach a
character with equal scores the one whose last piece begins first stays; a
character that is no piece by itself may be unknown, at 10 below the least
score; unknown characters become their UTF-8 bytes if the vocabulary has them
(else a run of them is one id). Texts are cut before each U+2581 after spaces
are replaced by it and one is put in front, so pieces do not span words, and a
worker counts a repeated word once.
"""

from __future__ import annotations

import itertools
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, worker_memory

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of the words that a worker remembers, which starts anew when full; words of more characters are not remembered.
CACHE_BYTES, LONG = 64 << 20, 256
#: Characters whose scores are kept at a time, besides those that the longest piece may still reach back to.
KEPT = 1 << 16


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p, s in pieces:
            if p and not self.find.exists(p):
                self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.longest = max((len(p) for p in names), default=1)
        self.known: dict[str, tuple[int, float]] = {}
        self.held = 0

    def word(self, text: str) -> tuple[int, float]:
        """(ids, score) of one word, U+2581 and all."""
        n = len(text)
        best, ids, base = [0.0], [0], 0  # of the text up to each character from base on
        unknown, in_bytes = self.unknown, self.bytes
        run = -1  # where the last path that ends in an unknown character ends
        done = -1  # the last character whose paths are settled
        top = None
        single = False
        # the automaton lists ends in order and, for one end, the longest piece first: the one begun first
        for end, (length, score) in itertools.chain(self.find.iter(text), ((n, (0, 0.0)),)):
            while done + 1 < end:  # all pieces that end at character done + 1 have been seen
                done += 1
                if not single:
                    got = best[-1] + unknown
                    if top is None or got > top:
                        top = got
                        count = ids[-1] + (len(text[done].encode("utf-8", "surrogatepass")) if in_bytes else run != done)
                        run = done + 1
                best.append(top)
                ids.append(count)
                top, single = None, False
                if len(best) > KEPT + self.longest:
                    # no piece reaches back further
                    del best[:KEPT], ids[:KEPT]
                    base += KEPT
            if end < n:
                start = end + 1 - length - base
                got = best[start] + score
                if top is None or got > top:
                    top, count = got, ids[start] + 1
                single = length == 1
        return ids[-1], best[-1]

    def count(self, text: str) -> tuple[int, float]:
        """(ids, score) of a whole text; an empty one has none."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        parts = (text if text[0] == SPACE else SPACE + text).split(SPACE)[1:]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        total, score = 0, 0.0
        for w in parts:
            got = known.get(w)
            if got is None:
                got = self.word(SPACE + w)
                if len(w) <= LONG:
                    # the entry and its pair of numbers take some 220 bytes
                    known[w] = got
                    self.held += sys.getsizeof(w) + 220
            total += got[0]
            score += got[1]
        return total, score


def count_tokens(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score (of the best segmentation).

    Null and empty texts have 0 tokens and score 0; nulls in doc_id stay; equal
    rows count alike; texts, and words in them, may be of any length; extra
    columns don't matter; an empty table gives no rows. The model file's path
    must exist on every executor.
    """
    rows = pick(docs, "doc_id", text).select(F.col("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = worker_memory(f"unigram {model}", lambda: UnigramCounter(load_pieces(model)))
        for b in batches:
            got = [counter.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")

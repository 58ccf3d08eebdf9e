"""Dense features of whole texts, for the classifiers."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np

#: Frequent function words of the supported languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be at by this from or an have not",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne se pas",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}
_STOP = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())
#: Words said to or about the reader (fixed values).
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Common insults (fixed values); a learned list of the corpus's own joins them.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns imbecile fool jerk bastard hate ugly vermin filth degenerate".split()
)
#: Bytes of the words that a worker remembers, which starts anew when full; longer words than 256 characters are not remembered.
MEMORY_BYTES = 48 << 20
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&~_-+=/\\"
_LEET = str.maketrans("013457@$!", "oieastasi")
_UPPER = bytes(range(65, 91))
_ALPHA = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}\\^~_=+@"
_OBFUSCATED = re.compile(r"[A-Za-z](?:[0-9@$*!][A-Za-z]*){1,4}|(?:[A-Za-z][.\-_*]){3,}[A-Za-z]")

QUALITY_FEATURES = (
    "log_words log_bytes mean_word long_words upper alpha digits symbols bang pipe sentence_ends commas repeats distinct top_word stop_words "
    "lines_per_word same_lines short_lines same_pairs caps_words edge_words mean_line letters_per_byte"
).split()


def quality_features(text: str) -> list[float]:
    """One number per QUALITY_FEATURES; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(QUALITY_FEATURES)
    gone = lambda chars: (size - len(raw.translate(None, chars))) / size
    alpha, upper = gone(_ALPHA), gone(_UPPER)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    caps = sum(w.isupper() for w in words)
    edge = sum(not (w[-1].isalnum() or w[-1] in ".,;:?") for w in words)
    return [
        math.log1p(n),
        math.log1p(size),
        float(lengths.mean()),
        float((lengths > 14).mean()),
        upper / alpha if alpha else 0.0,
        alpha,
        gone(_DIGIT),
        gone(_SYMBOL),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        (raw.count(b".") + raw.count(b"?")) / n,
        raw.count(b",") / n,
        repeats / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(counts[w] for w in _STOP & counts.keys()) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        1 - pairs / (n - 1) if n > 1 else 0.0,
        caps / n,
        edge / n,
        math.log1p(n / len(lines)),
        len(text) / size,
    ]


TOXIC_FEATURES = "log_words insults learned learned_any learned_distinct near_you second_person upper caps_words bang punctuation obfuscated digits_in_words masked".split()


def lexicon_keys(word: str) -> list[str]:
    """What a word is looked up by: itself, and its beginnings of 4 to 6 letters."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def bare(word: str) -> str:
    return word.strip(_EDGE).lower()


class ToxicLexicon:
    """Looks words up in the fixed insults and in learned keys; remembers the answers."""

    def __init__(self, learned: frozenset[str]):
        self.learned = learned
        self.memory: dict[str, int] = {}
        self.held = 0

    def kind(self, token: str) -> int:
        """Bits: 1 insult, 2 learned, 4 second person, 8 an insult behind other letters."""
        got = self.memory.get(token)
        if got is None:
            w = bare(token)
            plain = w.translate(_LEET).replace(".", "").replace("-", "").replace("*", "").replace("_", "")
            got = (w in INSULTS) | 2 * any(k in self.learned for k in lexicon_keys(w)) | 4 * (w in SECOND_PERSON) | 8 * (plain != w and plain in INSULTS)
            if self.held > MEMORY_BYTES:
                self.memory, self.held = {}, 0
            if len(token) <= 256:
                # the entry takes some 120 bytes besides its text
                self.memory[token] = got
                self.held += sys.getsizeof(token) + 120
        return got

    def features(self, text: str) -> list[float]:
        """One number per TOXIC_FEATURES; an empty text has zeros."""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(TOXIC_FEATURES)
        raw = text.encode("utf-8", "surrogatepass")
        size = len(raw)
        kind = np.fromiter(map(self.kind, words), np.int64, n)
        bad = np.flatnonzero(kind & 11)
        you = np.flatnonzero(kind & 4)
        near = 0
        if len(bad) and len(you):
            at = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(bad - you[np.maximum(at - 1, 0)]))
            near = int((gap <= 5).sum())
        alpha = size - len(raw.translate(None, _ALPHA))
        learned = np.flatnonzero(kind & 2)
        return [
            math.log1p(n),
            float((kind & 1).sum()) / n,
            len(learned) / n,
            min(len(learned), 8.0),
            min(float(len({bare(words[i]) for i in learned.tolist()})), 8.0),
            near / n,
            len(you) / n,
            (size - len(raw.translate(None, _UPPER))) / max(alpha, 1),
            sum(w.isupper() for w in words) / n,
            raw.count(b"!") / n,
            (size - len(raw.translate(None, b".,;:!?'\"()-"))) / size,
            len(_OBFUSCATED.findall(text)) / n,
            (size - len(raw.translate(None, _DIGIT))) / size,
            float((kind & 8).sum()) / n,
        ]

"""Personal data: fixed patterns, and terms that reveal whom or what they stand next to.

Protected entities are the values that the patterns find and secrets (words
that carry as much information as a key), the holders that a value belongs to
(an e-mail's host and local part, an address block, a number's or card's
leading digits), and each kind as a whole. A term near one of them may give it
away even with the value itself removed. How much is estimated from
co-occurrence over the whole corpus: with n(t, e) documents in which term t
stands near entity e and df(t) documents that hold t at all, P(e|t) = n / df is
what a reader who sees t learns about e, and I(t; e) = log2(P(e|t) / P(e)) the
information in bits. A term discloses e if at least MIN_DOCUMENTS documents
support it, P(e|t) reaches the threshold and I(t; e) is positive. A term that
discloses a value or a holder is a finding wherever it stands, in documents
that do not hold the value as well; one that discloses a kind only near a value
of that kind. Terms with P(e|t) over the removal threshold are removed, the
others generalised to a placeholder. A secret discloses itself.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MAX_BROADCAST_BYTES, materialize, pick, tidy

#: Kinds of base spans, in order (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans that the method adds: words with the information of a key, and terms found by co-occurrence.
SECRET, TERM = "secret", "term"
#: Words to either side of a value that count as near it, whatever their lengths.
CONTEXT = 8
MIN_DOCUMENTS = 3
DISCLOSURE = 0.5
REMOVAL = 0.9
#: A secret is a run of so many of its characters at least, changes so often between letters and digits, and carries so many bits.
SECRET_LENGTH, SECRET_CHANGES, SECRET_BITS = 20, 4, 72.0
#: Terms of up to so many bytes in all are sent to all tasks; more are joined by shuffle.
MAX_BROADCAST = MAX_BROADCAST_BYTES
#: Distinct counts that a task holds before it hands them on.
FLUSH = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % SECRET_LENGTH)
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The contract's patterns; possessive and anchored forms find the same spans in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left over local characters and to the right over a domain: leftmost, not overlapping."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        elif at + 1 > done:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


class _Taken:
    """Whether a stretch of text touches any of some spans."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def secret_spans(text: str, taken) -> list[tuple[str, int, int]]:
    """Words, or runs in them, that look drawn at random and are long enough to be a key; none that touches a base span."""
    out = []
    for m in _KEY.finditer(text):
        key = m.group()
        if len(_CHANGE.findall(key)) >= SECRET_CHANGES and not taken(*m.span()):
            bits = sum(-k * math.log2(k / len(key)) for k in Counter(key).values())
            if bits >= SECRET_BITS:
                out.append((SECRET, *m.span()))
    return out


def _term(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|*#$%&=").lower()


def _entities(kind: str, value: str) -> list[str]:
    """The value itself, its holders and its kind."""
    value = value.lower() if kind in ("email", SECRET) else "".join(c for c in value if c.isdigit() or c == ".")
    out = [f"{kind}:{value}", f"{kind}*"]
    if kind == "email":
        local, _, host = value.rpartition("@")
        out += [f"{kind}~{local}@", f"{kind}~@{host}"]
    elif kind == "ip":
        out.append(f"{kind}~{value.rpartition('.')[0]}.")
    elif kind in ("card", "phone"):
        out.append(f"{kind}~{value[:6]}")
    return out


def _near(text: str, spans: list[tuple[str, int, int]], context: int):
    """(span, term, start, end) of the words within `context` words of each span that touch none."""
    if not spans:
        return
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    taken = _Taken((s, e) for _, s, e in spans)
    for span in spans:
        first, last = bisect.bisect_right(ends, span[1]), bisect.bisect_left(starts, span[2])
        for a, z in words[max(0, first - context) : first] + words[last : last + context]:
            term = _term(text[a:z])
            if term and not taken(a, z):
                yield span, term, a, z


def _all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, secret_spans(text, _Taken((s, e) for _, s, e in base))


def _counted(rows: DataFrame, each, schema: str) -> DataFrame:
    """Sums of each(text)'s keys, at most one a row and key; schema names the key columns. Tasks hand on partial counts."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        count: Counter = Counter()

        def flush():
            keys = list(count)
            for i in range(0, len(keys), 10_000):
                part = keys[i : i + 10_000]
                cols = [pa.array([k[c] for k in part], pa.string()) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([count[k] for k in part], pa.int64())], names=[*names, "n"])

        for b in batches:
            for t in b.column(0):
                count.update(each(t.as_py() or ""))
                if len(count) > FLUSH:
                    yield from flush()
                    count.clear()
        yield from flush()

    return rows.select("text").mapInArrow(tidy(run), schema + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))


def _bytes(df: DataFrame) -> int:
    """Bytes of the column term, looked at only as far as the bound."""
    return df.select((F.octet_length("term") + 100).alias("b")).limit(MAX_BROADCAST // 100 + 1).agg(F.sum("b")).first()[0] or 0


def disclosure(
    docs: DataFrame, text: str = "text", context: int = CONTEXT, min_documents: int = MIN_DOCUMENTS, threshold: float = DISCLOSURE
) -> DataFrame:
    """term, entity, n, df, p, bits of every term that discloses a protected entity, from all documents.

    Entities are named kind:value, kind~holder and kind*. Each row of docs
    counts as a document, copies too. Null and empty texts hold nothing.
    """
    rows = pick(docs, text).select(F.col(text).alias("text"))

    def pairs(t):
        base, secrets = _all_spans(t)
        found = {(e, None) for k, s, z in base + secrets for e in _entities(k, t[s:z])}
        for (k, s, z), term, _, _ in _near(t, base + secrets, context):
            found.update((e, term) for e in _entities(k, t[s:z]))
        return found

    counts = materialize(_counted(rows, pairs, "entity string, term string"), "pii-pairs")
    near = counts.where(F.col("term").isNotNull() & (F.col("n") >= min_documents))
    wanted = materialize(near.select("term").distinct(), "pii-terms")
    if _bytes(wanted) <= MAX_BROADCAST:
        have = rows.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in wanted.collect()))
        df = _counted(rows, lambda t: {(w,) for w in {_term(x) for x in set(_WORD.findall(t))} & have.value}, "term string")
    else:
        df = _counted(rows, lambda t: {(_term(x),) for x in set(_WORD.findall(t))}, "term string").join(wanted, "term", "left_semi")
    entities = counts.where("term is null").select("entity", F.col("n").alias("ne"))
    told = near.join(df.withColumnRenamed("n", "df"), "term").join(entities, "entity")
    p = F.col("n") / F.col("df")
    told = told.withColumn("p", p).withColumn("bits", F.log2(p * F.lit(float(max(rows.count(), 1))) / F.col("ne")))
    return told.where((F.col("p") >= threshold) & (F.col("bits") > 0)).select("term", "entity", "n", "df", "p", "bits")


_SPAN = "array<struct<kind:string,start:int,stop:int>>"
_FOUND = f"doc_id long, text string, spans {_SPAN}, terms array<struct<kind:string,start:int,stop:int,action:string>>"


def _mark(told, context: int, removal: float):
    """Rows (doc_id, text and, unless told is given, what is told about their terms) -> all their spans."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    acts = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("action", pa.string())]))
    act = lambda p: "remove" if p >= removal else "generalise"

    def run(batches):
        if told is not None:
            anywhere = {w: p for (w, kind), p in told.value.items() if not kind}
        for b in batches:
            spans, terms = [], []
            own = b.column(2).to_pylist() if told is None else None
            for k, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                known = told.value if told is not None else {(r["term"], r["kind"]): r["p"] for r in own[k] or ()}
                base, secrets = _all_spans(text)
                best = {}
                if known:
                    if told is None:
                        anywhere = {w: p for (w, kind), p in known.items() if not kind}
                    # most texts hold none of these terms, so their distinct words are looked at first
                    if anywhere and any(_term(w) in anywhere for w in set(_WORD.findall(text))):
                        taken = _Taken((s, e) for _, s, e in base + secrets)
                        for m in _WORD.finditer(text):
                            p = anywhere.get(_term(m.group()))
                            if p is not None and not taken(*m.span()):
                                best[m.span()] = p
                    for (kind, _, _), term, a, z in _near(text, base + secrets, context):
                        p = known.get((term, kind))
                        if p is not None:
                            best[a, z] = max(p, best.get((a, z), 0.0))
                found = [(TERM, a, z, act(p)) for (a, z), p in best.items()] + [(SECRET, a, z, "remove") for _, a, z in secrets]
                spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
                terms.append([{"kind": k, "start": s, "stop": e, "action": x} for k, s, e, x in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kinds), pa.array(terms, acts)], names=["doc_id", "text", "spans", "terms"])

    return run


def _marked(docs: DataFrame, text: str, context: int, min_documents: int, threshold: float, removal: float) -> DataFrame:
    """doc_id, text, spans, terms."""
    spark = docs.sparkSession
    told = disclosure(docs, text, context, min_documents, threshold)
    # values and holders count wherever the term stands, kinds only near one of them
    kind = F.when(F.col("entity").endswith("*"), F.expr("substr(entity, 1, length(entity) - 1)")).otherwise("")
    told = materialize(told.groupBy("term", kind.alias("kind")).agg(F.max("p").alias("p")), "pii-told")
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    if _bytes(told) <= MAX_BROADCAST:
        known = spark.sparkContext.broadcast({(r.term, r.kind): r.p for r in told.collect()})
        return rows.mapInArrow(tidy(_mark(known, context, removal)), _FOUND)

    def words(batches):
        for b in batches:
            for stamp, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = list({_term(w) for w in set(_WORD.findall(t.as_py() or ""))})
                for i in range(0, len(own), 10_000):
                    part = own[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([stamp] * len(part), pa.string()), pa.array(part, pa.string())], names=["stamp", "term"])

    # by text, so copies, and rows without an id, get what is theirs
    stamped = rows.withColumn("stamp", F.sha2(F.col("text"), 256))
    some = stamped.select("stamp", "text").mapInArrow(tidy(words), "stamp string, term string").distinct().join(told, "term")
    some = some.groupBy(F.col("stamp").alias("__s")).agg(F.collect_list(F.struct("term", "kind", "p")).alias("told"))
    return stamped.join(some, F.col("stamp") == F.col("__s"), "left").select("doc_id", "text", "told").mapInArrow(tidy(_mark(None, context, removal)), _FOUND)


def find_personal_data(
    docs: DataFrame,
    text: str = "text",
    context: int = CONTEXT,
    min_documents: int = MIN_DOCUMENTS,
    threshold: float = DISCLOSURE,
    removal: float = REMOVAL,
) -> DataFrame:
    """One row per row of docs: doc_id, spans, terms.

    spans are the base spans (kind, start, stop; code points, stop exclusive),
    by kind as in KINDS, then start; terms the added ones (kind: 'term' or
    'secret'; start, stop, action: 'remove' or 'generalise'), by kind, then start.
    Added spans touch no base span. Terms may have any length. Null and empty texts have none; texts may be of any
    length. Copies count as documents, equal rows are treated alike, a null
    doc_id stays. Extra columns don't matter. An empty table gives no rows.
    """
    return _marked(docs, text, context, min_documents, threshold, removal).select("doc_id", "spans", "terms")


def sanitise(
    docs: DataFrame,
    text: str = "text",
    context: int = CONTEXT,
    min_documents: int = MIN_DOCUMENTS,
    threshold: float = DISCLOSURE,
    removal: float = REMOVAL,
) -> DataFrame:
    """doc_id, text with base values as <KIND>, revealing terms removed or generalised to <TERM>; a row per row of docs, each by its own text."""

    def run(batches):
        for b in batches:
            out = []
            for t, spans, terms in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("terms").to_pylist()):
                cuts = [(s["start"], s["stop"], f"<{s['kind'].upper()}>") for s in spans or ()]
                cuts += [(s["start"], s["stop"], "" if s["action"] == "remove" else "<TERM>") for s in terms or ()]
                done, parts = 0, []
                for s, e, put in sorted(cuts):
                    if e > done:
                        # of overlapping values the later one's rest goes, too
                        parts += [(t or "")[done:s], put]
                        done = e
                out.append(None if t is None else "".join(parts) + t[done:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _marked(docs, text, context, min_documents, threshold, removal).mapInArrow(tidy(run), "doc_id long, text string")

"""Values that requests carry: boxes, cursors, entity tags, encodings; colours of ids."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

LODS = ("high", "medium", "low")
FNV_START, FNV_PRIME = 2166136261, 16777619  # fixed values


class RequestError(ValueError):
    """A refused request: code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """'x1,y1,x2,y2' as four finite numbers with min <= max."""
    try:
        box = [float(x) for x in text.split(",")]
    except ValueError:
        raise RequestError("invalid_bbox", text) from None
    if len(box) != 4 or not all(abs(x) < float("inf") for x in box) or box[0] > box[2] or box[1] > box[3]:
        raise RequestError("invalid_bbox", text)
    return tuple(box)


def format_bbox(*sides: Column) -> Column:
    """'x1,y1,x2,y2' of 32-bit numbers in the fewest digits that read back as the same, whole ones without a point."""
    return F.array_join(F.array(*[F.regexp_replace((s.cast("float") + F.lit(0.0).cast("float")).cast("string"), "\\.0(?=$|E)", "") for s in sides]), ",")


#: Most different ids in a batch.
MAX_BATCH_IDS = 200


def batch_problem(ids: Column, limit: int = MAX_BATCH_IDS) -> Column:
    """Null, or what is wrong with a batch's ids: none, an empty one, or more than `limit` different ones."""
    n = F.size(F.array_distinct(ids))
    return F.when(ids.isNull() | (n == 0), "empty_batch").when(F.exists(ids, lambda i: i.isNull() | (i == "")), "invalid_id").when(n > limit, "batch_too_large")


def validate_lod(lod: str | None) -> str:
    if lod is None:
        raise RequestError("missing_lod", "lod is required")
    if lod not in LODS:
        raise RequestError("invalid_lod", lod)
    return lod


def encode_cursor(revision: str, lod: str, last_id: str, filters: dict) -> str:
    state = {"filters": filters, "lastScannedId": last_id, "lod": lod, "revisionId": revision}
    raw = json.dumps(state, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(token: str) -> dict:
    try:
        state = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        if not isinstance(state, dict) or not all(isinstance(state[k], str) for k in ("revisionId", "lod", "lastScannedId")) or not isinstance(state["filters"], dict):
            raise ValueError(token)
        return state
    except (ValueError, KeyError, TypeError):
        raise RequestError("invalid_cursor", token) from None


def resume(token: str | None, revision: str, lod: str, filters: dict) -> str | None:
    """The id after which to go on; a cursor of another revision, level or filter set is refused."""
    if token is None:
        return None
    state = decode_cursor(token)
    if (state["revisionId"], state["lod"], state["filters"]) != (revision, lod, filters):
        raise RequestError("cursor_filter_mismatch", "the cursor belongs to another revision, lod or filter set")
    return state["lastScannedId"]


def box_intersects(box: tuple[float, float, float, float]) -> Column:
    """Columns min_x, min_y, max_x, max_y against a closed box; all four comparisons reach the scan."""
    x0, y0, x1, y1 = box
    return (F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0)


def box_within(box: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = box
    return (F.col("min_x") >= x0) & (F.col("max_x") <= x1) & (F.col("min_y") >= y0) & (F.col("max_y") <= y1)


def etag(content: Column) -> Column:
    return F.concat(F.lit('"'), F.sha2(content, 256), F.lit('"'))


def etag_matches(if_none_match: Column, tag: Column) -> Column:
    """Weak comparison of a header's list, or *, with a tag; no header matches nothing."""
    bare = lambda t: F.regexp_replace(F.btrim(t), "^W/", "")
    listed = F.exists(F.split(if_none_match, ","), lambda t: bare(t) == bare(tag))
    return F.when(if_none_match.isNull() | (F.btrim(if_none_match) == ""), False).otherwise((F.btrim(if_none_match) == "*") | listed)


def accepts_gzip(header: Column) -> Column:
    """gzip's own quality decides, else that of *; 0 refuses, a malformed quality is 1, no header refuses."""
    items = F.filter(F.transform(F.split(header, ","), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    name = lambda x: F.btrim(F.element_at(F.split(x, ";"), 1))
    said = lambda x: F.btrim(F.regexp_extract(x, r";\s*q\s*=([^;]*)", 1))
    quality = lambda x: F.when(F.regexp_like(x, F.lit(r";\s*q\s*=")), F.coalesce(said(x).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
    last = lambda which: F.try_element_at(F.transform(F.filter(items, lambda x: name(x) == which), quality), F.lit(-1))
    return F.coalesce(F.coalesce(last("gzip"), last("*")) > 0, F.lit(False))


def fnv1a(text: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text of the basic plane, then over a seed."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.expr("0L") + F.ascii(c))
    step = lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return step(F.aggregate(codes, F.lit(FNV_START).cast("long"), step), F.lit(seed).cast("long"))


def colour(text: Column, seed: int = 0) -> list[Column]:
    """hue, saturation, value of an id's default colour, in ten-thousandths of their steps (exact integers)."""
    h = fnv1a(text, seed)
    return [(h % 10007).alias("hue_step"), (F.floor(h / 10007) % 4001).alias("saturation_step"), (F.floor(h / (10007 * 4001)) % 4001).alias("value_step")]


def shown_colour(override: Column, text: Column, seed: int = 0) -> list[Column]:
    """An id's colour: an override (struct of hue_step, saturation_step, value_step) as a whole, else its default."""
    names = ("hue_step", "saturation_step", "value_step")
    return [F.when(override.isNotNull(), override[n]).otherwise(c).alias(n) for n, c in zip(names, colour(text, seed))]


def nearest_rank(values: Column, fraction: float) -> Column:
    """Of values in order, the one at min(n - 1, int(fraction * n)); null of none."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.sort_array(values), F.least(n - 1, F.floor(F.lit(float(fraction)) * n).cast("int"))))

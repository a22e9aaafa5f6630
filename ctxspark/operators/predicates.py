"""Filters: metadata conditions, namespace scopes, vaults, entry filters and validity in time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"}


def variant_field(variant: str) -> Callable[[str, str], Column]:
    """Fields of a variant column, as a type, null where the field is missing or of another type."""
    return lambda key, kind: F.try_variant_get(F.col(variant), f"$.{key}", kind)


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"


def where(conditions: dict, field: Callable[[str, str], Column]) -> Column:
    """All conditions hold. A missing key passes $ne and $nin and fails everything else, but {key: None} asks for it.

    Ranges compare like with like: a string never lies in a numeric range.
    """
    out = F.lit(True)
    for key, wanted in conditions.items():
        for op, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if op not in OPS:
                raise ValueError(f"unknown operator {op}")
            if op in ("$in", "$nin"):
                hit = F.lit(False)
                for v in value:
                    hit = hit | F.coalesce(field(key, _kind(v)) == F.lit(v), F.lit(False))
                out = out & (hit if op == "$in" else ~hit)
                continue
            if value is None:
                missing = field(key, "string").isNull()
                out = out & (missing if op == "$eq" else ~missing if op == "$ne" else F.lit(False))
                continue
            c = field(key, _kind(value))
            if op == "$ne":
                out = out & (c.isNull() | (c != F.lit(value)))
            else:
                test = {"$eq": c == F.lit(value), "$gt": c > F.lit(value), "$gte": c >= F.lit(value), "$lt": c < F.lit(value), "$lte": c <= F.lit(value)}[op]
                out = out & F.coalesce(test, F.lit(False))
    return out


def normalize_namespace(path: str) -> str:
    parts = [p for p in path.strip().split("/") if p]
    return "/" + "/".join(parts)


def validate_vault(name: str) -> str:
    if not name or "/" in name or ":" in name:
        raise ValueError(f"bad vault name {name!r}")
    return name


def same_vault(*frames: DataFrame, vault: str = "vault") -> str | None:
    """The one vault that all rows of the frames are in, null if there are none; several are an error."""
    found: set[str] = set()
    for f in frames:
        found |= {r[0] for r in f.select(vault).distinct().limit(2).collect()}
    if len(found) > 1:
        raise ValueError(f"rows of several vaults: {sorted(map(str, found))}")
    return next(iter(found), None)


def is_under(namespace: str | Column, prefix: str) -> Column:
    """Whether the namespace is the prefix or below it; /a is not above /ab. Reaches the scan as equality and prefix."""
    ns, prefix = F.col(namespace) if isinstance(namespace, str) else namespace, normalize_namespace(prefix)
    return F.lit(True) if prefix == "/" else (ns == prefix) | ns.startswith(prefix + "/")


@dataclass(frozen=True)
class Scope:
    """Namespaces that are visible: under an include (none: all) and under no exclude."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def column(self, namespace: str | Column) -> Column:
        seen = F.lit(not self.include)
        for p in self.include:
            seen = seen | is_under(namespace, p)
        for p in self.exclude:
            seen = seen & ~is_under(namespace, p)
        return seen

    def intersect(self, other: Scope) -> Scope:
        """What both show; where nothing is left, everything is excluded."""
        below = lambda a, b: b == "/" or a == b or a.startswith(b + "/")
        mine, theirs = ([normalize_namespace(p) for p in s.include] for s in (self, other))
        both = tuple(dict.fromkeys([a for a in mine if any(below(a, b) for b in theirs)] + [b for b in theirs if any(below(b, a) for a in mine)])) if mine and theirs else tuple(mine or theirs)
        exclude = tuple(dict.fromkeys([*self.exclude, *other.exclude]))
        return Scope((), ("/",)) if mine and theirs and not both else Scope(both, exclude)


def live(expires_at: str, as_of: Column) -> Column:
    return F.col(expires_at).isNull() | (as_of < F.col(expires_at))


def edge_live(as_of: Column) -> Column:
    """Not invalidated, and valid_from <= as_of < valid_to where these are set."""
    return F.col("invalidated_at").isNull() & F.coalesce(F.col("valid_from") <= as_of, F.lit(True)) & F.coalesce(as_of < F.col("valid_to"), F.lit(True))


def entry_filters(user_id: object = None, session_id: object = None, memory_type: object = None, tags: list[str] | None = None, created_after: Column | None = None, created_before: Column | None = None) -> Column:
    """Equality, all tags present, and strict time bounds."""
    out = F.lit(True)
    for name, value in (("user_id", user_id), ("session_id", session_id), ("memory_type", memory_type)):
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    if tags:
        out = out & (F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0)
    if created_after is not None:
        out = out & (F.col("created_at") > created_after)
    if created_before is not None:
        out = out & (F.col("created_at") < created_before)
    return out


def search_entries(entries: DataFrame, query: str, top_k: int, as_of: Column, extra: Column | None = None) -> DataFrame:
    """Live entries that contain the query (case folded), best relevance first, ties by id."""
    keep = live("expires_at", as_of) & (F.contains(F.lower("content"), F.lit(query.lower())) if query else F.lit(True))
    return entries.where(keep if extra is None else keep & extra).orderBy(F.desc("relevance_score"), "id").limit(top_k)

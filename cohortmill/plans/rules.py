"""Rule trees: the declarative form of an audience, parsed from dicts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TimeWindow:
    """all_time, last_n_days (n), between_dates (start, end), before_date (end) or after_date (start)."""

    kind: str = "all_time"
    n: int | None = None
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class Attribute:
    key: str
    operator: str
    value: Any = None
    second_value: Any = None
    negate: bool = False
    logical_operator: str | None = None


@dataclass(frozen=True)
class PropertyFilter:
    name: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Event:
    name: str
    operator: str = "has_performed"
    value: Any = None
    window: TimeWindow = TimeWindow()
    properties: tuple[PropertyFilter, ...] = ()
    negate: bool = False
    logical_operator: str | None = None


@dataclass(frozen=True)
class Membership:
    segment_id: str
    operator: str = "is_member"
    negate: bool = False
    logical_operator: str | None = None


@dataclass(frozen=True)
class CrossBrand:
    brand: str
    condition: Any
    negate: bool = False
    logical_operator: str | None = None


@dataclass(frozen=True)
class Group:
    operator: str = "and"
    conditions: tuple[Any, ...] = ()
    negate: bool = False
    logical_operator: str | None = None


@dataclass(frozen=True)
class Definition:
    """An audience: rules, an order and a limit, set operations with others, a rank, and splits."""

    root: Group
    brand: str = "main"
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    set_operation: str | None = None
    set_members: tuple[Any, ...] = ()
    rank_by: str | None = None
    rank_top: bool = True
    rank_limit: int | None = None
    split: dict = field(default_factory=dict)


def parse_window(d: dict | None) -> TimeWindow:
    if not d:
        return TimeWindow()
    kind = d.get("type") or d.get("kind") or "all_time"
    if kind not in ("all_time", "last_n_days", "between_dates", "before_date", "after_date"):
        raise ValueError(f"unknown time window {kind!r}")
    return TimeWindow(kind, d.get("n") or d.get("days") or d.get("value"), d.get("start") or d.get("start_date"), d.get("end") or d.get("end_date"))


def parse_node(d: dict):
    """A node by its type; groups are known by their conditions, and what has no type is an attribute."""
    own, negate = d.get("logical_operator"), bool(d.get("negate", False))
    kind = d.get("type") or ("group" if "conditions" in d else "attribute")
    if own is not None and kind != "group" and own.lower() not in ("and", "or"):
        raise ValueError(f"unknown logical operator {own!r}")
    if kind == "group":
        op = (own or "and").lower()
        if op not in ("and", "or"):
            raise ValueError(f"unknown logical operator {own!r}")
        return Group(op, tuple(parse_node(x) for x in d.get("conditions", ())), negate, d.get("logical_operator_prefix"))
    if kind == "attribute":
        if d.get("time_window"):
            raise ValueError("attributes take no time window; use an event or a line-item attribute")
        return Attribute(d["attribute_key"], d["operator"], d.get("value"), d.get("second_value"), negate, own)
    if kind == "event":
        props = tuple(PropertyFilter(p.get("property") or p.get("name"), p["operator"], p.get("value")) for p in d.get("property_filters", ()))
        return Event(d["event_name"], d.get("operator", "has_performed"), d.get("count_value", d.get("value")), parse_window(d.get("time_window")), props, negate, own)
    if kind == "segment_membership":
        return Membership(str(d["segment_id"]), d.get("operator", "is_member"), negate, own)
    if kind == "cross_brand":
        return CrossBrand(d.get("target_brand") or d["brand"], parse_node(d.get("condition") or d["conditions"][0]), negate, own)
    raise ValueError(f"unknown node type {kind!r}")


def parse_definition(d: dict) -> Definition:
    root = d.get("root_group") or d.get("root") or d.get("rules") or d
    node = parse_node(root)
    if not isinstance(node, Group):
        node = Group("and", (node,))
    rank, sets = d.get("rank") or {}, d.get("set_operation") or {}
    if isinstance(sets, str):
        sets = {"operation": sets, "segments": d.get("set_members", ())}
    return Definition(
        node, d.get("brand_code") or d.get("brand") or "main", d.get("order_by"), str(d.get("order_direction", "asc")).lower() == "desc", d.get("limit"),
        sets.get("operation"), tuple(sets.get("segments", ())), rank.get("attribute_key"), str(rank.get("order", "desc")).lower() == "desc", rank.get("limit"), d.get("split") or {},
    )

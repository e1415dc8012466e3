"""Audiences: rule trees compiled to one DataFrame, and what is asked of it.

A tree becomes a Column over the profiles and what they join with: behaviour (ba), graph summary (gs), locations (loc), and
flags. Only sources that the tree names are joined, each once. Conditions over bill lines or events become flags: one
groupBy over all conditions of a source, so a tree with ten line-item conditions reads the lines once. Flags, not inner
joins, keep OR and negation right; where a whole tree is an AND, its conditions on lines, members and other brands are semi
and anti joins instead. Locations are deduplicated and joined left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import day, select_or_null
from cohortmill.functions.storage import written
from cohortmill.functions.windows import exact_bounds, first_rows, global_rank, ordered_hex, upto
from cohortmill.operators import domain
from cohortmill.operators.predicates import predicate
from cohortmill.plans import rules
from cohortmill.plans.catalog import attribute, listing

SUM_METRICS = ("total_bills", "total_spend", "total_visits")
METRICS = (*SUM_METRICS, "avg_spend", "avg_bills", "avg_visits", "spend_per_bill", "spend_per_visit")


#: Events that the behaviour mart tells. Fixed values.
_PURCHASES, _PROMOTIONS = ("purchase", "transaction"), ("promo_usage", "cashback")
_COUNTS = {
    "equals": lambda n, v: n == v,
    "greater_than": lambda n, v: n > v,
    "less_than": lambda n, v: n < v,
    "greater_than_or_equal": lambda n, v: n >= v,
    "less_than_or_equal": lambda n, v: n <= v,
}


@dataclass
class Brand:
    """A tenant's tables: profiles, behaviour, locations, graph, lines, events. Each is a frame or a function that builds it; a
    function with a parameter gets the columns that are asked for (None: all)."""

    name: str
    tables: Mapping[str, DataFrame | Callable[..., DataFrame]]
    segments: dict[str, DataFrame] = field(default_factory=dict)
    others: dict[str, Brand] = field(default_factory=dict)

    def table(self, name: str, columns: set[str] | None = None) -> DataFrame:
        t = self.tables.get(name)
        if t is None:
            raise ValueError(f"brand {self.name!r} has no table {name!r}")
        if not callable(t):
            return t
        return t(columns) if signature(t).parameters else t()

    def other(self, name: str) -> Brand:
        if name not in self.others:
            raise ValueError(f"unknown brand {name!r}")
        return self.others[name]


@dataclass
class _Needs:
    """What a tree reads beside the profiles."""

    aliases: set[str] = field(default_factory=set)
    columns: set[str] = field(default_factory=set)
    lines: dict[str, Column] = field(default_factory=dict)
    events: dict[str, dict[str, Column]] = field(default_factory=dict)
    here: list[Column] = field(default_factory=list)
    metrics: dict[str, dict[str, Column]] = field(default_factory=dict)
    members: dict[str, str] = field(default_factory=dict)
    #: Joins that decide on rows by themselves: how (left_semi or left_anti), the key, and the rows to meet.
    pushed: list[tuple[str, str, DataFrame]] = field(default_factory=list)
    brands: dict[str, rules.CrossBrand] = field(default_factory=dict)


class Engine:
    """Audiences of one brand as of one date."""

    def __init__(self, brand: Brand, as_of: str, dialect: str = "pg"):
        self.brand, self.as_of, self.dialect = brand, as_of, dialect

    # -- compiling ---------------------------------------------------------------------------------------------------

    def _leaf(self, key: str, operator: str, value, second, needs: _Needs) -> Column:
        if found := domain.metric(key, self.as_of):
            source, name, column, kind = found
            needs.metrics.setdefault(source, {})[name] = column
            return predicate(F.col(f"_{source}_{name}"), kind, operator, value, second, as_of=day(self.as_of), dialect=self.dialect)
        a = attribute(key)
        test = lambda c: predicate(c, a.kind, operator, value, second, as_of=day(self.as_of), dialect=self.dialect)
        if a.alias == "bt":
            name = f"_line{len(needs.lines)}"
            needs.lines[name] = test(a.expr())
            return F.coalesce(F.col(name), F.lit(False))
        needs.aliases.add(a.alias)
        needs.columns.add(a.column)
        return test(a.expr())

    def _purchase(self, e: rules.Event, needs: _Needs) -> Column:
        """Events that the behaviour mart tells: purchases by total_bills, with the window on the last bill's date; use of
        promotions by promo_bill_count, without windows."""
        needs.aliases.add("ba")
        if e.properties:
            raise ValueError(f"{e.name!r} has no properties in the mart")
        promo = e.name in _PROMOTIONS
        if not promo and e.name not in _PURCHASES:
            raise ValueError(f"unknown event {e.name!r}")
        if promo and e.window.kind != "all_time":
            raise ValueError(f"the mart doesn't say when {e.name!r} was; it takes no window")
        needs.columns |= {"promo_bill_count" if promo else "total_bills", "last_bill_date"}
        n, last, w = F.coalesce("promo_bill_count" if promo else "total_bills", F.lit(0)), F.col("last_bill_date"), e.window
        inside = {
            "all_time": lambda: F.lit(True), "last_n_days": lambda: last >= F.date_sub(day(self.as_of), int(w.n)), "after_date": lambda: last > day(w.start),
            "before_date": lambda: last < day(w.end), "between_dates": lambda: last.between(day(w.start), day(w.end)),
        }[w.kind]()
        inside = F.coalesce(inside, F.lit(False))
        if e.operator == "has_performed":
            return (n > 0) & inside
        if e.operator == "has_not_performed":
            return ~((n > 0) & inside)
        compare = _COUNTS.get(e.operator.removeprefix("performed_count_"))
        if compare is None or not e.operator.startswith("performed_count_"):
            raise ValueError(f"unknown event operator {e.operator!r}")
        return compare(n, int(e.value)) & inside

    def _event(self, e: rules.Event, needs: _Needs) -> Column:
        # In the pg dialect the mart tells purchases and promotions, whatever tables the brand has; in the other one the events do.
        if "events" not in self.brand.tables or self.dialect == "pg" and e.name in (*_PURCHASES, *_PROMOTIONS):
            return self._purchase(e, needs)
        ts = F.col("event_ts")
        here = F.col("event_name") == e.name
        w = e.window
        if w.kind == "last_n_days":
            here &= ts >= F.date_sub(day(self.as_of), int(w.n))
        if w.kind in ("between_dates", "after_date"):
            here &= ts >= F.lit(w.start).cast("timestamp_ntz") if w.kind == "between_dates" else ts > F.lit(w.start).cast("timestamp_ntz")
        if w.kind in ("between_dates", "before_date"):
            here &= F.to_date(ts) <= F.lit(w.end).cast("date") if w.kind == "between_dates" else ts < F.lit(w.end).cast("timestamp_ntz")
        for p in e.properties:
            value = F.col("properties")[p.name]
            numeric = p.operator.startswith(("greater", "less")) or isinstance(p.value, (int, float)) and not isinstance(p.value, bool)
            here &= predicate(value.try_cast("double") if numeric else value, "float" if numeric else "string", p.operator, p.value, as_of=day(self.as_of), dialect=self.dialect)
        n = f"_event{len(needs.events)}"
        needs.here.append(here)
        needs.events[n] = {f"{n}_n": F.count(F.when(here, 1)), f"{n}_first": F.min(F.when(here, F.to_date(ts))), f"{n}_last": F.max(F.when(here, F.to_date(ts)))}
        count, first, last = F.coalesce(F.col(f"{n}_n"), F.lit(0)), F.col(f"{n}_first"), F.col(f"{n}_last")
        op = e.operator
        if op == "has_performed":
            return count > 0
        if op == "has_not_performed":
            return count == 0
        if op.startswith("performed_count_") and op.removeprefix("performed_count_") in _COUNTS:
            return _COUNTS[op.removeprefix("performed_count_")](count, int(e.value))
        if op == "performed_in_last_n_days":
            return F.coalesce(last >= F.date_sub(day(self.as_of), int(e.value)), F.lit(False))
        for side, c in (("first", first), ("last", last)):
            if op == f"{side}_performed_before":
                return F.coalesce(c < day(e.value), F.lit(False))
            if op == f"{side}_performed_after":
                return F.coalesce(c > day(e.value), F.lit(False))
        raise ValueError(f"unknown event operator {op!r}")

    def _node(self, node, needs: _Needs) -> Column:
        if isinstance(node, rules.Group):
            out = self._group(node, needs)
        elif isinstance(node, rules.Attribute):
            out = self._leaf(node.key, node.operator, node.value, node.second_value, needs)
        elif isinstance(node, rules.Event):
            out = self._event(node, needs)
        elif isinstance(node, rules.Membership):
            if node.operator not in ("is_member", "is_not_member"):
                raise ValueError(f"unknown membership operator {node.operator!r}")
            if node.segment_id not in self.brand.segments:
                raise ValueError(f"segment {node.segment_id!r} is not materialised")
            name = needs.members.setdefault(node.segment_id, f"_member{len(needs.members)}")
            found = F.col(name).isNotNull()
            out = found if node.operator == "is_member" else ~found
        elif isinstance(node, rules.CrossBrand):
            name = f"_brand{len(needs.brands)}"
            needs.brands[name] = node
            out = F.col(name).isNotNull()
        else:
            raise ValueError(f"unknown node {node!r}")
        return ~out if node.negate else out

    def _group(self, group: rules.Group, needs: _Needs) -> Column:
        """Strictly from left to right: each condition may say how it joins what stands before it. An empty group holds."""
        out = None
        for node in group.conditions:
            if isinstance(node, rules.Group) and not node.conditions:
                continue
            c = self._node(node, needs)
            how = (node.logical_operator or group.operator).lower()
            out = c if out is None else (out & c if how == "and" else out | c)
        return F.lit(True) if out is None else out

    # -- planning: what is a semi or anti join -----------------------------------------------------------------------

    def _and_parts(self, group: rules.Group) -> list | None:
        """The conditions that must all hold, nested AND groups among them taken apart; None if the group isn't such a list."""
        out: list = []
        for i, node in enumerate(n for n in group.conditions if not (isinstance(n, rules.Group) and not n.conditions)):
            if i and (node.logical_operator or group.operator).lower() != "and":
                return None
            inner = self._and_parts(node) if isinstance(node, rules.Group) and not node.negate else None
            out += [node] if inner is None else inner
        return out

    def _lines_test(self, node) -> tuple[Column, bool] | None:
        """The condition on a bill line that a node asks for, and whether it is negated; also of an OR over such conditions."""
        if isinstance(node, rules.Attribute) and not domain.metric(node.key, self.as_of):
            a = attribute(node.key)
            if a.alias == "bt":
                return predicate(a.expr(), a.kind, node.operator, node.value, node.second_value, as_of=day(self.as_of), dialect=self.dialect), node.negate
        if isinstance(node, rules.Group) and len(node.conditions) > 1:
            found = [self._lines_test(n) for n in node.conditions]
            either = all((n.logical_operator or node.operator).lower() == "or" for n in node.conditions[1:])
            # Some line that meets the one or the other: EXISTS goes over OR, not over AND.
            if either and all(f and not f[1] for f in found):
                return reduce(lambda a, b: a | b, (f[0] for f in found)), node.negate
        return None

    def _push_lines(self, test: Column, negated: bool, needs: _Needs) -> None:
        lines = self._lines("store_business_region" in str(test)).where(test).select(F.right("mobile_number", F.lit(10)).alias("_mobile"))
        needs.pushed.append(("left_anti" if negated else "left_semi", "_mobile", lines))

    def _push(self, node, needs: _Needs) -> bool:
        """Take the node as a semi or anti join, if it is one."""
        if found := self._lines_test(node):
            self._push_lines(*found, needs)
            return True
        if isinstance(node, rules.Membership) and node.operator in ("is_member", "is_not_member") and node.segment_id in self.brand.segments:
            inside = (node.operator == "is_member") != node.negate
            needs.pushed.append(("left_semi" if inside else "left_anti", "customer_id", self.brand.segments[node.segment_id].select("customer_id")))
            return True
        if isinstance(node, rules.CrossBrand):
            needs.pushed.append(("left_anti" if node.negate else "left_semi", "corporate_id", self._corporate(node)))
            return True
        return False

    def _lines(self, with_region: bool) -> DataFrame:
        lines = self.brand.table("lines")
        if with_region:
            lines = lines.join(self.brand.table("locations").select("store_code", "store_business_region").dropDuplicates(["store_code"]), "store_code", "left")
        return lines

    def _corporate(self, node: rules.CrossBrand) -> DataFrame:
        other = Engine(self.brand.other(node.brand), self.as_of, self.dialect)
        return other.frame(rules.Group("and", (node.condition,))).select("corporate_id").where("corporate_id IS NOT NULL").distinct()

    def _condition(self, root: rules.Group, needs: _Needs) -> Column:
        """Conditions that hold or fail by the presence of other rows alone become joins where all of the tree must hold; under OR
        and within negated groups they are flags."""
        if found := self._lines_test(root):
            self._push_lines(found[0], False, needs)  # a root isn't negated
            return F.lit(True)
        parts = self._and_parts(root)
        if parts is None:
            return self._group(root, needs)
        out = F.lit(True)
        for node in parts:
            if not self._push(node, needs):
                out = out & self._node(node, needs)
        return out

    # -- joining -----------------------------------------------------------------------------------------------------

    def _base(self, needs: _Needs) -> DataFrame:
        p = self.brand.table("profiles").withColumnRenamed("unified_id", "customer_id").withColumn("unified_id", F.col("customer_id"))
        if needs.lines or any(key == "_mobile" for _, key, _ in needs.pushed):
            p = p.withColumn("_mobile", F.right("canonical_mobile", F.lit(10)))
        for how, key, rows in needs.pushed:
            p = p.join(rows, key, how)
        have = {c.lower() for c in p.columns}

        def join(other: DataFrame, key: str) -> None:
            nonlocal p
            fresh = [c for c in other.columns if c == key or c.lower() not in have]
            p = p.join(other.select(*fresh), key, "left")
            have.update(c.lower() for c in fresh)

        if "ba" in needs.aliases:
            join(self.brand.table("behavior", needs.columns), "customer_id")
        if "gs" in needs.aliases:
            join(self.brand.table("graph").withColumnRenamed("unified_id", "customer_id"), "customer_id")
        if "loc" in needs.aliases:
            loc = self.brand.table("locations")
            loc = first_rows(loc.withColumn("_store", F.trim("store_code")), ["_store"], [F.asc("store_code")]).select("_store", *[c for c in loc.columns if c.startswith("store_") and c != "store_code"])
            p = p.withColumn("_store", F.trim("registered_store")).join(loc, "_store", "left")
        if needs.lines:
            lines = self._lines(any("store_business_region" in str(c) for c in needs.lines.values()))
            # Lines for which no condition holds change no flag: they go before the shuffle.
            lines = lines.where(reduce(lambda a, b: a | b, needs.lines.values()))
            flags = lines.groupBy(F.right("mobile_number", F.lit(10)).alias("_mobile")).agg(*(F.bool_or(c).alias(n) for n, c in needs.lines.items()))
            p = p.join(flags, "_mobile", "left")
        if needs.events:
            counted = self.brand.table("events").where(reduce(lambda a, b: a | b, needs.here)).groupBy("customer_id").agg(*(c.alias(n) for e in needs.events.values() for n, c in e.items()))
            p = p.join(counted, "customer_id", "left")
        for source, asked in needs.metrics.items():
            made = domain.metrics(domain.source_rows(source, self.brand.table), asked)
            p = p.join(made.select("customer_id", *(F.col(m).alias(f"_{source}_{m}") for m in asked)), "customer_id", "left")
        for segment, name in needs.members.items():
            p = p.join(self.brand.segments[segment].select("customer_id").distinct().withColumn(name, F.lit(True)), "customer_id", "left")
        for name, node in needs.brands.items():
            p = p.join(self._corporate(node).withColumn(name, F.lit(True)), "corporate_id", "left")
        return p

    def frame(self, root: rules.Group, carry: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
        """Profiles for which the tree holds, one row each: all profile columns, and the carried attributes as `_<key>`."""
        needs = _Needs()
        condition = self._condition(root, needs)
        carried = [attribute(k) for k in carry]
        needs.aliases |= {a.alias for a in carried}
        needs.columns |= {a.column for a in carried}
        base = self._base(needs).where(condition)
        return base.select("*", *(a.expr().alias(f"_{a.key}") for a in carried))

    # -- audiences ---------------------------------------------------------------------------------------------------

    def segment(self, d: rules.Definition | dict, carry: Sequence[str] = ()) -> DataFrame:
        """customer_id (distinct) and carried attributes: filter, set operation, rank, order and limit, in that order."""
        d = rules.parse_definition(d) if isinstance(d, dict) else d
        carry = list(dict.fromkeys([*carry, *[k for k in (d.rank_by, d.order_by) if k]]))
        out = self.frame(d.root, carry).select("customer_id", *(f"`_{k}`" for k in carry)).dropDuplicates(["customer_id"])
        if d.set_operation:
            ids = set_operation(d.set_operation, [out.select("customer_id"), *(self._member(m) for m in d.set_members)])
            if carry:
                whole = self.frame(rules.Group(), carry).select("customer_id", *(f"`_{k}`" for k in carry))
                out = whole.join(ids, "customer_id", "left_semi").dropDuplicates(["customer_id"])
            else:
                out = ids
        if d.rank_by:
            out = ranked(out, f"_{d.rank_by}", d.rank_top, d.rank_limit)
        if d.order_by:
            c = F.col(f"`_{d.order_by}`")
            out = out.orderBy(c.desc_nulls_last() if d.descending else c.asc_nulls_last(), "customer_id")
        return out.limit(d.limit) if d.limit is not None else out

    def _member(self, m) -> DataFrame:
        """A set operation's member: a materialised segment's id, or a definition."""
        if isinstance(m, dict) and m.get("segment_id") is not None and "conditions" not in m:
            m = str(m["segment_id"])
        if isinstance(m, str):
            if m not in self.brand.segments:
                raise ValueError(f"segment {m!r} is not materialised")
            return self.brand.segments[m].select("customer_id")
        return self.segment(m).select("customer_id")

    def count(self, d) -> DataFrame:
        return self.segment(d).agg(F.count("*").alias("audience_count"))

    def preview(self, d, limit: int = 100) -> DataFrame:
        """The first rows by customer_id, with contact columns (those of the dialect)."""
        d = rules.parse_definition(d) if isinstance(d, dict) else d
        frame = self.frame(d.root)
        if self.dialect == "athena":
            rows = frame.select("customer_id", "email", *select_or_null(frame, ["first_name", "last_name", "city", "state"]))
        else:
            rows = frame.select("customer_id", F.col("canonical_mobile").alias("mobile"), F.col("display_name").alias("name"), "email", "pincode", "registered_store", "city")
        if d.set_operation or d.rank_by or d.limit is not None:
            rows = rows.join(self.segment(d).select("customer_id"), "customer_id", "left_semi")
        return rows.orderBy("customer_id").limit(limit)

    def summary(self, d, metrics: Sequence[str] = METRICS) -> DataFrame:
        """audience_size and the asked metrics; unknown ones are left out, nothing counts as 0."""
        carry = [f"txn.{m}" for m in SUM_METRICS]
        rows = self.segment(d, carry)
        col = {m: F.col(f"`_txn.{m}`") for m in SUM_METRICS}
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = {m: zero(F.sum(col[m])) for m in SUM_METRICS}
        made = {m: sums[m].cast("double") for m in SUM_METRICS}
        made |= {f"avg_{k}": F.round(zero(F.avg(zero(col[f"total_{k}"]).cast("double"))), 6) for k in ("spend", "bills", "visits")}
        made |= {f"spend_per_{k}": F.round(zero(F.try_divide(sums["total_spend"].cast("double"), sums[f"total_{k}s"].cast("double"))), 6) for k in ("bill", "visit")}
        return rows.agg(F.count("*").alias("audience_size"), *(made[m].alias(m) for m in metrics if m in made))

    def split_percent(self, d, parts: Sequence[int | None]) -> DataFrame:
        """customer_id and split (from 0): shares in percent of the audience ordered by customer_id; None shares equally."""
        shares = [100 // len(parts) if p is None else p for p in parts]
        if sum(shares) > 100 or min(shares) < 0:
            raise ValueError("shares add up to more than 100")
        ids = self.segment(d).select("customer_id")
        hexed = ordered_hex(F.col("customer_id"), ids.schema["customer_id"].dataType)
        ids = written(ids.select("customer_id", hexed.alias("h")))
        n, ends, seen = ids.count(), [], 0
        for s in shares:
            seen += s
            ends.append(seen * (n // 100) + min(seen, n % 100) if n >= 100 else seen * n // 100)
        bounds = exact_bounds(ids.select("h", F.lit(0).cast("long").alias("v0")), [lambda _: [e for e in ends if 0 < e < n]])[0]
        split = F.lit(None)
        for i, e in reversed(list(enumerate(ends))):
            if e:
                split = F.when(F.lit(True) if e >= n else upto(F.lit(0), F.col("h"), bounds[e]), i).otherwise(split)
        return ids.select("customer_id", split.cast("int").alias("split")).where("split IS NOT NULL")

    def split_attribute(self, d, key: str, values: Sequence) -> DataFrame:
        """customer_id and split: the value it has, or Remainder (other values and nulls)."""
        rows = self.segment(d, [key])
        a = attribute(key)
        out = None
        for v in values:
            here = predicate(F.col(f"`_{key}`"), a.kind, "equals", v, as_of=day(self.as_of), dialect=self.dialect)
            out = F.when(here, F.lit(str(v))) if out is None else out.when(here, F.lit(str(v)))
        return rows.select("customer_id", out.otherwise("Remainder").alias("split") if out is not None else F.lit("Remainder").alias("split"))

    def estimate(self, d) -> dict:
        """Counts of the audience, of each member of its set operation, and of its splits; the audience is computed once."""
        d = rules.parse_definition(d) if isinstance(d, dict) else d
        base = self.segment(d).persist()
        try:
            out = {"audience_count": base.count()}
            if d.set_operation:
                out["members"] = [self._member(m).distinct().count() for m in d.set_members]
            if d.split.get("type") == "percent":
                rows = self.split_percent(d, [p.get("percent") for p in d.split["splits"]])
                out["splits"] = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
            elif d.split.get("type") == "attribute":
                rows = self.split_attribute(d, d.split["attribute_key"], [p["value"] for p in d.split["splits"]])
                out["splits"] = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
            return out
        finally:
            base.unpersist()

    def distinct_values(self, key: str, limit: int = 500) -> DataFrame:
        """Sorted distinct non-blank values of an attribute, as text."""
        a = attribute(key)
        rows = self.brand.table("lines").select(a.expr().cast("string").alias("value")) if a.alias == "bt" else self.frame(rules.Group(), [key]).select(F.col(f"`_{key}`").cast("string").alias("value"))
        return rows.where("value IS NOT NULL AND trim(value) <> ''").distinct().orderBy("value").limit(limit)

    def materialize(self, segment_id: str, d, path: str) -> DataFrame:
        """Write the audience's ids and register it for membership conditions."""
        self.segment(d).select("customer_id").write.mode("overwrite").parquet(path)
        self.brand.segments[segment_id] = self.brand.table("profiles").sparkSession.read.parquet(path)
        return self.brand.segments[segment_id]

    def explain(self, d) -> str:
        """The plan, without running it."""
        return self.segment(d)._jdf.queryExecution().toString()

    @staticmethod
    def attributes(category: str | None = None) -> list[dict]:
        return [{"key": a.key, "type": a.kind, "category": a.category} for a in listing(category)]


def ranked(rows: DataFrame, column: str, top: bool = True, limit: int | None = None) -> DataFrame:
    """rank_position by the column, nulls last, ties by customer_id. With a limit the rows are chosen by a top-n first."""
    c = F.col(f"`{column}`")
    order = [c.desc_nulls_last() if top else c.asc_nulls_last(), F.asc("customer_id")]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
        return rows.withColumn("rank_position", F.row_number().over(Window.orderBy(*order)))
    return global_rank(rows, order, "rank_position")


def set_operation(kind: str, segments: Sequence[DataFrame]) -> DataFrame:
    """union, overlap, exclude or exclude_overlap (the first without the others) of customer_id sets; of no sets, an empty one."""
    if kind not in ("union", "overlap", "exclude", "exclude_overlap"):
        raise ValueError(f"unknown set operation {kind!r}")
    if not segments:
        return SparkSession.active().createDataFrame([], "customer_id string")
    frames = [s.select("customer_id").distinct() for s in segments]
    if kind == "union":
        return reduce(lambda a, b: a.unionByName(b), frames).distinct()
    return reduce(lambda a, b: a.join(b, "customer_id", "left_semi" if kind == "overlap" else "left_anti"), frames)

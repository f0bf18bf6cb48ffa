"""Two pipe-style languages: aggregation pipes and graph pipes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, dml, graph
from ..types import BadValue, check_number

_PAIR = re.compile(r'([^\s:]+):("[^"]*"|[^\s|]+)')


@dataclass(frozen=True)
class Condition:
    """attribute:value, attribute:"text" or attribute:lo..hi."""

    name: str
    lo: int | str
    hi: int | None = None

    def column(self):
        return F.col(self.name) == F.lit(self.lo) if self.hi is None else F.col(self.name).between(self.lo, self.hi)


def _number(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text):
        raise BadValue(f"invalid: {text}")
    return check_number(int(text))


def conditions(text: str) -> list[Condition]:
    out = []
    for name, value in _PAIR.findall(text):
        if len(value) > 1 and value[0] == value[-1] == '"':
            out.append(Condition(name, value[1:-1]))
        elif ".." in value:
            lo, hi = (_number(v) for v in value.split("..", 1))
            if lo > hi:
                raise BadValue(f"{value}: a range must not end before it begins")
            out.append(Condition(name, lo, hi))
        else:
            out.append(Condition(name, _number(value)))
    return out


def _matching(df: DataFrame, conds: list[Condition], strict: bool) -> DataFrame:
    if not conds:
        raise BadValue("at least one attribute:value is needed")
    if any(c.name not in df.columns for c in conds):
        return df.limit(0)
    if strict:
        for c in conds:
            if isinstance(c.lo, str) and df.where(c.column()).isEmpty():
                raise BadValue(f"no row has the text {c.lo!r}")
    for c in conds:
        df = df.where(c.column())
    return df


def _quoted_split(text: str) -> list[str]:
    """Split at | outside double quotes."""
    return [p.strip() for p in re.findall(r'(?:"[^"]*"?|[^|"])+', text)]


_SIMPLE = {"sum": agg.sum_, "avg": agg.avg, "min": agg.min_, "max": agg.max_, "distinct": agg.distinct}
_GROUPED = {"sum": agg.group_sum, "avg": agg.group_avg, "min": agg.group_min, "max": agg.group_max}


def pipe(df: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """``conditions [| group k] [| count | sum x | avg x | min x | max x | distinct x]``.

    Also the edits ``+ pairs`` (new entity), ``~ eid pairs`` (change) and ``- eid``
    (delete), which give the new table. ``strict`` refuses texts that no row has, at
    the price of a job each; else they find nothing."""
    text = text.strip()
    if not text:
        raise BadValue("empty")
    if text[0] in "+~-":
        return _edit(df, text[0], text[1:].strip())
    first, *stages = _quoted_split(text)
    rows = _matching(df, conditions(first), strict)
    steps = [s.split() for s in stages]
    if not steps:
        return rows.select("eid")
    head, rest = steps[0], steps[1:]
    if head[0] == "group":
        if len(head) != 2 or len(rest) > 1:
            raise BadValue("group takes one attribute and one aggregate")
        op = rest[0] if rest else ["count"]
        if op == ["count"]:
            return agg.group_count(rows, head[1])
        if len(op) == 2 and op[0] in _GROUPED:
            return _GROUPED[op[0]](rows, head[1], op[1])
        raise BadValue(f"unknown aggregate: {' '.join(op)}")
    if rest:
        raise BadValue("stages after an aggregate")
    if head == ["count"]:
        return agg.count(rows)
    if len(head) == 2 and head[0] in _SIMPLE:
        return _SIMPLE[head[0]](rows, head[1])
    raise BadValue(f"unknown stage: {' '.join(head)}")


def _edit(df: DataFrame, kind: str, rest: str) -> DataFrame:
    if kind == "-":
        return dml.delete(df, F.col("eid") == _number(rest))
    head, _, pairs = rest.partition(" ") if kind == "~" else ("", "", rest)
    values = {}
    for c in conditions(pairs):
        if c.hi is not None:
            raise BadValue("a range cannot be set")
        values[c.name] = c.lo
    if not values:
        raise BadValue("nothing to set")
    for n, v in values.items():
        df = dml.add_column(df, n, "string" if isinstance(v, str) else "bigint")
    if kind == "~":
        return dml.tie(df, F.col("eid") == _number(head), values)
    new = df.agg(F.coalesce(F.max("eid") + 1, F.lit(0)).alias("eid"))
    return df.unionByName(new.select("eid", *(F.lit(v).cast(df.schema[n].dataType).alias(n) for n, v in values.items())), allowMissingColumns=True)


def graph_pipe(df: DataFrame, text: str) -> DataFrame:
    """``conditions | follow a b | reverse a | where pairs | bfs a depth | select x y |
    get x | extract x | count`` over one table whose reference columns point into itself."""
    first, *stages = _quoted_split(text.strip()) or [""]
    eids = _matching(df, conditions(first), False).select("eid")
    for s in stages:
        cmd, *args = s.split() or [""]
        if cmd != "count" and not args:
            raise BadValue(f"{cmd}: nothing named")
        if cmd == "count":
            return agg.count(eids)
        if cmd == "follow":
            eids = graph.follow(eids, [(df, a) for a in args])
        elif cmd in ("reverse", "rev"):
            eids = graph.reverse(eids, df, args[0])
        elif cmd == "where":
            keep = _matching(df, conditions(s.split(None, 1)[1]), False)
            eids = eids.join(keep.select("eid"), "eid", "left_semi")
        elif cmd == "bfs":
            if len(args) < 2 or not args[1].isdigit():
                raise BadValue("bfs: an attribute and a depth")
            eids = graph.bfs(eids, df, args[0], int(args[1])).select("eid")
        elif cmd == "extract":
            return eids.join(df.select("eid", F.col(args[0]).alias("value")), "eid").where("value is not null").select("value") if args[0] in df.columns else eids.limit(0).select(F.col("eid").alias("value"))
        elif cmd in ("select", "get"):
            names = args if cmd == "select" else args[:1]
            known = [F.col(n) if n in df.columns else F.lit(None).cast("bigint").alias(n) for n in names]
            return eids.join(df.select("eid", *known), "eid", "left")
        else:
            raise BadValue(f"unknown command: {cmd}")
    return eids

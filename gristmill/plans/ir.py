"""The query plan as data, read from JSON-like dictionaries."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

# Other names of the filter operations.
OPS = ("match", "eq", "ne", "in", "contains", "gt", "ge", "lt", "le", "between", "isnull", "notnull")
OP_NAMES = {"gte": "ge", "lte": "le", "greater": "gt", "less": "lt", "ge=": "ge", "le=": "le", "=": "eq", "==": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le"}


class PlanError(ValueError):
    """A plan that cannot be read or bound; ``issues`` says why, one (kind, message) each."""

    def __init__(self, issues: list[tuple[str, str]]):
        super().__init__("; ".join(message for _, message in issues))
        self.issues = issues


@dataclass
class Filter:
    column: str
    op: str
    value: Any = None
    or_null: bool = False


@dataclass
class Aggregation:
    fn: str
    column: str | None = None
    alias: str | None = None


@dataclass
class Join:
    right_table: str
    left_column: str
    right_column: str


@dataclass
class Sort:
    by: str
    desc: bool = True


@dataclass
class Derived:
    alias: str
    kind: str  # pct_of_total or ratio
    num: str
    den: str | None = None


@dataclass
class Compare:
    left_table: str
    right_table: str
    key: str
    measures: list[str]
    left_label: str = "left"
    right_label: str = "right"
    left_filters: list[Filter] = field(default_factory=list)
    right_filters: list[Filter] = field(default_factory=list)


@dataclass
class Plan:
    table: str = ""
    join: Join | None = None
    filters: list[Filter] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[Aggregation] = field(default_factory=list)
    having: list[Filter] = field(default_factory=list)
    derived: list[Derived] = field(default_factory=list)
    union: list[str] = field(default_factory=list)
    compare: Compare | None = None
    select: list[str] = field(default_factory=list)
    sort: Sort | None = None
    limit: int | None = None
    requires_code: bool = False
    clarification: str | None = None
    intent: str = ""

    @staticmethod
    def from_dict(d: dict) -> Plan:
        """Read a plan; parts of the wrong shape are left out, as planners do not always keep to the grammar."""
        d = d or {}
        filters = lambda key, src=d: [_filter(f) for f in _dicts(src.get(key)) if f.get("column")]
        join, sort, compare = d.get("join"), d.get("sort"), d.get("compare")
        if isinstance(sort, list):
            sort = sort[0] if sort else None
        if isinstance(sort, str):
            sort = {"by": sort}
        try:
            limit = int(d["limit"]) if d.get("limit") is not None else None
        except (TypeError, ValueError):
            limit = None
        return Plan(
            table=str(d.get("table") or ""),
            join=Join(*(str(join[k]) for k in ("right_table", "left_column", "right_column"))) if isinstance(join, dict) and all(join.get(k) for k in ("right_table", "left_column", "right_column")) else None,
            filters=filters("filters"),
            group_by=_names(d.get("group_by")),
            aggregations=[Aggregation(str(a.get("fn", "")).lower(), a.get("column") or None, a.get("alias") or None) for a in _dicts(d.get("aggregations")) if a.get("fn")],
            having=filters("having"),
            derived=[Derived(str(x["alias"]), str(x.get("kind", "")), str(x.get("num") or ""), x.get("den") or None) for x in _dicts(d.get("derived")) if x.get("alias")],
            union=_names(d.get("union")),
            compare=Compare(
                str(compare.get("left_table", "")), str(compare.get("right_table", "")), str(compare.get("key", "")), _names(compare.get("measures")),
                str(compare.get("left_label") or "left"), str(compare.get("right_label") or "right"),
                [_filter(f) for f in _dicts(compare.get("left_filters"))], [_filter(f) for f in _dicts(compare.get("right_filters"))],
            ) if isinstance(compare, dict) else None,
            select=_names(d.get("select")),
            sort=Sort(str(sort["by"]), bool(sort.get("desc", True))) if isinstance(sort, dict) and sort.get("by") else None,
            limit=limit if limit and limit > 0 else None,
            requires_code=bool(d.get("requires_code")),
            clarification=d.get("clarification") or None,
            intent=str(d.get("intent") or ""),
        )

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, [], "", False)}


def _dicts(value: Any) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _names(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [str(x) for x in value if x] if isinstance(value, list) else []


def _filter(f: dict) -> Filter:
    op = str(f.get("op", "match")).strip().lower()
    return Filter(str(f.get("column", "")), OP_NAMES.get(op, op), f.get("value"), bool(f.get("or_null", False)))

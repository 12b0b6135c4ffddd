"""Query options: an immutable list of steps, applied to a DataFrame in a fixed order.

``apply`` runs joins, conditions, projection, order, offset and limit, so options may be given in
any order; ``apply_conditions`` runs only what decides which rows count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists above this length become a semi join instead of an IN predicate.
IN_LIST = 1000
#: Page size of requests when none is given, and the most that is allowed.
PAGE_SIZE, MOST_PAGE_SIZE = 20, 100

_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "ILIKE": lambda c, v: c.ilike(v),
    "IN": lambda c, v: c.isin(list(v)),
    "NOT IN": lambda c, v: ~c.isin(list(v)),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
    "BETWEEN": lambda c, v: c.between(v[0], v[1]),
}


def compare(column: str, operator: str, value: object = None) -> Column:
    """One of the 13 comparisons; an unknown operator means equality."""
    return _OPERATORS.get(operator.upper(), _OPERATORS["="])(F.col(column), value)


@dataclass(frozen=True)
class Query:
    """What a caller asks of a table."""

    joins: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    conditions: tuple[Column, ...] = ()
    semis: tuple[tuple[str, tuple], ...] = ()
    columns: tuple[str, ...] = ()
    orders: tuple[Column, ...] = ()
    count: int = 0
    skip: int = 0
    params: dict[str, object] = field(default_factory=dict)

    def where(self, column: str, operator: str, value: object = None) -> Query:
        return replace(self, conditions=(*self.conditions, compare(column, operator, value)))

    def order_by(self, column: str, descending: bool = False) -> Query:
        key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
        return replace(self, orders=(*self.orders, key))

    def limit(self, n: int) -> Query:
        return replace(self, count=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def paginate(self, page: int, size: int) -> Query:
        """Page from 1; a page or size below 1 counts as page 1 and size 10."""
        size = size if size >= 1 else 10
        return replace(self, count=size, skip=(max(page, 1) - 1) * size)

    def apply_conditions(self, df: DataFrame) -> DataFrame:
        df = reduce(lambda d, j: j(d), self.joins, df)
        for column, values in self.semis:
            keys = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {dict(df.dtypes)[column]}")
            df = df.join(keys.distinct(), column, "left_semi")
        return reduce(lambda d, c: d.where(c), self.conditions, df)

    def apply(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """All options; without an order, rows come by ``key`` if one is given."""
        df = self.apply_conditions(df)
        if orders := self.orders or ((F.col(key).asc(),) if key else ()):
            df = df.orderBy(*orders)
        if self.skip > 0:
            df = df.offset(self.skip)
        if self.count > 0:
            df = df.limit(self.count)
        return df.selectExpr(*self.columns) if self.columns else df

    def number(self, df: DataFrame, distinct: str | None = None) -> DataFrame:
        rows = self.apply_conditions(df)
        return rows.agg((F.count_distinct(distinct) if distinct else F.count("*")).alias("n"))


Option = Callable[[Query], Query]


def build(*options: Option) -> Query:
    return reduce(lambda q, option: option(q), options, Query())


def with_condition(column: str, value: object) -> Option:
    return lambda q: q.where(column, "=", value)


def with_condition_in(column: str, values: Iterable) -> Option:
    """IN; a long list is joined instead. An empty list matches nothing."""
    values = tuple(values)
    if len(values) > IN_LIST:
        return lambda q: replace(q, semis=(*q.semis, (column, values)))
    return lambda q: q.where(column, "IN", values) if values else with_where("false")(q)


def with_where(sql: str) -> Option:
    return lambda q: replace(q, conditions=(*q.conditions, F.expr(sql)))


def with_select(*expressions: str) -> Option:
    return lambda q: replace(q, columns=(*q.columns, *expressions))


def with_order_asc(column: str) -> Option:
    return lambda q: q.order_by(column)


def with_order_desc(column: str) -> Option:
    return lambda q: q.order_by(column, descending=True)


def with_raw_order(sql: str) -> Option:
    return lambda q: replace(q, orders=(*q.orders, F.expr(sql)))


def with_limit(n: int) -> Option:
    return lambda q: q.limit(n)


def with_offset(n: int) -> Option:
    return lambda q: q.offset(n)


def with_pagination(limit: int, offset: int) -> Option:
    return lambda q: q.limit(limit).offset(offset)


def with_param(name: str, value: object) -> Option:
    return lambda q: replace(q, params=q.params | {name: value})


def with_query(text: str) -> Option:
    return with_param("query", text)


def with_embedding(vector: Sequence[float]) -> Option:
    return with_param("embedding", tuple(vector))


def with_allowed(ids: DataFrame) -> Option:
    """Only these ids (column id) may be found; an empty list allows none."""
    return with_param("allowed", ids)


def with_join(other: DataFrame, on: Column | Sequence[str] | str, how: str = "inner") -> Option:
    return lambda q: replace(q, joins=(*q.joins, lambda d: d.join(other, on, how)))


def with_scan_due_before(column: str, moment: object) -> Option:
    """Rows never scanned, or scanned before the moment."""
    return lambda q: replace(q, conditions=(*q.conditions, F.col(column).isNull() | (F.col(column) < F.lit(moment))))


def with_active_state(column: str = "state") -> Option:
    return with_condition_in(column, ("started", "in_progress"))


def with_trackable(kind: str, number: int) -> Option:
    return lambda q: q.where("trackable_type", "=", kind).where("trackable_id", "=", number)


def with_priority_order() -> Option:
    return lambda q: q.order_by("priority", descending=True).order_by("created_at")


def _typed(column: str) -> tuple[Callable[[object], Option], Callable[[Iterable], Option]]:
    return (lambda value: with_condition(column, value)), (lambda values: with_condition_in(column, values))


with_id, with_id_in = _typed("id")
with_repo_id, with_repo_id_in = _typed("repo_id")
with_commit_sha, with_commit_sha_in = _typed("commit_sha")
with_blob_sha, with_blob_sha_in = _typed("blob_sha")
with_name, with_name_in = _typed("name")
with_path, with_path_in = _typed("path")
with_remote_url, with_remote_url_in = _typed("sanitized_remote_uri")
with_upstream_url, with_upstream_url_in = _typed("upstream_url")
with_default, _ = _typed("is_default")
with_type, with_type_in = _typed("type")
with_subtype, with_subtype_in = _typed("subtype")
with_enrichment_id, with_enrichment_id_in = _typed("enrichment_id")
with_entity_id, with_entity_id_in = _typed("entity_id")
with_entity_type, with_entity_type_in = _typed("entity_type")
with_pipeline_id, with_pipeline_id_in = _typed("pipeline_id")
with_step_id, with_step_id_in = _typed("step_id")
with_kind, with_kind_in = _typed("kind")
with_depends_on, with_depends_on_in = _typed("depends_on_id")
with_snippet_id, with_snippet_id_in = _typed("snippet_id")


def parse_pagination(page: str | None, size: str | None) -> tuple[int, int]:
    """Page and size of a request: 1 and 20 by default, size at most 100; a page below 1 is an error."""
    number, rows = int(page) if page else 1, int(size) if size else PAGE_SIZE
    if number < 1 or rows < 1:
        raise ValueError("page and page_size start at 1")
    return number, min(rows, MOST_PAGE_SIZE)


def pagination_meta(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)).cast("long")


@dataclass(frozen=True)
class Filters:
    """Filters of a search; every list that is given restricts, and all must hold.

    A list that was given but is empty matches nothing: an empty scope never widens a search.
    """

    languages: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    subtypes: tuple[str, ...] | None = None
    commit_shas: tuple[str, ...] | None = None
    source_repos: tuple[int, ...] | None = None
    authors: tuple[str, ...] | None = None
    file_paths: tuple[str, ...] | None = None
    created_after: object = None
    created_before: object = None

    def is_empty(self) -> bool:
        return self == Filters()

    def scoped(self, allowed: Iterable[int]) -> Filters:
        """Only repositories that are both asked for and allowed."""
        allowed = tuple(allowed)
        asked = allowed if self.source_repos is None else tuple(r for r in self.source_repos if r in set(allowed))
        return replace(self, source_repos=asked)

    def predicate(self, names: dict[str, str]) -> Column:
        """The conjunction over a hydrated table; ``names`` maps a filter to its column."""
        from ..functions.text import glob_match

        out = F.lit(True)
        for attribute in ("languages", "types", "subtypes", "commit_shas", "source_repos", "authors"):
            if (values := getattr(self, attribute)) is not None and attribute in names:
                out = out & (F.col(names[attribute]).isin(list(values)) if values else F.lit(False))
        if self.file_paths is not None and "file_paths" in names:
            out = out & reduce(lambda a, b: a | b, [glob_match(F.col(names["file_paths"]), g) for g in self.file_paths], F.lit(False))
        if self.created_after is not None and "created" in names:
            out = out & (F.col(names["created"]) >= F.lit(self.created_after))
        if self.created_before is not None and "created" in names:
            out = out & (F.col(names["created"]) < F.lit(self.created_before))
        return out

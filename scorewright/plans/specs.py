"""Declarative descriptions of tables and features."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: name, type, comment
ColumnSpec = tuple[str, str, str]


@dataclass(frozen=True)
class TableSpec:
    """A flow table (or, with snapshot columns, a snapshot table) and the roles of its columns.

    A window position column c stands for one physical column c_w for each window name w."""

    database: str
    name: str
    comment: str = ""
    entitys: tuple[ColumnSpec, ...] = ()
    dimensions: tuple[ColumnSpec, ...] = ()
    extra_col: tuple[ColumnSpec, ...] = ()
    snapshot_col: tuple[ColumnSpec, ...] = ()
    winpos_col: tuple[ColumnSpec, ...] = ()
    win_nm: tuple[str, ...] = ()
    partitioned_by: tuple[ColumnSpec, ...] = ()
    clustered_by: tuple[str, ...] = ()
    bucket_num: int = 0
    field_sep: str = ","
    stored_as: str = "parquet"
    location: str = ""

    @staticmethod
    def from_dict(config: dict) -> TableSpec:
        """From a plain dictionary; `table` may hold (name, comment)."""
        config = dict(config)
        if "table" in config:
            config["name"], config["comment"] = config.pop("table")
        known = TableSpec.__dataclass_fields__
        if odd := set(config) - set(known):
            raise ValueError(f"unknown table settings: {sorted(odd)}")
        return TableSpec(**{k: tuple(map(_frozen, v)) if isinstance(v, list | tuple) else v for k, v in config.items()})

    def columns(self) -> set[str]:
        """Upper-cased names of all logical columns."""
        roles = (self.entitys, self.dimensions, self.extra_col, self.snapshot_col, self.winpos_col, self.partitioned_by)
        return {c[0].upper() for role in roles for c in role}

    def windowed(self) -> set[str]:
        return {c[0].upper() for c in self.winpos_col}


def _frozen(x):
    return tuple(x) if isinstance(x, list) else x


@dataclass(frozen=True)
class Option:
    """One choice of a condition column: an expression over the token COL, a comment, a name for the alias."""

    expr: str
    comment: str
    name: str


@dataclass(frozen=True)
class FeatureSpec:
    """All combinations of objects, functions and one option of each condition column."""

    tag: str
    objects: tuple[str, ...]
    function: tuple[str, ...]
    condition_cols: tuple[tuple[str, tuple[Option, ...]], ...] = ()
    comment: str = ""

    @staticmethod
    def from_dict(config: dict) -> FeatureSpec:
        conditions = tuple((col, tuple(Option(*o) for o in options)) for col, options in config.get("condition_cols", ()))
        return FeatureSpec(config["tag"], tuple(config["objects"]), tuple(config["function"]), conditions, config.get("comment", ""))


@dataclass(frozen=True)
class Feature:
    """A generated feature: its alias, comment, function name, and SQL predicates of numerator and denominator; parts and base_parts are
    what these are made of, as (upper-cased condition column, SQL text)."""

    alias: str
    comment: str
    function: str
    object: str
    predicate: str
    base_predicate: str = "1=1"
    parts: tuple[tuple[str, str], ...] = field(default=(), compare=False)
    base_parts: tuple[tuple[str, str], ...] = field(default=(), compare=False)


def substitute(expr: str, column: str) -> str:
    """The token COL as a whole word becomes the column."""
    return re.sub(r"\bCOL\b", column, expr)

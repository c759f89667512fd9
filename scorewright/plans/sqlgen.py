"""SQL text from specs: the wide feature select, and table definitions."""

from __future__ import annotations

from scorewright.functions.aggregates import lookup
from scorewright.plans.features import expand_all
from scorewright.plans.specs import Feature, FeatureSpec, TableSpec


def feature_sql(specs: list[FeatureSpec], entity: list[str], source: str, table: TableSpec | None = None, window: str | None = None, dialect: str = "spark") -> tuple[str, list[str]]:
    """The select statement and its aliases. dialect: 'spark' (also a valid Hive-style query text for Spark SQL) or 'duckdb'."""
    features = expand_all(specs, entity, table, window)
    lines = [", ".join(entity), *(f"{_text(f, dialect)} as {f.alias}" for f in features)]
    return f"select {'\n     , '.join(lines)}\nfrom {source}\ngroup by {', '.join(entity)}", [f.alias for f in features]


def _text(f: Feature, dialect: str) -> str:
    x = f"case when {f.predicate} then {f.object} else null end"
    y = f"case when {f.base_predicate} then {f.object} else null end"
    return getattr(lookup(f.function), dialect).format(x=x, y=y)


def table_ddl(spec: TableSpec) -> str:
    """CREATE TABLE with roles in the order entities, dimensions, extra, snapshot columns, then the window columns.

    Partition columns are declared once, in their own clause. Field separators matter in text files only, and
    Spark refuses them elsewhere, so other formats go without."""
    partitions = {c[0] for c in spec.partitioned_by}
    columns = [c for role in (spec.entitys, spec.dimensions, spec.extra_col, spec.snapshot_col) for c in role if c[0] not in partitions]
    columns += [(f"{c[0]}_{w}", c[1], c[2]) for c in spec.winpos_col for w in spec.win_nm]
    parts = [f"create table {spec.database}.{spec.name} (\n{_declared(columns)}\n)", f"comment {_quoted(spec.comment)}"]
    if spec.partitioned_by:
        parts.append(f"partitioned by (\n{_declared(spec.partitioned_by)}\n)")
    if spec.clustered_by:
        parts.append(f"clustered by ({', '.join(spec.clustered_by)})\ninto {spec.bucket_num} buckets")
    if spec.stored_as.lower() == "textfile":
        parts.append(f"row format delimited fields terminated by {_quoted(spec.field_sep)}")
    parts += [f"stored as {spec.stored_as}", f"location\n{_quoted(spec.location + spec.name)}"]
    return "\n".join(parts) + "\n;\n"


def _declared(columns) -> str:
    return "\n, ".join(f"{name} {kind} comment {_quoted(comment)}" for name, kind, comment in columns)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

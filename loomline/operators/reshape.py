"""Projections, nested access, overlays, flattening, migrations, templates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_rows(df: DataFrame, *columns: Column, keep: bool = False) -> DataFrame:
    """One output row per input row; several expressions give several columns."""
    return df.select("*", *columns) if keep else df.select(*columns)


def select_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listed columns that exist, in the table's own order."""
    wanted = set(keys)
    return df.select([c for c in df.columns if c in wanted])


def exclude_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.drop(*keys)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def overlay_merge(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Later record wins per key: override columns replace base columns.

    Rows only in ``override`` are added. A NULL in ``override`` does replace;
    a column ``override`` lacks does not. ``override`` has one row per key.
    """
    over = override.withColumn("_present", F.lit(True)).alias("o")
    joined = base.alias("b").join(over, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    present = F.coalesce(F.col("o._present"), F.lit(False))
    columns = [F.coalesce(F.col(f"o.{key}"), F.col(f"b.{key}")).alias(key)]
    for name in base.columns:
        if name == key:
            continue
        if name in override.columns:
            columns.append(F.when(present, F.col(f"o.{name}")).otherwise(F.col(f"b.{name}")).alias(name))
        else:
            columns.append(F.col(f"b.{name}"))
    columns += [F.col(f"o.{c}") for c in override.columns if c not in base.columns]
    return joined.select(*columns)


def merge_maps(base: Column, update: Column) -> Column:
    """Map with the keys of both; ``update`` wins, also with a NULL value."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def merge_structs(base: Column, base_type: T.StructType, update: Column, update_type: T.StructType) -> Column:
    """Recursive merge of two structs: nested structs merge, other fields of ``update`` win."""
    theirs = {f.name: f.dataType for f in update_type.fields}
    fields = []
    for f in base_type.fields:
        if f.name not in theirs:
            fields.append(base[f.name].alias(f.name))
        elif isinstance(f.dataType, T.StructType) and isinstance(theirs[f.name], T.StructType):
            merged = merge_structs(base[f.name], f.dataType, update[f.name], theirs[f.name])
            fields.append(merged.alias(f.name))
        else:
            fields.append(update[f.name].alias(f.name))
    mine = set(base_type.names)
    fields += [update[n].alias(n) for n in theirs if n not in mine]
    return F.struct(*fields)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object], fill_nulls: bool = False) -> DataFrame:
    """Add absent columns with their default; NULLs stay unless ``fill_nulls``."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
        elif fill_nulls:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def map_value_or_default(mapping: Column, key: str, default: Column) -> Column:
    """Default only when the key is absent; an explicit NULL stays NULL."""
    return F.when(F.map_contains_key(mapping, key), F.element_at(mapping, F.lit(key))).otherwise(default)


def nested_get(df: DataFrame, path: str, default=None, name: str | None = None) -> DataFrame:
    """Add the value at a dotted struct path; NULL anywhere gives the default."""
    value = F.col(path)
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return df.withColumn(name or path.replace(".", "_"), value)


def json_get(text: Column, path: str, type_name: str, default=None) -> Column:
    """Typed value at a dotted path of JSON text; bad JSON or a gap gives the default."""
    value = F.try_variant_get(F.try_parse_json(text), "$." + path, type_name)
    return value if default is None else F.coalesce(value, F.lit(default))


def nested_set(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a dotted struct path, creating missing parent structs."""
    head, *rest = path.split(".")
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn(head, _with_path(F.col(head), have.get(head), rest, value))


def _with_path(current, kind, rest, value):
    if not rest:
        return value
    head, *tail = rest
    if isinstance(kind, T.StructType):
        types = {f.name: f.dataType for f in kind.fields}
        inner = _with_path(current[head] if head in types else None, types.get(head), tail, value)
        base = F.coalesce(current, F.struct(*[F.lit(None).cast(t).alias(n) for n, t in types.items()]))
        return base.withField(head, inner)
    return F.struct(_with_path(None, None, tail, value).alias(head))


def flatten_record(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct leaves become top-level columns ``a<sep>b<sep>c``; arrays stay whole."""
    leaves = []

    def walk(column: Column, kind: T.DataType, trail: list[str]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f.dataType, [*trail, f.name])
        else:
            leaves.append(column.alias(sep.join(trail)))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, [f.name])
    return df.select(*leaves)


def explode_rows(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per array element; an empty or NULL array gives no row."""
    return df.select("*", F.explode(items).alias(name))


def flatten_deep(df: DataFrame, column: str) -> DataFrame:
    """Flatten an array column of any depth to one level, by its schema."""
    kind = df.schema[column].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        df = df.withColumn(column, F.flatten(F.col(column)))
        kind = kind.elementType
    return df


def regex_replace_all_fields(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Replace in every string, also inside arrays, map values and structs."""

    def rewrite(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.regexp_replace(column, pattern, replacement)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: rewrite(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda k, v: rewrite(v, kind.valueType))
        if isinstance(kind, T.StructType):
            rebuilt = F.struct(*[rewrite(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(column.isNotNull(), rebuilt)
        return column

    return df.select(*[rewrite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


Stage = Callable[[DataFrame], DataFrame]


def chain_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Left-to-right stages in one plan for Catalyst."""
    return reduce(lambda d, stage: d.transform(stage), stages, df)


def split_failures(df: DataFrame, checked: Mapping[str, Column], reasons: Mapping[str, Column]) -> DataFrame:
    """Add checked columns and ``_error``: the first reason that applies, else NULL.

    Filter on ``_error`` for the good rows and the quarantined rows; none is lost.
    """
    named = [F.when(test, F.lit(name)) for name, test in reasons.items()]
    error = F.coalesce(*named) if named else F.lit(None).cast("string")
    return df.select("*", *[c.alias(n) for n, c in checked.items()], error.alias("_error"))


def migrate_records(df: DataFrame, steps: Sequence[tuple[int, Stage, Stage]], target: int,
                    version: str = "version") -> DataFrame:
    """Bring every row to ``target`` by versioned steps.

    ``steps`` is a list of (to_version, up, down) in ascending order; a row at
    version v passes the ups above v, or the downs above ``target``. Rows are
    routed by their version and re-united by name. A row of an unknown or no
    version passes no step and keeps what it has.
    """
    levels = [0, *[s[0] for s in steps]]
    if target not in levels:
        raise ValueError(f"no step leads to version {target}")
    parts = []
    for start in levels:
        part = df.filter(F.col(version) == start)
        ups = [up for to, up, _ in steps if start < to <= target]
        downs = [down for to, _, down in reversed(steps) if target < to <= start]
        parts.append(chain_stages(part, ups + downs).withColumn(version, F.lit(target)))
    parts.append(df.filter(~F.coalesce(F.col(version).isin(levels), F.lit(False))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def add_if_absent(name: str, value) -> Stage:
    """Migration step that adds a column only when it is missing."""
    return lambda df: df if name in df.columns else df.withColumn(name, F.lit(value))


def render_templates(rows: DataFrame, templates: DataFrame, context: Column, pinned: Column | None = None) -> DataFrame:
    """Fill ``{{key}}`` marks from a context map.

    ``rows`` has ``name``; ``templates`` has (name, version, pos, template,
    is_active). The version is ``pinned`` when given, else the active one. A row
    without a template stays with a NULL text; a NULL value is written ``None``.
    """
    chosen = templates
    if pinned is None:
        chosen = templates.groupBy("name").agg(
            F.max_by(F.struct("version", "template"), F.struct("is_active", "pos")).alias("_t"))
        chosen = chosen.select("name", F.col("_t.version").alias("version"), F.col("_t.template").alias("template"))
        joined = rows.join(chosen, "name", "left")
    else:
        joined = rows.withColumn("version", pinned).join(chosen, ["name", "version"], "left")
    filled = F.aggregate(
        F.map_entries(context), F.col("template"),
        lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"].cast("string"), F.lit("None"))))
    return joined.withColumn("rendered", filled)

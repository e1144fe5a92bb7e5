"""Schemas that drift between files: every file's schema, the union, and an ordered log of changes.

The schemas of all files are read in parallel and reduced to one row per (file, field). Types are
folded through a promotion lattice into a union schema, to which all rows are cast without loss.
Each file is compared with the one before it; a lost and a new field whose values agree are one
field renamed.

The lattice: whole numbers that a double holds (small) lie below long and double, long and
fractions that a decimal holds (fraction) below decimal, and everything below string, which holds
any value as it was written. Booleans and arrays lie below string only. Types meet in the least type
that holds all their values exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.jsontext import Number, dump, parse
from skein.session import cut

#: A renamed field carries at least this share of its values over from the old one.
RENAME_SHARE = 0.5
#: Fields whose columns go to the calls as one broadcast map; those of more are joined leaf by leaf, with the same result.
MOST_FIELDS = 5000
#: Order in which the commonest type of a field is taken when several are equally common.
TYPE_ORDER = ("string", "number", "boolean", "array")
#: What each SQL type holds without loss, least type first.
LATTICE = (
    ("bigint", ("small", "long")), ("double", ("small", "fraction", "real")), ("decimal(38,18)", ("small", "long", "fraction", "decimal")), ("boolean", ("boolean",)),
)


def number_type(text: str) -> str:
    """Where a JSON number lies in the lattice: small, long, fraction, real, decimal, or string if no type holds it."""
    value = Decimal(text)
    _, digits, exponent = value.as_tuple()
    held = exponent >= -18 and len(digits) + exponent <= 20
    if value == value.to_integral_value() and "." not in text and "e" not in text.lower():
        return "small" if abs(value) <= 2**53 else "long" if -(2**63) <= value < 2**63 else "decimal" if held else "string"
    if Decimal(float(text)) == value or Decimal(repr(float(text))) == value:
        return "fraction" if held else "real"
    return "decimal" if held else "string"


def leaves(value, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(field, type, text) of all leaves of an object: `a`, `a.b`, `a[].b`; nulls have none.

    An array without objects is one leaf (an empty one too); in an array with objects, the objects
    are entered and anything else is passed over. Empty objects have no leaves.
    """
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        if any(isinstance(x, (dict, list)) for x in value):
            for x in value:
                if isinstance(x, (dict, list)):
                    yield from leaves(x, f"{path}[]")
        else:
            yield path, "array", dump(value)
    elif isinstance(value, bool):
        yield path, "boolean", "true" if value else "false"
    elif isinstance(value, Number):
        yield path, "number", str(value)
    elif isinstance(value, str):
        yield path, "string", value


def _typed(value: dict) -> list[tuple[str, str, str, str]]:
    """(field, kind, type, text) of the leaves of an object."""
    return [(field, kind, number_type(text) if kind == "number" else kind, text) for field, kind, text in leaves(value)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(c.path, c.name, c.call_id, _typed(value)) for c in pdf.itertuples(index=False) if isinstance(value := parse(c.input), dict)]
        yield pd.DataFrame(rows, columns=["path", "name", "call_id", "leaves"])


def read_calls(calls: DataFrame) -> DataFrame:
    """One row per call whose `input` is a JSON object: path, name, call_id, leaves (array of field, kind, type, value).

    `value` is the leaf as text, `kind` one of TYPE_ORDER, `type` its place in the lattice. A call
    given twice counts once; without path or name it belongs nowhere and is left out.
    """
    schema = "path string, name string, call_id string, leaves array<struct<field:string,kind:string,type:string,value:string>>"
    src = calls.where(F.col("path").isNotNull() & F.col("name").isNotNull() & F.col("input").isNotNull())
    src = src.select("path", "name", "call_id", "input").dropDuplicates(["call_id", "path", "name", "input"])
    return src.mapInPandas(_read, schema)


def field_values(calls: DataFrame) -> DataFrame:
    """One row per leaf of each call's `input`: path, name, field, kind, type, hash (of the value as text).

    A call without leaves is kept by the row of its root (field '', kind 'object').
    """
    root = F.array(F.struct(F.lit("").alias("field"), F.lit("object").alias("kind"), F.lit("object").alias("type"), F.lit("").alias("value")))
    rows = cut(read_calls(calls)).select("path", "name", F.explode(F.when(F.size("leaves") > 0, F.col("leaves")).otherwise(root)).alias("l"))
    return rows.select("path", "name", "l.field", "l.kind", "l.type", F.xxhash64("l.value").alias("hash"))


def file_schemas(values: DataFrame) -> DataFrame:
    """One row per file, name and field: path, name, field, kind (the commonest), types (places in the lattice), values."""
    counts = values.groupBy("path", "name", "field", "kind", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("path", "name", "field", "kind").agg(F.sum("n").alias("n"), F.collect_set("type").alias("types"))
    order = F.coalesce(*[F.when(F.col("kind") == t, F.lit(-i)) for i, t in enumerate(TYPE_ORDER)], F.lit(-9))
    return kinds.groupBy("path", "name", "field").agg(
        F.max_by("kind", F.struct("n", order)).alias("kind"), F.sort_array(F.flatten(F.collect_list("types"))).alias("types"), F.sum("n").alias("values")
    )


def promoted(types: Column) -> Column:
    """The least SQL type that holds values of all `types` (places in the lattice) exactly; string holds all."""
    held = lambda below: F.size(F.array_except(types, F.array(*[F.lit(t) for t in below]))) == 0
    return F.coalesce(*[F.when(held(below), F.lit(name)) for name, below in LATTICE], F.lit("string"))


def union_schema(schemas: DataFrame) -> DataFrame:
    """The schemas of all files folded: name, field, files, types, type (the SQL type all their values fit)."""
    fields = schemas.where("field <> ''").groupBy("name", "field").agg(F.count(F.lit(1)).alias("files"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))
    return fields.withColumn("type", promoted(F.col("types")))


def _sequence(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """path, project, name and the number of each file among its project's files with that name.

    Files are numbered within a day; what earlier days have is added, so only one row a day of a
    project's files is ever sorted in one task.
    """
    known = catalogue.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("project").alias("project"), F.max("mtime").alias("mtime"))
    rows = files.join(known, "path").withColumn("day", F.coalesce(F.to_date("mtime"), F.lit("0001-01-01").cast("date")))
    within = Window.partitionBy("project", "name", "day").orderBy(F.col("mtime").asc_nulls_first(), "path")
    days = rows.groupBy("project", "name", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("project", "name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("project").alias("p"), F.col("name").alias("m"), F.col("day").alias("d"), F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("project").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m")) & (F.col("day") == F.col("d"))
    return rows.withColumn("r", F.row_number().over(within)).join(days, same).select("path", "project", "name", (F.col("before") + F.col("r")).alias("no"))


def schema_changes(values: DataFrame, catalogue: DataFrame, rename_share: float = RENAME_SHARE) -> DataFrame:
    """What changed from each file to the next: path, name, no, change, old_field, new_field.

    Files of one project that hold calls of the same name follow each other by mtime (then by
    path; a missing mtime comes first); `path` is the later file. `change` is renamed, added
    (old_field is ''), removed (new_field is '') or retyped. A lost field and a new one are renamed
    if at least `rename_share` of the new one's distinct values, as text, stood under the old one.
    Files that the catalogue doesn't list can't be placed and are left out.
    """
    file = F.xxhash64("path", "name")
    values = values.withColumn("file", file)
    counted = values.groupBy("file", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = F.coalesce(*[F.when(F.col("kind") == t, F.lit(-i)) for i, t in enumerate(TYPE_ORDER)], F.lit(-9))
    schemas = cut(counted.groupBy("file", "field").agg(F.max_by("kind", F.struct("n", order)).alias("kind")))
    files = cut(_sequence(values.select("path", "name").distinct(), catalogue).withColumn("file", file))
    ahead = files.select(F.col("project").alias("p"), F.col("name").alias("m"), (F.col("no") + 1).alias("k"), F.col("file").alias("old"))
    same = F.col("project").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m")) & (F.col("no") == F.col("k"))
    pairs = cut(files.join(ahead, same).select("path", "name", "no", "file", "old"))
    fields = schemas.where("field <> ''")
    later = fields.join(pairs.select("file"), "file").select("file", "field", F.col("kind").alias("new_kind"))
    earlier = fields.withColumnRenamed("file", "old").join(pairs.select("file", "old"), "old").select("file", "field", F.col("kind").alias("old_kind"))
    both = cut(earlier.join(later, ["file", "field"], "full_outer"))
    lost = both.where("new_kind is null").select("file", F.col("field").alias("old_field"), "old_kind")
    new = both.where("old_kind is null").select("file", F.col("field").alias("new_field"), "new_kind")
    # only the values of lost and new fields are compared
    held = values.select("file", "field", "hash")
    new_values = held.withColumnRenamed("field", "new_field").join(new, ["file", "new_field"]).distinct()
    gone = lost.join(pairs.select("file", "old"), "file").select(F.col("file").alias("next"), F.col("old").alias("file"), F.col("old_field").alias("field"), "old_kind")
    old_values = held.join(gone, ["file", "field"]).select(F.col("next").alias("file"), F.col("field").alias("old_field"), "old_kind", "hash").distinct()
    new_values = cut(new_values)
    sizes = new_values.groupBy("file", "new_field").agg(F.count(F.lit(1)).alias("all"))
    met = old_values.join(new_values, ["file", "hash"]).groupBy("file", "old_field", "new_field", "old_kind", "new_kind").agg(F.count(F.lit(1)).alias("same"))
    renamed = cut(met.join(sizes, ["file", "new_field"]).where(F.col("same") >= F.col("all") * rename_share))
    log = lambda df, change, old, new: df.select("file", F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    none = F.lit("")
    old, fresh = F.col("old_field"), F.col("new_field")
    parts = [
        log(renamed, "renamed", old, fresh),
        log(renamed.where("old_kind <> new_kind"), "retyped", old, fresh),
        log(both.where("old_kind <> new_kind"), "retyped", F.col("field"), F.col("field")),
        log(lost.join(renamed, ["file", "old_field"], "left_anti"), "removed", old, none),
        log(new.join(renamed, ["file", "new_field"], "left_anti"), "added", none, fresh),
    ]
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    return changes.join(pairs, "file").select("path", "name", "no", "change", "old_field", "new_field")


def _columns(union: DataFrame, renamed: DataFrame) -> DataFrame:
    """The column of each field: name, field, column, type. Renamings of each other share one, named after the field that most files have.

    Fields linked by renamings take the least label among them, round by round, until none changes.
    """
    links = renamed.select("name", F.col("old_field").alias("field"), F.col("new_field").alias("other"))
    links = cut(links.unionByName(links.select("name", F.col("other").alias("field"), F.col("field").alias("other"))).distinct())
    labels = cut(union.select("name", "field", F.struct((-F.col("files")).alias("n"), F.col("field").alias("f")).alias("label")))
    while True:
        seen = links.join(labels.withColumnRenamed("field", "other"), ["name", "other"]).groupBy("name", "field").agg(F.min("label").alias("near"))
        step = cut(labels.join(seen, ["name", "field"], "left").select("name", "field", F.least("label", F.coalesce("near", "label")).alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    named = union.join(labels, ["name", "field"]).select("name", "field", F.col("label.f").alias("column"), "types")
    kinds = named.groupBy("column").agg(promoted(F.array_distinct(F.flatten(F.collect_set("types")))).alias("type"))
    return named.select("name", "field", "column").join(kinds, "column")


def _cells(read: DataFrame, columns: DataFrame, most_fields: int) -> DataFrame:
    """Each row of `read` with `all`, its values with their columns in order of these: path, name, call_id, all.

    The columns of up to `most_fields` fields go to the calls as a map; more are joined leaf by leaf
    and put together again by `row`, the number of the call. Both ways give the same rows.
    """
    if columns.limit(most_fields + 1).count() <= most_fields:
        maps = columns.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("to"))
        placed = F.transform("leaves", lambda x: F.struct(F.col("to")[x["field"]].alias("column"), x["value"].alias("value")))
        return read.join(F.broadcast(maps), "name", "left").select("path", "name", "call_id", F.sort_array(placed).alias("all"))  # at most most_fields entries
    leaf = F.col("l")
    cells = read.select("row", "name", F.explode("leaves").alias("l")).select("row", "name", leaf["field"].alias("field"), leaf["value"].alias("value"))
    cells = cells.join(columns.select("name", "field", "column"), ["name", "field"])
    cells = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("column", "value"))).alias("all"))
    none = F.array().cast("array<struct<column:string,value:string>>")
    return read.select("row", "path", "name", "call_id").join(cells, "row", "left").select("path", "name", "call_id", F.coalesce("all", none).alias("all"))


def _named(columns: list[str], keys: tuple[str, ...]) -> list[str]:
    """A name for each of `columns`, after as many `input.` as it takes to differ, ignoring case, from keys and names given before; first those that are called like a key."""
    taken, names = {k.lower() for k in keys}, {}
    for column in sorted(columns, key=lambda c: c not in keys):
        name = column
        while name.lower() in taken:
            name = f"input.{name}"
        taken.add(name.lower())
        names[column] = name
    return [names[c] for c in columns]


def unified_calls(calls: DataFrame, catalogue: DataFrame, most_fields: int | None = None) -> DataFrame:
    """All calls in one table: path, name, call_id, and a column for every field of the union schema, however many.

    Fields that are renamings of each other share a column, named after the one that most files
    have. A column has the least type that holds all values of its fields exactly (see LATTICE);
    several values of one field in a call come as the JSON text of an array, in a column of strings.
    A call without a field has null. Only the names of the columns are brought to the driver.

    A caller who can't take any number of columns gives `most_fields`, and gets them as one map,
    `fields`, with the values as text, whatever the input has: the form of the table never hangs on it.
    """
    read = cut(read_calls(calls).withColumn("row", F.monotonically_increasing_id()))
    flat = read.select("path", "name", F.explode("leaves").alias("l")).select("path", "name", "l.field", "l.kind", "l.type", F.xxhash64("l.value").alias("hash"))
    union = cut(union_schema(file_schemas(flat)))
    renamed = schema_changes(flat, catalogue).where("change = 'renamed'").select("name", "old_field", "new_field").distinct()
    columns = cut(_columns(union, renamed))
    cells = _cells(read, columns, MOST_FIELDS if most_fields is None else most_fields)
    of = lambda c: F.transform(F.filter("all", lambda x: x["column"] == c), lambda x: x["value"])
    one = lambda c: F.when(F.size(of(c)) == 1, of(c)[0]).otherwise(F.to_json(of(c)))
    names = F.array_distinct(F.transform("all", lambda x: x["column"]))
    wide = cut(cells.select("path", "name", "call_id", F.map_from_arrays(names, F.transform(names, one)).alias("fields"), F.filter(names, lambda c: F.size(of(c)) > 1).alias("listed")))
    several = wide.select(F.explode("listed").alias("column")).distinct()
    wide = wide.drop("listed")
    if most_fields is not None:
        return wide
    kinds = columns.groupBy("column").agg(F.max("type").alias("type")).join(several.withColumn("listed", F.lit(True)), "column", "left")
    layout = kinds.select("column", F.when(F.col("listed"), "string").otherwise(F.col("type")).alias("type")).orderBy("column").collect()
    keys, fields = ("path", "name", "call_id"), F.col("fields")
    names = _named([r.column for r in layout], keys)
    return wide.select(*keys, *[fields[r.column].try_cast(r.type).alias(name) for r, name in zip(layout, names, strict=True)])

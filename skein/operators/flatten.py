"""Deeply nested records turned into related flat tables that keep parent and child together.

The merged schema of all records is inferred in parallel (which generalised paths hold what). Each
array level is exploded into rows of its own: an object in an array becomes a row with its path
(its key), its ordinal in the array, and the path of the object it lies in (its parent's key).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.jsontext import Number, as_object, dump, parse
from skein.session import cut

#: Keys whose value may be JSON text of an object instead of the object.
OPENED = ("message", "input")
#: Path of the line itself; the paths of what its fields but `message` hold start with it.
LINE = "$"
#: Columns of a wide table.
MOST_FIELDS = 5000
#: Field of a row that is no object but a value: an element of an array, or a whole line.
VALUE = "#value"


def nodes(value, path: str = "", parent: str = "", table: str = "") -> Iterator[tuple[str, str, str, int, dict]]:
    """(path, parent path, table, ordinal, object) of every object that is an element of an array.

    `table` is the path with the ordinals left out: `content[].input.edits[]`. Without recursion,
    as records may be nested deeper than Python calls.
    """
    stack = [(value, path, parent, table, None)]
    while stack:
        value, path, parent, table, ordinal = stack.pop()
        if isinstance(value, dict):
            if ordinal is not None:
                yield path, parent, table, ordinal, value
                parent = path
            for key, inner in value.items():
                if key in OPENED:
                    inner = as_object(inner) or inner
                if isinstance(inner, (dict, list)):
                    stack.append((inner, f"{path}.{key}" if path else key, parent, f"{table}.{key}" if table else key, None))
        elif isinstance(value, list):
            for i, inner in enumerate(value):
                if isinstance(inner, (dict, list)):
                    stack.append((inner, f"{path}[{i}]", parent, f"{table}[]", i))


def _values(value, path: str = "", parent: str = "", table: str = "") -> Iterator[tuple[str, str, str, int, dict]]:
    """(path, parent path, table, ordinal, {VALUE: text}) of the scalars in arrays that no field of an object holds whole.

    These are the elements of arrays with containers among them, of arrays in arrays, and of `value` itself.
    """
    stack = [(value, path, parent, table, False, False)]
    while stack:
        value, path, parent, table, element, field = stack.pop()
        if isinstance(value, dict):
            parent = path if element else parent
            for key, inner in value.items():
                if key in OPENED:
                    inner = as_object(inner) or inner
                if isinstance(inner, (dict, list)):
                    stack.append((inner, f"{path}.{key}" if path else key, parent, f"{table}.{key}" if table else key, False, True))
        elif isinstance(value, list):
            whole = field and not any(isinstance(x, (dict, list)) for x in value)
            for i, inner in enumerate(value):
                if isinstance(inner, (dict, list)):
                    stack.append((inner, f"{path}[{i}]", parent, f"{table}[]", True, False))
                elif inner is not None and not whole:
                    yield f"{path}[{i}]", parent, f"{table}[]", i, {VALUE: _text(inner)}


def _text(value) -> str:
    return str(value) if isinstance(value, str) else dump(value)


def _message(raw: str | None):
    return _message_of(parse(raw))


def _message_of(line):
    message = line.get("message") if isinstance(line, dict) else None
    return as_object(message) or message if isinstance(message, (dict, list, str)) else None


def _scalars(value: dict) -> dict[str, str]:
    """The fields of an object that are no containers, and those of the objects in it, as text."""
    out, stack = {}, [(value, "")]
    while stack:
        value, path = stack.pop()
        for key, inner in value.items():
            name = f"{path}.{key}" if path else key
            if key in OPENED:
                inner = as_object(inner) or inner
            if isinstance(inner, dict):
                stack.append((inner, name))
            elif isinstance(inner, list):
                if inner and not any(isinstance(x, (dict, list)) for x in inner):
                    out[name] = dump(inner)
            elif inner is not None:
                out[name] = _text(inner)
    return out


def _rows(line_id, raw: str | None) -> Iterator[tuple]:
    line = parse(raw)
    if line is None:
        return
    message = _message_of(line)
    own = line
    if isinstance(line, dict):
        own = {k: v for k, v in line.items() if k != "message" or not isinstance(message, (dict, list))}
    yield line_id, LINE, None, LINE, None, _scalars(own) if isinstance(own, dict) else {} if isinstance(own, list) else {VALUE: _text(own)}
    below = [(own, LINE, LINE, LINE)]
    if isinstance(message, (dict, list)):
        yield line_id, "", LINE, "", None, _scalars(message) if isinstance(message, dict) else {}
        below.append((message, "", "", ""))
    for part in below:
        yield from ((line_id, p, up, t, i, _scalars(v)) for p, up, t, i, v in nodes(*part))
        yield from ((line_id, *row) for row in _values(*part))


def _node_rows(line_id, raw: str | None) -> Iterator[tuple]:
    message = _message(raw)
    if isinstance(message, dict):
        yield line_id, "", None, "", None, _scalars(message)
    if isinstance(message, (dict, list)):
        yield from ((line_id, p, up, t, i, _scalars(v)) for p, up, t, i, v in nodes(message))


def _explode(lines: DataFrame, rows_of) -> DataFrame:
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for line_id, raw in zip(pdf["line_id"], pdf["raw"]) for row in rows_of(line_id, raw)]
            yield pd.DataFrame(rows, columns=["line_id", "node_path", "parent_path", "table_path", "ordinal", "fields"]).astype({"ordinal": "Int64"})

    schema = "line_id long, node_path string, parent_path string, table_path string, ordinal long, fields map<string,string>"
    src = lines.where(F.col("line_id").isNotNull() & F.col("raw").isNotNull()).select("line_id", "raw")
    return src.mapInPandas(explode, schema).dropDuplicates(["line_id", "node_path"])


def flat_rows(lines: DataFrame) -> DataFrame:
    """All of every JSON line, as rows: the line, its message, and the elements of all array levels.

    Output: line_id, node_path, parent_path, table_path, ordinal, fields (map of the row's own
    values as text). (line_id, node_path) is a row's key, (line_id, parent_path) its parent's. The
    line is the row with node_path '$' and a null parent; it holds the root fields, also a message
    that is plain text, and elements of root arrays lie below it as `$.todos[0]`. The message, if a
    container, is the row with node_path '' and parent '$'. A scalar in an array is a row with the
    field '#value', unless the array is all scalars and the field of an object; then the field holds
    it whole. A line that is a scalar has '#value' too. Nulls and empty arrays are no values; lines
    that are no JSON give nothing. A message or input that is JSON text of an object counts as the
    object; other strings stay text. Of equal keys in an object the last counts; a line given twice
    under one line_id counts once.
    """
    return _explode(lines, _rows)


def flat_nodes(lines: DataFrame) -> DataFrame:
    """Only the objects of all array levels inside `message`, with the columns of `flat_rows`.

    The message itself, if an object, is the row with node_path '' and a null parent. Lines that are
    no JSON object and messages that are neither container nor JSON text of an object give nothing.
    """
    return _explode(lines, _node_rows)


def _skeletons(message, most: int) -> Iterator[tuple]:
    """(path, parent path, table, ordinal, skeleton, depth) of a message: its containers alone, 0 for anything else in an array.

    A container that lies deeper than `most` begins a skeleton of its own.
    """
    roots = [(message, "", "", "", None)]
    while roots:
        root = roots.pop()
        top: dict | list = {} if isinstance(root[0], dict) else []
        stack, deepest = [(*root, top, 1)], 1
        while stack:
            value, path, parent, table, ordinal, out, depth = stack.pop()
            deepest = max(deepest, depth)
            named = isinstance(value, dict)
            inside = path if named and ordinal is not None else parent
            for key, inner in value.items() if named else enumerate(value):
                if named and key in OPENED:
                    inner = as_object(inner) or inner
                child: dict | list | int = {} if isinstance(inner, dict) else [] if isinstance(inner, list) else 0
                if child != 0:
                    step = (f"{path}.{key}" if path else key, inside, f"{table}.{key}" if table else key, None) if named else (f"{path}[{key}]", inside, f"{table}[]", key)
                    if depth >= most:
                        roots.append((inner, *step))
                        child = 0
                    else:
                        stack.append((inner, *step, child, depth + 1))
                if not named:
                    out.append(child)
                elif child != 0:
                    out[key] = child
        yield (*root[1:], json.dumps(top), deepest)


def _level(rows: DataFrame) -> DataFrame:
    """One level further down: every container gives way to the containers in it, and an object that is an element becomes a row that is done."""
    kept = F.struct("node_path", "parent_path", "table_path", "ordinal", F.lit(None).cast("variant").alias("v"))
    fields, elements = F.expr("try_cast(v as map<string,variant>)"), F.expr("try_cast(v as array<variant>)")
    below = F.when(F.col("ordinal").isNotNull(), F.col("node_path")).otherwise(F.col("parent_path"))
    dot = lambda c, k: F.when(F.col(c) == "", k).otherwise(F.concat(c, F.lit("."), k))
    named = lambda e: F.struct(dot("node_path", e["key"]).alias("node_path"), below.alias("parent_path"), dot("table_path", e["key"]).alias("table_path"), F.lit(None).cast("long").alias("ordinal"), e["value"].alias("v"))
    numbered = lambda x, i: F.struct(F.concat("node_path", F.lit("["), i.cast("string"), F.lit("]")).alias("node_path"), F.col("parent_path"), F.concat("table_path", F.lit("[]")).alias("table_path"), i.cast("long").alias("ordinal"), x.alias("v"))
    own = F.when(F.col("m").isNotNull() & F.col("ordinal").isNotNull(), F.array(kept)).otherwise(F.array().cast("array<struct<node_path:string,parent_path:string,table_path:string,ordinal:bigint,v:variant>>"))
    children = F.when(F.col("m").isNotNull(), F.transform(F.map_entries("m"), named)).when(F.col("a").isNotNull(), F.transform("a", numbered))
    split = rows.withColumn("m", fields).withColumn("a", elements)
    all_ = F.when(F.col("v").isNull(), F.array(kept)).otherwise(F.concat(own, F.coalesce(children, F.array().cast("array<struct<node_path:string,parent_path:string,table_path:string,ordinal:bigint,v:variant>>"))))
    return split.select("line_id", F.explode(all_).alias("r")).select("line_id", "r.*")


def element_rows(lines: DataFrame, most_depth: int = 64, at_once: int = 8) -> DataFrame:
    """The objects of all array levels inside `message`: line_id, node_path, parent_path, table_path, ordinal.

    The schema of all messages is merged first: which containers there are below which, and so how
    many levels there are. Then each level is exploded into the next, every row with its path (its
    key), its parent's and its ordinal, without an exchange. Python only reads the JSON strictly and
    opens the JSON text in it. A line given twice counts once; lines that are no JSON give nothing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line, raw in zip(pdf["line_id"], pdf["raw"]):
                message = _message(raw)
                if isinstance(message, (dict, list)):
                    rows.extend((line, *part) for part in _skeletons(message, most_depth))
            yield pd.DataFrame(rows, columns=["line_id", "node_path", "parent_path", "table_path", "ordinal", "skeleton", "depth"]).astype({"ordinal": "Int64"})

    schema = "line_id long, node_path string, parent_path string, table_path string, ordinal long, skeleton string, depth long"
    src = lines.where(F.col("line_id").isNotNull() & F.col("raw").isNotNull()).select("line_id", "raw")
    read_ = cut(src.mapInPandas(read, schema))
    depth = read_.agg(F.max("depth")).first()[0] or 0
    rows = read_.select("line_id", "node_path", "parent_path", "table_path", "ordinal", F.try_parse_json("skeleton").alias("v"))
    for level in range(depth):
        rows = _level(rows)
        if level % at_once == at_once - 1 and level + 1 < depth:  # records this deep are rare; the plan stays small
            rows = cut(rows.withColumn("v", F.to_json("v"))).withColumn("v", F.try_parse_json("v"))
    return rows.where(F.col("v").isNull() & F.col("ordinal").isNotNull()).select("line_id", "node_path", "parent_path", "table_path", "ordinal").distinct()


def element_paths(lines: DataFrame) -> DataFrame:
    """Only the keys: line_id, node_path, parent_path of objects that are elements of arrays."""
    return element_rows(lines).select("line_id", "node_path", "parent_path")


def _schema_of(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("table_path").agg(F.count(F.lit(1)).alias("objects"))
    fields = rows.select("table_path", F.explode(F.map_keys("fields")).alias("field"))
    return fields.groupBy("table_path", "field").agg(F.count(F.lit(1)).alias("filled")).join(totals, "table_path").select("table_path", "field", "objects", "filled")


def merged_schema(lines: DataFrame) -> DataFrame:
    """What all lines together hold: table_path, field, objects, filled.

    One row per table of `flat_rows` (lines, messages, array levels) and field of its rows: how many
    rows the table has, and how many of them fill the field.
    """
    return _schema_of(flat_rows(lines))


def child_tables(lines: DataFrame) -> DataFrame:
    """The flat tables of all levels, laid out by the merged schema: table_path, line_id, node_path, parent_path, ordinal, columns.

    All rows of a table have the same `columns`, a map with every field that the merged schema has
    for the table, in order of the names; what a row doesn't fill is null.
    """
    rows = cut(flat_rows(lines))
    layout = _schema_of(rows).groupBy("table_path").agg(F.sort_array(F.collect_list("field")).alias("names"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    filled = F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at("fields", n)))
    return rows.join(layout, "table_path", "left").select("table_path", "line_id", "node_path", "parent_path", "ordinal", filled.alias("columns"))


def child_table(lines: DataFrame, table_path: str) -> DataFrame:
    """The flat table of one array level, with a column for every field the level has anywhere.

    Keys: line_id, node_path, parent_path, ordinal; fields that clash with them get a trailing
    underscore. The level's field names are brought to the driver, its data is not; a level with
    more than MOST_FIELDS fields has them as one map, `fields`.
    """
    rows = flat_rows(lines).where(F.col("table_path") == table_path)
    names = sorted(r.field for r in _schema_of(rows).select("field").limit(MOST_FIELDS + 1).collect())
    if len(names) > MOST_FIELDS:
        return rows.select("line_id", "node_path", "parent_path", "ordinal", "fields")
    keys = ["line_id", "node_path", "parent_path", "ordinal"]
    return rows.select(*keys, *[F.col("fields")[n].alias(f"{n}_" if n in keys else n) for n in names])

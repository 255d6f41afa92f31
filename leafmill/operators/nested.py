"""Deeply nested records into related flat tables, by shared inlining.

One pass over the records finds the schema graph: which element types hold which, and how often, and which
scalar fields of which types they have. Types that are repeated, shared by several parents or recursive get
tables of their own; every other descendant is inlined into the row of its nearest ancestor with a table, under
a dotted name. A second pass fills the tables; each row names its parent row, which that pass finds within the
record, so that nothing is shuffled for it.

The tables ``record`` and ``node`` are reserved; an element type is named by its JSON key with a slash before it,
which no reserved name has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys under which a section's children stand, and keys that hold the top list of a record.
CHILD_KEYS = ("nodes", "children", "sub_nodes")
TOP_KEYS = ("structure", "nodes")
NODE, RECORD = "node", "record"


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """A complete JSON record; None for null, cut-off and otherwise invalid ones, and for scalars."""
    try:
        value = json.loads(text, parse_constant=_no_constant) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict | list) else None


def opened(value):
    """Lists and objects written as JSON strings, opened; anything else as it is."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = json.loads(value, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            break
    return value


def _scalar(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _type_of(value) -> str:
    """SQL type of a scalar."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return "bigint"
    return "double" if isinstance(value, int | float) else "string"


class Shredder:
    """Walks records whose nodes stand under aliased keys; ``inline`` names the (parent type, key) pairs that
    are not given tables (None: everything gets one, as in the pass that finds the graph)."""

    def __init__(self, child_keys=CHILD_KEYS, top_keys=TOP_KEYS, inline: frozenset | None = None) -> None:
        self.child_keys, self.top_keys, self.inline = child_keys, top_keys, inline
        self.types: set[tuple[str, str, str]] | None = None  # (type, field, scalar type), collected if it is a set

    def rows(self, record) -> Iterator[tuple]:
        """(table, ord, parent table, parent ord, key, position, fields) in the order in which elements begin."""
        count: dict[str, int] = {}
        # a stack of what is still to be visited, last first
        stack = [(RECORD, None, -1, "", 0, record)]
        while stack:
            kind, parent, parent_ord, key, pos, value = stack.pop()
            own = count.get(kind, 0)
            count[kind] = own + 1
            fields: dict[str, str | None] = {}
            below: list[tuple] = []
            if isinstance(value, dict):
                self._fields(kind, value, "", fields, below, kind == RECORD, own)
            elif kind == RECORD:
                self._children(NODE, kind, own, "", value, below)
            elif not isinstance(value, list):
                fields["value"] = _scalar(value)
                if self.types is not None:
                    self.types.add((kind, "value", _type_of(value)))
            else:
                below.extend((kind, kind, own, "", i, y) for i, y in enumerate(value) if y is not None)
            yield kind, own, parent, parent_ord, key, pos, fields
            stack.extend(reversed(below))

    def _children(self, kind: str, parent: str, own: int, key: str, value, below: list) -> None:
        entries = value if isinstance(value, list) else [value]
        below.extend((kind, parent, own, key, i, x) for i, x in enumerate(entries) if isinstance(x, dict))

    def _fields(self, kind: str, value: dict, prefix: str, fields: dict, below: list, top: bool, own: int) -> None:
        holder = next((k for k in self.top_keys if isinstance(opened(value.get(k)), dict | list)), None) if top else None
        for key, x in value.items():
            name = prefix + key
            if (not prefix and kind == NODE and key in self.child_keys) or (top and not prefix and key == holder):
                y = opened(x)
                if isinstance(y, dict | list):
                    self._children(NODE, kind, own, key, y, below)
                elif y is not None:
                    fields[name] = _scalar(y)
            elif isinstance(x, list):
                below.extend(("/" + key, kind, own, name, i, y) for i, y in enumerate(x) if y is not None)
            elif isinstance(x, dict):
                if self.inline is not None and (kind, name) in self.inline:
                    self._fields(kind, x, name + ".", fields, below, False, own)
                else:
                    below.append(("/" + key, kind, own, name, 0, x))
            else:
                fields[name] = _scalar(x)
                if self.types is not None and x is not None:
                    self.types.add((kind, name, _type_of(x)))


def complete_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``record, text``: one row for each key; of rows repeated with one key the greatest text stands."""
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("record")).agg(F.max(text).alias("text"))


def schema_graph(records: DataFrame, child_keys=CHILD_KEYS, top_keys=TOP_KEYS, with_fields: bool = False) -> DataFrame:
    """``parent, key, child, most, occurrences``: edges of the schema graph with the most entries that one
    parent holds; ``with_fields`` adds the scalar fields, whose child is ``=`` and their SQL type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, edges = Shredder(child_keys, top_keys), {}
        walk.types = set() if with_fields else None
        for batch in batches:
            for text in batch["text"].to_pylist():
                value = parse(text)
                if value is None:
                    continue
                per: dict[tuple, int] = {}
                for kind, _, parent, parent_ord, key, pos, _f in walk.rows(value):
                    if parent is not None:
                        per[parent, key, kind, parent_ord] = max(per.get((parent, key, kind, parent_ord), 0), pos + 1)
                for (p, k, c, _), n in per.items():
                    most, times = edges.get((p, k, c), (0, 0))
                    edges[p, k, c] = max(most, n), times + 1
        for kind, name, scalar in walk.types or ():
            edges[kind, name, "=" + scalar] = 1, 1
        cols = [[e[i] for e in edges] for i in range(3)]
        yield pa.record_batch([*(pa.array(c, pa.string()) for c in cols), pa.array([v[0] for v in edges.values()], pa.int64()), pa.array([v[1] for v in edges.values()], pa.int64())], names=["parent", "key", "child", "most", "occurrences"])

    out = records.select("text").mapInArrow(run, "parent string, key string, child string, most long, occurrences long")
    return out.groupBy("parent", "key", "child").agg(F.max("most").alias("most"), F.sum("occurrences").alias("occurrences"))


def inlined(edges: list[tuple[str, str, str, int]]) -> frozenset:
    """(parent type, dotted key) of the singleton descendants to inline: types held once at most by each
    parent, by one parent type only and not by themselves."""
    parents: dict[str, set] = {}
    repeated, below = set(), {}
    for p, _k, c, most in edges:
        parents.setdefault(c, set()).add(p)
        below.setdefault(p, set()).add(c)
        if most > 1:
            repeated.add(c)

    def reaches(a: str, b: str, seen: set) -> bool:
        return any(x == b or (x not in seen and not seen.add(x) and reaches(x, b, seen)) for x in below.get(a, ()))

    single = {c for c in parents if c not in repeated and len(parents[c]) == 1 and c != NODE and not reaches(c, c, set())}
    out: set[tuple[str, str]] = set()

    def spread(table: str, kind: str, prefix: str) -> None:
        for p, k, c, _ in edges:
            if p == kind and c in single:
                out.add((table, prefix + k))
                spread(table, c, f"{prefix}{k}.")

    for table in ({p for p, *_ in edges} | {c for _, _, c, _ in edges}) - single:
        spread(table, table, "")
    return frozenset(out)


ROWS = "record {key}, table string, ord int, parent_table string, parent_ord int, key string, pos int, link int"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]


def links(rows: list[tuple]) -> list[int | None]:
    """For each row of one record the number of its parent node, -1 for none; null for rows that aren't nodes.

    The parent is the enclosing node; a node of the top list belongs to the one other node of the record whose
    ``node_id`` equals its ``parent_node_id``, if exactly one has it.
    """
    named: dict[str, tuple[int, int, int]] = {}  # how many, first, last
    for kind, own, _p, _o, _k, _i, fields in rows:
        if kind == NODE and (name := fields.get("node_id")) is not None:
            n, first, _ = named.get(name, (0, own, own))
            named[name] = n + 1, first, own
    out: list[int | None] = []
    for kind, own, parent, parent_ord, _k, _i, fields in rows:
        if kind != NODE:
            out.append(None)
        elif parent == NODE:
            out.append(parent_ord)
        else:
            asked = fields.get("parent_node_id")
            n, first, last = named.get(asked, (0, -1, -1)) if asked is not None else (0, -1, -1)
            if fields.get("node_id") == asked and asked is not None:  # itself is one of them
                out.append(-1 if n != 2 else last if first == own else first)
            else:
                out.append(first if n == 1 else -1)
    return out


def _graph(records: DataFrame, child_keys, top_keys, most_edges: int, with_fields: bool) -> list[tuple[str, str, str, int]]:
    edges = schema_graph(records, child_keys, top_keys, with_fields).limit(most_edges + 1).collect()
    if len(edges) > most_edges:
        raise ValueError(f"the schema graph has more than {most_edges} edges")
    return sorted((e["parent"], e["key"], e["child"], e["most"]) for e in edges)


def shred(df: DataFrame, key: str, text: str, child_keys=CHILD_KEYS, top_keys=TOP_KEYS, most_edges: int = 100_000, with_fields: bool = True, inline: frozenset | None = None) -> DataFrame:
    """Every row of every table: ``record, table, ord, parent_table, parent_ord, key, pos, link, fields``.

    ``table`` is ``record``, ``node`` or an element type with a table of its own (its key after a slash); ``ord``
    counts its rows in the record in the order in which they begin; ``key`` and ``pos`` say where under the
    parent it stands; ``link`` is a node's parent node (see ``links``). Null, invalid and cut-off records have no
    rows; a null entry of a list is no row; rows repeated with one key count once. The schema graph (types, not
    records) comes to the driver and may have ``most_edges`` edges; ``inline`` names what is inlined if it is
    known. ``with_fields`` off leaves out the fields.
    """
    records = complete_records(df, key, text)
    if inline is None:
        inline = inlined(_graph(records, child_keys, top_keys, most_edges, False))
    key_type = records.schema["record"].dataType
    fields_type = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Shredder(child_keys, top_keys, inline)
        for batch in batches:
            ids, rows, to, source = [], [], [], batch["record"]
            for i, value in enumerate(batch["text"].to_pylist()):
                value = parse(value)
                if value is not None:
                    own = list(walk.rows(value))
                    rows.extend(own), to.extend(links(own)), ids.extend([i] * len(own))
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(c, k) for c, k in zip(cols, _KINDS)]
            out = [source.take(pa.array(ids, pa.int64())), *arrays, pa.array(to, pa.int32())]
            names = ["record", "table", "ord", "parent_table", "parent_ord", "key", "pos", "link"]
            if with_fields:
                out.append(pa.array([list(x.items()) for x in cols[6]], fields_type))
                names.append("fields")
            yield pa.record_batch(out, names=names)

    schema = ROWS.format(key=key_type.simpleString()) + (", fields map<string,string>" if with_fields else "")
    return records.mapInArrow(run, schema)


def node_table(rows: DataFrame) -> DataFrame:
    """``record, node_ord, parent_ord, nested`` and, if ``rows`` have them, ``fields``: nodes with their parent's
    number, -1 for none (see ``links``)."""
    kept = [c for c in rows.columns if c == "fields"]
    return rows.where("table = 'node'").select("record", F.col("ord").alias("node_ord"), F.col("link").alias("parent_ord"), (F.col("parent_table") == NODE).alias("nested"), *kept)


def typed_columns(edges: list[tuple[str, str, str, int]], inline: frozenset) -> dict[str, dict[str, str]]:
    """For each table the SQL type of each of its columns, inlined ones under their dotted names; a field of
    integers and other numbers is a double, of different types otherwise a string."""
    scalars: dict[str, dict[str, set]] = {}
    children: dict[str, list[tuple[str, str]]] = {}
    tables = {RECORD}
    for parent, key, child, _ in edges:
        if child[:1] == "=":
            scalars.setdefault(parent, {}).setdefault(key, set()).add(child[1:])
        else:
            children.setdefault(parent, []).append((key, child))
            tables |= {parent, child}
    out: dict[str, dict[str, set]] = {}
    gone: set[str] = set()

    def fill(table: str, kind: str, prefix: str) -> None:
        for name, types in scalars.get(kind, {}).items():
            out[table].setdefault(prefix + name, set()).update(types)
        for key, child in children.get(kind, ()):
            if (table, prefix + key) in inline:
                gone.add(child)
                fill(table, child, f"{prefix}{key}.")

    for table in sorted(tables):
        out[table] = {}
        fill(table, table, "")
    one = lambda types: next(iter(types)) if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"
    return {t: {c: one(types) for c, types in sorted(columns.items())} for t, columns in out.items() if t not in gone}


def flat_tables(df: DataFrame, key: str, text: str, child_keys=CHILD_KEYS, top_keys=TOP_KEYS, most_edges: int = 100_000) -> dict[str, DataFrame]:
    """The related tables, by name: ``record, ord, parent_table, parent_ord, key, pos, link`` and one typed column
    for each field, inlined ones under dotted names with ``f.`` before every field's name (so that no field
    clashes with these columns). Empty records give the one table ``record`` without fields.
    """
    records = complete_records(df, key, text)
    edges = _graph(records, child_keys, top_keys, most_edges, True)
    inline = inlined([e for e in edges if e[2][:1] != "="])
    rows = shred(df, key, text, child_keys, top_keys, inline=inline)
    out = {}
    for name, columns in typed_columns(edges, inline).items():
        cells = [F.col("fields")[c].try_cast(t).alias("f." + c) for c, t in columns.items()]
        out[name] = rows.where(F.col("table") == name).select("record", "ord", "parent_table", "parent_ord", "key", "pos", "link", *cells)
    return out


def field_table(rows: DataFrame) -> DataFrame:
    """``record, table, ord, parent_table, parent_ord, name, value``: one row for each field of each row."""
    return rows.select("record", "table", "ord", "parent_table", "parent_ord", F.explode("fields").alias("name", "value"))

"""Nested records to flat related tables by shared inlining.

The schema graph has one node per element name and one edge per "element occurs in element". A pass over
the records finds it (per partition, then merged: it is as small as the schema, not as the data). An
element gets a table of its own if it occurs as a list, inside two different parents, or inside itself;
all others are inlined into the nearest ancestor that has one, as columns named by the path with ``_`` (numbered where names clash)
and typed as the values are. Each row has its ``node_id``, its parent's ``parent_id``, its place ``path`` and its position ``pos``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stockroom.session import staged

ROOT = ""


def _loads(text: str | None):
    """The JSON value of ``text``; ``ValueError`` if it is none."""
    if text is None or not text.strip():
        raise ValueError("blank")
    return json.loads(text, parse_constant=lambda c: _bad(c))


def _bad(what: str):
    raise ValueError(what)


def _as_list(value) -> list | None:
    """The list that ``value`` is or holds as JSON text."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
        return value if isinstance(value, list) else None
    return None


def elements(value) -> list:
    """The elements in place of a list: the list itself, the list in JSON text, or the single element; none for null and blank text."""
    found = _as_list(value)
    if found is not None:
        return found
    if value is None or isinstance(value, str) and not value.strip():
        return []
    return [value]


def as_text(value) -> str:
    """A scalar as text: blank for null, JSON's own words for booleans."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


#: Types of scalars; a column of several is text, of whole and other numbers double.
SCALARS = ("boolean", "long", "double", "string")
#: Between the names of a path within a row's map of columns.
JOINT = "\x1f"


def kind_of(value) -> str:
    """The type of a scalar."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long" if -(1 << 63) <= value < 1 << 63 else "string"
    return "double" if isinstance(value, float) else "string"


@dataclass(frozen=True)
class Graph:
    """Edges (parent, child) with how the child occurs: ``object``, ``list`` or the type of a scalar (``boolean``, ``long``, ``double``, ``string``); ``tables``: the elements that get one."""

    edges: tuple[tuple[str, str, str], ...]
    tables: tuple[str, ...]
    root: str

    @staticmethod
    def of(edges: Iterable[tuple[str, str, str]], root: str, lists: Iterable[str] = ()) -> Graph:
        edges = sorted(set(edges))
        nested = {(p, c) for p, c, kind in edges if kind not in SCALARS}
        repeated = {c for _, c, kind in edges if kind == "list"} | set(lists) | {root}
        parents: dict[str, set[str]] = {}
        below: dict[str, set[str]] = {}
        for p, c in nested:
            parents.setdefault(c, set()).add(p)
            below.setdefault(p, set()).add(c)

        def reach(start: str) -> set[str]:
            seen, todo = set(), list(below.get(start, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += below.get(x, ())
            return seen

        recursive = {x for x in below if x in reach(x)}
        shared = {c for c, ps in parents.items() if len(ps) > 1}
        return Graph(tuple(edges), tuple(sorted(repeated | shared | recursive)), root)


def _edges_of(value, name: str, found: set) -> None:
    """Adds the edges below an element called ``name``."""
    todo = [(name, value)]
    while todo:
        name, value = todo.pop()
        if not isinstance(value, dict):
            continue
        for key, child in value.items():
            items = _as_list(child)
            if items is not None:
                found.add((name, key, "list"))
                todo += [(key, x) for x in items]
            elif isinstance(child, dict):
                found.add((name, key, "object"))
                todo.append((key, child))
            elif child is not None:
                found.add((name, key, kind_of(child)))


def root_elements(body: str | None, container: str | None, root: str) -> tuple[list, str]:
    """The records of ``body`` and the path they start from; ``ValueError`` if it isn't of the kind."""
    value = _loads(body)
    if container is None:
        if not isinstance(value, list):
            raise ValueError("no list")
        return value, ""
    if not isinstance(value, dict) or container not in value:
        raise ValueError("no such object")
    return elements(value[container]), root


def schema_graph(pages: DataFrame, body: str, container: str | None, root: str, lists: Iterable[str] = ()) -> Graph:
    """The schema graph of all records in column ``body``.

    ``container`` is the key of the object that holds the records, or None if the body is their list; ``lists``
    names elements known to be lists whatever this data shows. Bodies of another kind give no edges; an empty
    table gives the graph with the root and ``lists`` only.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str, str]] = set()
        for batch in batches:
            for text in batch.column(0):
                try:
                    records, _ = root_elements(text.as_py(), container, root)
                except (ValueError, RecursionError):
                    continue
                for record in records:
                    _edges_of(record, root, found)
        yield pa.RecordBatch.from_pylist([{"p": p, "c": c, "k": k} for p, c, k in sorted(found)], schema=pa.schema([("p", pa.string()), ("c", pa.string()), ("k", pa.string())]))

    edges = pages.select(body).mapInArrow(scan, "p string, c string, k string").distinct()
    return Graph.of(((r.p, r.c, r.k) for r in edges.toLocalIterator()), root, lists)


NODES = T.StructType(
    [
        T.StructField("node_table", T.StringType()),
        T.StructField("page_key", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("parent_table", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _rows_of(records: list, start: str, graph: Graph, page: int) -> Iterator[tuple]:
    """Rows (table, page, path, parent path, parent table, position, plain text, columns) below one body, without recursion."""
    tables = set(graph.tables)
    todo = [(x, graph.root, f"{start}[{i}]", "", "", i) for i, x in enumerate(records) if x is not None]
    todo.reverse()
    while todo:
        value, table, path, above, above_table, pos = todo.pop()
        columns: dict[str, str] = {}
        plain = None
        if isinstance(value, dict):
            inside: list[tuple[tuple[str, ...], str, dict]] = [((), "", value)]
            children = []
            while inside:
                prefix, places, obj = inside.pop()
                for key, child in obj.items():
                    place = f"{places}.{key}"
                    if key in tables:
                        children += [(x, key, f"{path}{place}[{i}]", path, table, i) for i, x in enumerate(elements(child)) if x is not None]
                    elif isinstance(child, dict):
                        inside.append(((*prefix, key), place, child))
                    elif child is not None:
                        columns[JOINT.join((*prefix, key))] = as_text(child)
            todo += reversed(children)
        else:
            plain = as_text(value)
        yield table, page, path, above or None, above_table or None, pos, plain, columns


def nodes(pages: DataFrame, key: str, body: str, container: str | None, graph: Graph) -> DataFrame:
    """All rows of all flat tables in one pass: see ``NODES``.

    Null elements give no row but keep their position; a single element in place of a list has position 0; a list
    given as JSON text counts as the list; blank text in place of a list is an empty list. Bodies of another kind,
    cut off, blank or null give no rows. Repeated pages count each. Null fields give no column value.
    """

    schema = pa.schema(
        [("node_table", pa.string()), ("page_key", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("parent_table", pa.string()), ("pos", pa.int32()), ("item", pa.string()), ("columns", pa.map_(pa.string(), pa.string()))]
    )

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    records, start = root_elements(text.as_py(), container, graph.root)
                except (ValueError, RecursionError):
                    continue
                for row in _rows_of(records, start, graph, page):
                    out.append(row)
                    if len(out) >= 20_000:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return pages.select(F.col(key).cast("long"), F.col(body)).mapInArrow(shred, NODES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[7] = [list(x.items()) for x in columns[7]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Columns that each table has beside the inlined ones.
FIXED = ("node_id", "parent_id", "parent_table", "page_key", "path", "pos", "item")


def columns_of(graph: Graph, table: str) -> list[tuple[str, str, str]]:
    """The columns inlined into ``table`` (its scalars and those of singleton descendants): path (names with ``JOINT``), name and type.

    Names are the paths with ``_``; where paths give one name (or that of a fixed column), letter case apart, those after the first in the order of paths are numbered from 2 on.
    """
    own = set(graph.tables)
    kinds: dict[tuple[str, ...], set[str]] = {}
    todo: list[tuple[str, tuple[str, ...]]] = [(table, ())]
    while todo:
        name, prefix = todo.pop()
        for p, c, kind in graph.edges:
            if p == name and c not in own:
                if kind in SCALARS:
                    kinds.setdefault((*prefix, c), set()).add(kind)
                else:
                    todo.append((c, (*prefix, c)))
    taken, found = set(FIXED), []
    for path in sorted(kinds):
        name, n = "_".join(path), 1
        while (unique := name if n == 1 else f"{name}_{n}").lower() in taken:
            n += 1
        taken.add(unique.lower())
        of = kinds[path]
        found.append((JOINT.join(path), unique, of.pop() if len(of) == 1 else "double" if of == {"long", "double"} else "string"))
    return found


def flat_tables(pages: DataFrame, key: str, body: str, container: str | None, root: str, lists: Iterable[str] = ()) -> dict[str, DataFrame]:
    """One DataFrame per table of the schema graph: ``node_id``, ``parent_id`` (null at the root), ``parent_table``, ``page_key``, ``path``, ``pos``, ``item`` (an element that is plain text) and the inlined columns in the types of their values.

    Bodies are parsed once for the schema and once for all tables, whose rows are kept by table.
    """
    graph = schema_graph(pages, body, container, root, lists)
    rows = staged(nodes(pages, key, body, container, graph), "node_table")
    identity = lambda path: F.when(F.col(path).isNotNull(), F.concat_ws("/", F.col("page_key").cast("string"), F.col(path)))
    tables = {}
    for name in graph.tables:
        inlined = [F.col("columns").getItem(path).try_cast(kind).alias(column) for path, column, kind in columns_of(graph, name)]
        tables[name] = rows.where(F.col("node_table") == name).select(identity("path").alias("node_id"), identity("parent_path").alias("parent_id"), "parent_table", "page_key", "path", "pos", "item", *inlined)
    return tables

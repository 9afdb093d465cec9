"""Deeply nested records as flat tables: Dewey labels.

Every element of a record gets the label of its path of ordinals: the root is
'1', its third child element '1.3'. A label's parent is the label without its
last part, its schema path the local names on the way. Nodes with the same
schema path (or the same last name) form one table; parent keys come from
joining labels that were cut to the ancestor wanted, not from nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "rec_no long, dewey string, path string, name string, attrs map<string,string>, text string"


def _nodes(xml: str) -> list[tuple[str, str, str, dict, str | None]] | None:
    """(label, path, local name, attributes, own text) of each element in document order; None if the text is not well-formed.

    Prefixes and namespaces are cut off element and attribute names. External
    entities are never read, and references to internal ones stay in the text
    as they are written, so that no declaration can blow a record up; the
    record itself is kept.
    """
    out: list[list] = []
    stack: list[list] = []  # [node, number of children]
    parser = expat.ParserCreate()

    def start(name, attrs):
        name = name.rpartition(":")[2]
        if stack:
            top, n = stack[-1]
            stack[-1][1] += 1
            label, path = f"{top[0]}.{n + 1}", f"{top[1]}/{name}"
        else:
            label, path = "1", name
        keep = {k.rpartition(":")[2]: v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")} if attrs else attrs
        node = [label, path, name, keep, []]
        out.append(node)
        stack.append([node, 0])

    def end(_):
        stack.pop()

    def text(chars):
        stack[-1][0][4].append(chars)

    def other(data):
        if stack and data[:1] == "&":
            text(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    # a default handler keeps internal entities from being expanded
    parser.DefaultHandler = other
    parser.buffer_text = True
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, ValueError, UnicodeError):
        return None
    return [(label, path, name, attrs, "".join(parts).strip() or None) for label, path, name, attrs, parts in out]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    kinds: pa.Schema | None = None

    def flush():
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kinds)], schema=kinds)

    for batch in batches:
        kinds = kinds or pa.schema([
            ("rec_key", batch.schema.field(0).type), ("rec_no", pa.int64()), ("dewey", pa.string()), ("path", pa.string()),
            ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
        ])
        for key, no, xml in zip(*(c.to_pylist() for c in batch.columns)):
            for label, path, name, attrs, text in _nodes(xml) or ():
                rows.append((key, no, label, path, name, list(attrs.items()), text))
                if len(rows) >= 20_000:
                    yield flush()
                    rows.clear()
    if rows:
        yield flush()


def dewey_nodes(frame: DataFrame, key: str, xml: str) -> DataFrame:
    """(rec_key, rec_no, dewey, path, name, attrs, text): one row for each element of each well-formed record.

    rec_no tells copies of a record apart: equal texts under one key are one
    record, other texts under the same key get numbers of their own. Null,
    empty and not well-formed texts give no row. A record is parsed by one
    task in one pass with a stack as deep as its nesting; its rows are sent on
    in batches, so many small records need no more memory than 20,000 nodes.
    """
    picked = frame.select(F.col(f"`{key}`").alias("rec_key"), F.xxhash64(F.col(f"`{xml}`")).alias("rec_no"), F.col(f"`{xml}`").alias("xml"))
    kind = dict(picked.dtypes)["rec_key"]
    once = picked.filter("xml IS NOT NULL AND xml <> ''").groupBy("rec_key", "rec_no").agg(F.first("xml").alias("xml"))
    return once.mapInArrow(_parse, f"rec_key {kind}, {NODE_SCHEMA}")


def cut(label: Column, levels: int) -> Column:
    """The ancestor label that many levels up; '' above the root."""
    return F.regexp_replace(label, rf"(\.?\d+){{{levels}}}$", "")


def tables_by_path(nodes: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame for each schema path found: the nodes with their parent's label. The number of paths is a property of the schema, not of the rows."""
    paths = [r["path"] for r in nodes.select("path").distinct().collect()]
    with_parent = nodes.withColumn("parent", cut(F.col("dewey"), 1))
    return {p: with_parent.filter(F.col("path") == p) for p in sorted(paths)}


def entity_ids(nodes: DataFrame, entities: Mapping[str, str]) -> DataFrame:
    """(rec_key, rec_no, dewey, name, node_id) of the elements named in ``entities``: {element name: child element that holds its id}.

    The id is the attribute ``id`` or else the text of that child element; what
    is no number gives null.
    """
    named = nodes.filter(F.col("name").isin(list(entities)))
    child_of = {child: name for name, child in entities.items()}
    ids = nodes.filter(F.col("name").isin(list(child_of))).select(
        "rec_key", "rec_no", cut(F.col("dewey"), 1).alias("dewey"), F.col("text").alias("id_text"),
        F.element_at(F.create_map(*[F.lit(x) for kv in child_of.items() for x in kv]), F.col("name")).alias("name"),
    ).groupBy("rec_key", "rec_no", "dewey", "name").agg(F.min("id_text").alias("id_text"))
    return named.join(ids, ["rec_key", "rec_no", "dewey", "name"], "left").select(
        "rec_key", "rec_no", "dewey", "name",
        F.coalesce(F.expr("try_cast(trim(attrs['id']) AS bigint)"), F.expr("try_cast(trim(id_text) AS bigint)")).alias("node_id"),
    )


def child_tables(nodes: DataFrame, entities: Mapping[str, str], positioned: Mapping[str, str] | None = None) -> DataFrame:
    """(rec_key, node, parent_id, node_id), distinct, from stored ``nodes``: every entity with the id of its nearest entity ancestor, else of the record.

    entities: element name → child element with its id. positioned: elements
    without id → an element above them (None: any place), numbered from 1 among
    the elements of that name and place in document order of the record; their
    parent is the record. Containers between an entity and its ancestor,
    prefixes and order do not matter. Entities without an id give a row with
    null node_id. The kinds of tables are the keys of both mappings.

    The ancestor is found by label: the chain of prefixes of a label is as
    long as the nesting is deep, and the longest prefix that is an entity wins.
    """
    found = entity_ids(nodes, entities)
    own = found.select("rec_key", "rec_no", "dewey", "name", "node_id")
    up = own.select(
        "rec_key", "rec_no", "dewey", "name", "node_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("dewey", r"\.")) - 1),
                              lambda i: F.array_join(F.slice(F.split("dewey", r"\."), 1, i), "."))).alias("above"),
    )
    anc = found.select("rec_key", "rec_no", F.col("dewey").alias("above"), F.col("node_id").alias("above_id"), F.lit(True).alias("is_entity"))
    linked = (
        up.join(anc, ["rec_key", "rec_no", "above"], "left")
        .groupBy("rec_key", "rec_no", "dewey", "name", "node_id")
        .agg(F.max(F.when(F.col("is_entity"), F.struct(F.length("above").alias("l"), F.col("above_id").alias("v")))).alias("p"))
        .select("rec_key", F.col("name").alias("node"), F.when(F.col("p").isNull(), F.col("rec_key").cast("bigint")).otherwise(F.col("p.v")).alias("parent_id"), "node_id")
    )
    out = linked
    if positioned:
        order = F.transform(F.split("dewey", r"\."), lambda x: x.cast("int"))
        inside = reduce(lambda a, kv: a | ((F.col("name") == kv[0]) & (F.lit(True) if kv[1] is None else F.concat(F.lit("/"), "path").contains(f"/{kv[1]}/"))), positioned.items(), F.lit(False))
        pos = nodes.filter(inside).withColumn(
            "node_id", F.row_number().over(Window.partitionBy("rec_key", "rec_no", "name").orderBy(order)).cast("bigint")
        )
        out = out.unionByName(pos.select("rec_key", F.col("name").alias("node"), F.col("rec_key").cast("bigint").alias("parent_id"), "node_id"))
    return out.distinct()


_INT = re.compile(r"\s*[+-]?\d{1,19}\s*")


def _number(text: str | None) -> int | None:
    if text is None or not _INT.fullmatch(text):
        return None
    n = int(text)
    return n if -(2**63) <= n < 2**63 else None


def _links(found: list, key, entities: Mapping[str, str], positioned: Mapping[str, str | None]) -> set[tuple]:
    """(node, parent id, node id) of one record's labelled nodes: parents by cutting labels until one is an entity."""
    child_of: dict[str, set[str]] = {}
    for name, child in entities.items():
        child_of.setdefault(child, set()).add(name)
    kind_at: dict[str, str] = {}
    ids: dict[str, int | None] = {}
    texts: dict[str, str] = {}
    counts: dict[str, int] = {}
    out: set[tuple] = set()
    for label, path, name, attrs, text in found:
        if name in entities:
            kind_at[label] = name
            ids[label] = _number(attrs.get("id"))
        elif name in positioned and (positioned[name] is None or f"/{positioned[name]}/" in f"/{path}"):
            counts[name] = counts.get(name, 0) + 1
            out.add((name, key, counts[name]))
        if name in child_of and text is not None:
            above = label.rpartition(".")[0]
            if kind_at.get(above) in child_of[name]:
                texts[above] = min(text, texts.get(above, text))
    for label, text in texts.items():
        if ids[label] is None:
            ids[label] = _number(text)
    for label, name in kind_at.items():
        above = label.rpartition(".")[0]
        while above and above not in kind_at:
            above = above.rpartition(".")[0]
        out.add((name, ids[above] if above else key, ids[label]))
    return out


def _linked(entities: Mapping[str, str], positioned: Mapping[str, str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = None

        def flush():
            cols = list(zip(*rows))
            kinds = (kind, pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["rec_key", "node", "parent_id", "node_id"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, number, xml in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, *link) for link in _links(_nodes(xml) or [], number, entities, positioned)]
                if len(rows) >= 20_000:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    return run


def linked_tables(frame: DataFrame, key: str, xml: str, entities: Mapping[str, str], positioned: Mapping[str, str | None] | None = None) -> DataFrame:
    """The rows of ``child_tables`` straight from the records, in one pass: every record is parsed once and labelled, and its links are drawn from the labels where it stands.

    For tables of links alone; ``dewey_nodes`` gives the nodes themselves.
    Copies of a record give the same rows, which come out once. Null, empty and
    not well-formed texts give no row. A task holds one record's nodes at a time.
    """
    picked = frame.select(F.col(f"`{key}`").alias("rec_key"), F.expr(f"try_cast(`{key}` AS bigint)").alias("number"), F.col(f"`{xml}`").alias("xml")).filter("xml <> ''")
    kind = dict(picked.dtypes)["rec_key"]
    return picked.mapInArrow(_linked(dict(entities), dict(positioned or {})), f"rec_key {kind}, node string, parent_id long, node_id long").distinct()

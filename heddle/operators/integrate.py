"""Integration: several id-keyed streams joined into one nested record per root id.

A tree names where each source goes: ``Integrator("BIB_ID").add("/record/marc",
bib, ["BIB_ID"])`` and so on. The tree compiles to joins and aggregates bottom
up, so Catalyst plans it like any query:

* siblings without a payload above them meet in a full outer join by their ids;
* a node with a payload left-joins its children to it;
* a node without payload and with one child gathers that child's rows into an
  array, one id level up, ordered by id; so does one with several children that
  is told to, after these were joined;
* a required child drops what lacks it, among the children of its node only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.ids import MOST_LEVELS


@dataclass
class Node:
    name: str
    frame: DataFrame | None = None
    ids: list[str] | None = None
    required: bool = False
    #: None: gathered exactly if there is no payload and one child.
    aggregating: bool | None = None
    children: list[Node] = field(default_factory=list)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    @property
    def gathers(self) -> bool:
        return self.aggregating if self.aggregating is not None else self.frame is None and len(self.children) == 1


class Integrator:
    """A tree of sources. ``fused``: full joins as union and one aggregation, a single shuffle for any number of siblings; the rows are the same, repeated ids included. An id's rows meet in one task there; where an id may have very many, leave it off."""

    def __init__(self, fused: bool = False):
        self.root = Node("")
        self.fused = fused
        #: The id type of each level; all sources agree on it.
        self.types: list[str] = []

    def add(self, path: str, frame: DataFrame, ids: list[str], required: bool = False, aggregating: bool | None = None) -> Integrator:
        """Puts a source at ``path``; nodes on the way are made as needed and not required. A path is taken once; a required or gathering flag of an inner node is set by ``flag``."""
        names = [n for n in path.split("/") if n]
        if not names:
            raise ValueError("a source needs a path")
        if not 0 < len(ids) <= MOST_LEVELS:
            raise ValueError(f"between 1 and {MOST_LEVELS} id levels, not {len(ids)}")
        node = self._at(names)
        if node.frame is not None:
            raise ValueError(f"{path} has a source already")
        for i, name in enumerate(ids):
            if i == len(self.types):
                self.types.append(name)
            elif self.types[i] != name:
                raise ValueError(f"ids of level {i + 1} are {self.types[i]}, not {name}")
        # ids go by level inside the tree, whatever payload columns and elements are called
        levels = [f"__id{i}" for i in range(len(ids))]
        payload = [F.col(f"`{c}`") for c in frame.columns if c not in ids]
        node.frame = frame.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(ids, levels)], *payload)
        node.ids, node.required = levels, required
        if aggregating is not None:
            node.aggregating = aggregating
        return self

    def flag(self, path: str, required: bool | None = None, aggregating: bool | None = None) -> Integrator:
        node = self._at([n for n in path.split("/") if n])
        node.required = node.required if required is None else required
        node.aggregating = node.aggregating if aggregating is None else aggregating
        return self

    def _at(self, names: list[str]) -> Node:
        node = self.root
        for name in names:
            found = node.child(name)
            if found is None:
                found = Node(name)
                node.children.append(found)
            node = found
        return node

    def compile(self) -> DataFrame:
        """The records: root id column(s) and one column for each child of the record element, in declaration order."""
        if len(self.root.children) != 1:
            raise ValueError("all paths begin with one record element")
        record = self.root.children[0]
        # the record element wraps the ids of its children, it does not gather
        frame, ids = self._merge(record, [self._compile(c) for c in record.children]) if record.frame is None else self._compile(record, nest=False)
        return frame.select(*[F.col(c).alias(self.types[i]) for i, c in enumerate(ids)], *[F.col(f"`{c}`") for c in frame.columns if c not in ids])

    def to_xml(self) -> DataFrame:
        """(root id columns, rec_xml): the records as XML, one element for each node with its id as TYPE-number, siblings in declaration order, null payload left out. Without records there are no rows, and a document of them is its bare root."""
        frame = self.compile()
        record = self.root.children[0]
        roots = self.types[: self._root_levels(record)]
        inner = F.concat(*self._inner(record, lambda name: F.col(f"`{name}`"), [F.col(f"`{t}`") for t in roots], payload=[c for c in frame.columns if c not in roots and record.child(c) is None]))
        return frame.select(*[F.col(f"`{t}`") for t in roots], self._element(record.name, len(roots), F.col(f"`{roots[-1]}`"), inner).alias("rec_xml"))

    def _root_levels(self, record: Node) -> int:
        return len(record.ids) if record.frame is not None else self.level(record.children[0])

    def _element(self, name: str, level: int, last_id, inner):
        from heddle.ids import render_id

        return F.concat(F.lit(f'<{name} id="'), render_id(self.types[level - 1], last_id), F.lit('">'), inner, F.lit(f"</{name}>"))

    def _inner(self, node: Node, of, ids: list, payload: list[str]) -> list:
        """The parts inside an element: its payload, then its children."""
        parts = [F.lit("")]
        for c in payload:
            parts.append(F.coalesce(F.concat(F.lit(f"<{c.lower()}>"), escape_xml(of(c).cast("string")), F.lit(f"</{c.lower()}>")), F.lit("")))
        return parts + [self._emit(child, of(child.name), ids) for child in node.children]

    def _emit(self, node: Node, value, ids: list):
        """The element of a node from its value in the compiled record; '' for null."""
        if node.frame is None and node.gathers:
            inner = F.array_join(F.transform(value, lambda x: F.concat(*[self._emit(child, x[child.name], [*ids, x["_id"]]) for child in node.children])), "")
        else:
            payload = [c for c in node.frame.columns if c not in node.ids] if node.frame is not None else []
            inner = F.concat(*self._inner(node, lambda name: value[name], ids, payload))
        return F.coalesce(F.when(value.isNotNull(), self._element(node.name, len(ids), ids[-1], inner)), F.lit(""))

    def level(self, node: Node) -> int:
        """The number of ids a node's rows are keyed by; siblings that differ in it cannot be joined."""
        if node.frame is not None:
            return len(node.ids)
        levels = {self.level(c) for c in node.children}
        if not levels:
            raise ValueError(f"{node.name}: neither source nor children")
        if len(levels) > 1:
            raise ValueError(f"{node.name}: children with different numbers of ids: {sorted(levels)}")
        return levels.pop() - 1 if node.gathers else levels.pop()

    def _compile(self, node: Node, nest: bool = True) -> tuple[DataFrame, list[str], str, bool]:
        kids = [self._compile(c) for c in node.children]
        if node.frame is not None:
            payload = [c for c in node.frame.columns if c not in node.ids]
            base, ids = node.frame, node.ids
            for frame, kid_ids, name, required in kids:
                if kid_ids != ids:
                    raise ValueError(f"{name} is keyed by {kid_ids}, the payload of {node.name} by {ids}")
                base = base.join(frame, ids, "inner" if required else "left")
            inner = [*payload, *[k[2] for k in kids]]
            if not nest:
                return base, ids
        else:
            self.level(node)
            if node.gathers:
                frame, ids = (kids[0][0], kids[0][1]) if len(kids) == 1 else self._merge(node, kids)
                if len(ids) < 2:
                    raise ValueError(f"{node.name} cannot gather {kids[0][2]}: no id level above it")
                if kids[0][3] and len(kids) == 1:
                    frame = frame.filter(F.col(f"`{kids[0][2]}`").isNotNull())
                item = F.struct(F.col(ids[-1]).alias("_id"), *[F.col(f"`{k[2]}`").alias(k[2]) for k in kids])
                base = frame.groupBy(*ids[:-1]).agg(F.array_sort(F.collect_list(item)).alias(node.name))
                return base, ids[:-1], node.name, node.required
            base, ids = self._merge(node, kids)
            inner = [k[2] for k in kids]
        made = F.struct(*[F.col(f"`{c}`") for c in inner]) if inner else F.struct(F.lit(True).alias("_self"))
        return base.select(*ids, made.alias(node.name)), ids, node.name, node.required

    def _merge(self, node: Node, kids: list) -> tuple[DataFrame, list[str]]:
        ids = kids[0][1]
        for _, other, name, _ in kids:
            if other != ids:
                raise ValueError(f"{name} is keyed by {other}, its siblings by {ids}")
        names = [k[2] for k in kids]
        if self.fused and len(kids) > 1:
            # each sibling's rows of an id are gathered, and combined with the others' as a full join combines them
            parts = [frame.select(*ids, F.array(F.struct(F.col(f"`{name}`").alias("v"))).alias(name)) for frame, _, name, _ in kids]
            merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            base = merged.groupBy(*ids).agg(*[F.flatten(F.collect_list(F.col(f"`{n}`"))).alias(n) for n in names])
            for n in names:
                base = base.withColumn(n, F.explode_outer(f"`{n}`"))
            base = base.select(*ids, *[F.col(f"`{n}`")["v"].alias(n) for n in names])
        else:
            base = kids[0][0]
            for frame, _, _, _ in kids[1:]:
                base = base.join(frame, ids, "full")
        for _, _, name, required in kids:
            if required:
                base = base.filter(F.col(f"`{name}`").isNotNull())
        return base, ids


def escape_xml(x):
    """Text inside an element: signs that markup uses as entities, those that XML does not allow replaced."""
    from heddle.functions.text import sanitize

    return F.replace(F.replace(F.replace(sanitize(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Elements of a configuration in this namespace say what to do; all others are the paths of the output.
CONFIG = "urn:heddle:config"


def from_config(text: str, source, params: DataFrame | None = None, **options) -> Integrator:
    """The tree of an XML configuration.

    <c:source type="integrate" xmlns:c="urn:heddle:config"> holds the output's
    elements; one with c:required="true" is required, one with a c:source inside
    takes its rows from it. ``source(type, properties)`` gives (frame, ids) for
    such a leaf; its properties are its c:property elements over those of the
    whole. ``params``: (value) ids that all sources are restricted to, by their
    first id, as one list for all.
    """
    from xml.etree import ElementTree

    from heddle.operators.records import pivot

    top = ElementTree.fromstring(text)
    mine = lambda e, name: e.tag == f"{{{CONFIG}}}{name}"
    if not mine(top, "source") or top.get("type") != "integrate":
        raise ValueError("a configuration begins with a source of type integrate")
    tree = Integrator(**options)
    flags: list[tuple[str, bool]] = []

    def properties(e) -> dict[str, str]:
        return {p.get("name").strip(): (p.text or "").strip() for p in e if mine(p, "property") and (p.get("name") or "").strip()}

    shared = properties(top)

    def walk(e, path: str) -> None:
        for child in e:
            if mine(child, "property"):
                continue
            if mine(child, "source"):
                frame, ids = source(child.get("type"), shared | properties(child))
                if params is not None:
                    frame = pivot(params, params.columns[0], frame, ids[0])
                tree.add(path, frame, ids)
            elif child.tag.startswith(f"{{{CONFIG}}}"):
                raise ValueError(f"{child.tag.rpartition('}')[2]} is no element of an integrate configuration")
            else:
                inner = f"{path}/{child.tag.rpartition('}')[2]}"
                walk(child, inner)
                flags.append((inner, child.get(f"{{{CONFIG}}}required") == "true"))

    walk(top, "")
    for path, required in flags:
        tree.flag(path, required=required)
    return tree


def integrate(paths: list[tuple], **options) -> DataFrame:
    """integrate([(path, frame, ids, required), …]): the tree from a list."""
    tree = Integrator(**options)
    for path, frame, ids, *rest in paths:
        tree.add(path, frame, ids, *rest)
    return tree.compile()

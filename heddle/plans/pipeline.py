"""Pipelines: commands with options, chained left to right, from a list, a configuration or a command line."""

from __future__ import annotations

import configparser
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from importlib import metadata
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text
from heddle.operators import integrate, records
from heddle.sinks import files as sinks
from heddle.sources import files, sqltemplate

PASS, SPLIT, JOIN = 0, 1, 2


@dataclass
class Op:
    command: str
    options: dict[str, str] = field(default_factory=dict)


Command = Callable[[SparkSession, DataFrame | None, dict], DataFrame]
REGISTRY: dict[str, tuple[Command, int]] = {}


def command(name: str, kind: int = PASS):
    def register(function: Command) -> Command:
        REGISTRY[name] = (function, kind)
        return function

    return register


def load_plugins(group: str = "heddle.commands") -> None:
    """Commands of installed packages: entry points name a function of (spark, frame, options)."""
    for point in metadata.entry_points(group=group):
        REGISTRY.setdefault(point.name, (point.load(), PASS))


@command("input")
def _input(spark, frame, o):
    """XML files, or lists of them: files-from names a list, and an input that does not begin with '<' is one."""
    delimiter, row_tag = "\0" if "from0" in o else o.get("input-delimiter"), o.get("row-tag", "record")
    if "files-from" in o:
        return files.read_listed(spark, files.read_params(spark, o["files-from"], delimiter), row_tag)
    if not files.is_content(files.first_sign(spark, o["input"])):
        return files.read_listed(spark, files.read_params(spark, o["input"], delimiter), row_tag)
    return files.read_xml(spark, o["input"], row_tag)


@command("split", SPLIT)
def _split(spark, frame, o):
    return records.split_chunks(frame, o.get("document", "system_id").split(","), o.get("position", "rec_pos"), int(o.get("chunk-size", 100)))


@command("join", JOIN)
def _join(spark, frame, o):
    return frame.withColumn("run_no", F.lit(0)) if "all" in o else records.concat_runs(frame, o.get("document", "system_id"), o.get("position", "doc_pos"))


@command("db-to-xml")
def _query(spark, frame, o):
    ids = [c for c in o.get("id-field-labels", "").split(",") if c]
    if frame is None:
        out = sqltemplate.run(spark, o["sql"], suppress="suppress-param-clause" in o)
    else:
        probe = sqltemplate.parse(o["sql"], 1)
        asked = spark.sql(sqltemplate.parse(o["sql"], suppress=True).sql)
        if not any(probe.repeated) and probe.kinds:
            raise ValueError("single parameters need their values: use sqltemplate.run")
        out = records.pivot(frame, o.get("token", frame.columns[0]), asked, o.get("param", ids[0] if ids else asked.columns[0]))
    return records.nest(out, ids) if ids and "nest" in o else out


@command("process")
def _process(spark, frame, o):
    """An expression for each record; with record-xpath its id from its XML. Failing records are left out (subdivide-on-failure), or their whole chunk is."""
    out = frame
    if "record-xpath" in o:
        out = records.record_ids(out, o.get("xml", "xml"), o["record-xpath"])
    if "expr" in o:
        out = out.select("*", F.expr(o["expr"]).alias(o.get("name", "value")))
    if "failed" in o:
        bad = F.expr(o["failed"])
        out = records.isolate(out, bad)[0] if "subdivide-on-failure" in o else records.drop_failed_chunks(out, o.get("chunk", "chunk_no").split(","), bad)
    return out


@command("integrate")
def _integrate(spark, frame, o):
    """A configuration of sources; what comes in from the command before is the list of ids that all of them are restricted to."""
    with open(o["config"], encoding="utf-8") as f:
        text = f.read()

    def source(kind: str, p: dict) -> tuple[DataFrame, list[str]]:
        ids = [c for c in p.pop("id-field-labels", "").split(",") if c]
        return REGISTRY[kind][0](spark, None, p), ids

    return integrate.from_config(text, source, params=frame, fused="fused" in o).to_xml()


@command("solrpost")
def _post(spark, frame, o):
    """Posts index documents and, at the end, a commit."""
    lines = frame if "value" in frame.columns else sinks.index_lines(frame, o.get("id", "id"), o.get("fields", "fields"))
    sinks.post_documents(lines, o["url"], int(o.get("batch", 100)), retries=int(o.get("retries", 3)), commit="no-commit" not in o)
    return frame


@command("tee")
def _tee(spark, frame, o):
    return records.tee(frame, lambda f: f.write.mode("overwrite").parquet(o["path"]))


@command("output")
def _output(spark, frame, o):
    """Writes tables in a format of Spark's, or with ``documents`` XML documents by the rules of sinks.output_paths."""
    where = o.get("output", "-")
    if "documents" in o or "output-base-name" in o:
        names = [c for c in ("doc_pos", "run_no", "chunk_no") if c in frame.columns]
        number = o.get("number") or (names[-1] if names else None)
        keyed = frame if number else frame.withColumn("doc_pos", F.lit(0))
        keyed = keyed if "system_id" in keyed.columns else keyed.withColumn("system_id", F.lit(""))
        number = number or "doc_pos"
        xml = o.get("xml") or next((c for c in ("rec_xml", "xml") if c in frame.columns), None)
        keyed = keyed if xml else keyed.withColumn("xml", text.verbatim(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), o.get("row-tag", "record")))
        documents = keyed.select("system_id", number).distinct()
        placed = sinks.output_paths(
            documents, "system_id", number, output=where, is_directory=os.path.isdir(where), input_base=o.get("input-base", ""), base_name=o.get("output-base-name"),
            suffix_length=int(o.get("suffix-length", 5)), extension=o.get("output-extension"), gz="gzip" in o, grouped=not names or number == "run_no")
        sinks.write_documents(keyed.join(placed, ["system_id", number]), "path", xml or "xml", [c for c in (o.get("order"), "rec_pos", xml or "xml") if c in keyed.columns], o.get("root", "root"))
    elif where != "-":
        writer = frame.write.mode("overwrite").format(o.get("format", "parquet"))
        (writer.option("compression", "gzip") if "gzip" in o else writer).save(where)
    return frame


def run(spark: SparkSession, ops: list[Op], frame: DataFrame | None = None) -> DataFrame:
    unknown = [op.command for op in ops if op.command not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown command {unknown[0]}; there are {', '.join(sorted(REGISTRY))}")
    return reduce(lambda df, op: REGISTRY[op.command][0](spark, df, op.options), ops, frame)


def kind_of(ops: list[Op]) -> int:
    """Whether a pipeline splits or joins documents: the strongest of its commands."""
    return max((REGISTRY[op.command][1] for op in ops), default=PASS)


#: Short names of the options of output; -z stands for --gzip.
SHORT = {"b": "output-base-name", "l": "suffix-length", "o": "output"}


def parse_args(argv: list[str], flags: tuple[str, ...] = ("all", "from0", "gzip", "no-indent", "nest", "subdivide-on-failure", "suppress-param-clause", "documents", "fused", "no-commit")) -> list[Op]:
    """[[--command] [--option [value]]*]+: options before any command belong to an input; an output is added if there is none."""
    ops: list[Op] = []
    at = 0
    while at < len(argv):
        word = argv[at]
        name = word.lstrip("-")
        if word.startswith("--") and name in REGISTRY and not (ops and name == "input" and ops[-1].command == "input" and "input" not in ops[-1].options and "files-from" not in ops[-1].options):
            ops.append(Op(name))
        else:
            if not ops:
                ops.append(Op("input"))
            if not word.startswith("-"):
                ops[-1].options["input" if ops[-1].command == "input" else "path"] = word
            elif name in flags or ops[-1].command == "output" and word == "-z":
                ops[-1].options["gzip" if word == "-z" else name] = ""
            else:
                at += 1
                if at == len(argv):
                    raise ValueError(f"{word} needs a value")
                ops[-1].options[SHORT.get(name, name) if ops[-1].command == "output" else name] = argv[at]
        at += 1
    if not ops or ops[-1].command != "output":
        ops.append(Op("output"))
    return ops


def parse_config(text: str, overrides: dict[str, str] | None = None) -> list[Op]:
    """Commands of an XML configuration: <pipeline><command type="…"><property name="…">value</property>key=value lines</command>…; overrides win."""
    ops = []
    for node in ElementTree.fromstring(text):
        options: dict[str, str] = {}
        lines = "".join([node.text or "", *[c.tail or "" for c in node]]).strip()
        if lines:
            reader = configparser.RawConfigParser(delimiters=("=", ":"))
            reader.optionxform = str
            reader.read_string("[x]\n" + "\n".join(s.strip() for s in lines.splitlines()))
            options.update(reader["x"])
        options.update({c.get("name"): (c.text or "").strip() for c in node.iter("property")})
        options.update(overrides or {})
        ops.append(Op(node.get("type"), options))
    return ops


def main(argv: list[str] | None = None) -> int:
    import sys

    load_plugins()
    spark = SparkSession.builder.appName("heddle").getOrCreate()
    ops = parse_args(sys.argv[1:] if argv is None else argv)
    frame = run(spark, ops)
    # what went to files is not worked out again for the screen
    if ops[-1].options.get("output", "-") == "-" and "output-base-name" not in ops[-1].options:
        for row in frame.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

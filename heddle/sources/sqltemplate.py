"""SQL with typed parameters: <\\TYPE\\> for one value, <\\TYPE*\\> for a list, <\\ … \\> for a clause that can be left out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TYPES = {"INTEGER": "int", "DECIMAL": "float", "BIGINT": "bigint"}
_PARAM = re.compile(r"<\\(" + "|".join(TYPES) + r")(\*?)\\>")


@dataclass(frozen=True)
class Template:
    """sql with ? for each value; kinds: the Spark type of each parameter; repeated: whether it takes a list."""

    sql: str
    kinds: tuple[str, ...]
    repeated: tuple[bool, ...]


def parse(text: str, batch: int = 6, suppress: bool = False) -> Template:
    """The template as SQL. Parameters are all lists of one type or all single values; a mixture is refused. suppress leaves out the optional clauses with their parameters."""
    out, kinds, repeated, at, open_clauses = [], [], [], 0, 0
    while at < len(text):
        m = _PARAM.match(text, at)
        if m:
            if not (suppress and open_clauses):
                kinds.append(TYPES[m[1]])
                repeated.append(bool(m[2]))
                out.append(",".join("?" * batch) if m[2] else "?")
            at = m.end()
        elif text.startswith("<\\", at):
            open_clauses += 1
            at += 2
        elif text.startswith("\\>", at):
            if not open_clauses:
                raise ValueError("a clause ends that did not begin")
            open_clauses -= 1
            at += 2
        else:
            if not (suppress and open_clauses):
                out.append(text[at])
            at += 1
    if open_clauses:
        raise ValueError("a clause does not end")
    if len(set(repeated)) > 1:
        raise ValueError("list and single parameters cannot be mixed")
    if any(repeated) and len(set(kinds)) > 1:
        raise ValueError("list parameters share one type")
    return Template("".join(out), tuple(kinds), tuple(repeated))


def value(kind: str, token: str):
    """A token as a value of a parameter's type; decimals may be fractions a/b."""
    if kind == "float":
        a, slash, b = token.partition("/")
        return float(a) / float(b) if slash else float(a)
    return int(token)


def run(spark: SparkSession, text: str, tokens: list[str] | None = None, *, suppress: bool = False) -> DataFrame:
    """One execution of a template with its tokens; a list parameter takes all of them. Long lists are better joined: see operators.records.pivot."""
    if suppress:
        return spark.sql(parse(text, suppress=True).sql)
    tokens = tokens or []
    probe = parse(text, 1)
    template = parse(text, len(tokens)) if any(probe.repeated) else probe
    if not any(template.repeated) and len(tokens) != len(template.kinds):
        raise ValueError(f"{len(template.kinds)} parameters, {len(tokens)} values")
    kinds = template.kinds if not any(template.repeated) else [template.kinds[0]] * len(tokens) * len(template.kinds)
    return spark.sql(template.sql, args=[value(k, t) for k, t in zip(kinds, tokens * (len(template.kinds) if any(template.repeated) else 1))])


def padded(tokens: list, batch: int) -> list[list]:
    """Tokens in batches, the last filled up with its last token, as a prepared statement binds them."""
    parts = [tokens[i : i + batch] for i in range(0, len(tokens), batch)]
    return [p + [p[-1]] * (batch - len(p)) for p in parts]

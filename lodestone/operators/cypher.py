"""A small pattern language for graphs, parsed to traversals and shortest paths.

``MATCH (a) |> [r:KIND*..N] |> (b) WHERE a.key = 1 [AND b.key = 2] RETURN …``
with ``<|`` and ``<|>`` for the other directions, and
``p = shortestPath((a) |> [*..N] |> (b))``. Parameters are ``$name``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import BOTH, IN, OUT, Graph, Policy

#: Relation kinds that patterns may name.
KINDS = {
    "CONTAINS": 10, "DEFINES": 11, "IMPORTS": 12, "INHERITS": 13, "IMPLEMENTS": 14, "CALLS": 15, "INSTANTIATES": 16, "READS": 17, "WRITES": 18,
    "ADDRESSES": 19, "EXPLAINS": 20, "MENTIONEDIN": 21, "REFERSTO": 30, "FOLLOWS": 31, "AUTHORED": 40, "MODIFIED": 41, "PARENTOF": 42,
    "COMODIFIED": 43, "BLAMEDFOR": 44, "PRODUCEDBY": 45, "ANNOTATESAT": 46, "REVERTSTO": 47, "BRANCHESFROM": 48, "OWNEDBY": 49,
    "SNAPSHOTOF": 50, "CONTAINSANNOTATION": 51,
}
#: Kinds of nodes.
NODE_KINDS = {
    "FILE": 1, "DIRECTORY": 2, "PROJECT": 3, "CLASS": 4, "INTERFACE": 5, "METHOD": 6, "PROPERTY": 7, "FIELD": 8, "VARIABLE": 9,
    "USERREQUEST": 20, "ASSISTANTRESPONSE": 21, "PLAN": 22, "GOAL": 23, "PATTERN": 30, "RULE": 31, "CONSTRAINT": 32, "GITCOMMIT": 40,
    "GITBRANCH": 41, "GITTAG": 42, "GITAUTHOR": 43, "CODEFILE": 44, "ANNOTATION": 50, "DECISION": 51, "CHECKPOINT": 52, "CONVERSATION": 53,
    "CONVTURN": 54, "ARTIFACTSNAPSHOT": 55, "PROMPT": 100, "DOCUMENTATION": 101,
}
_ARROWS = {"|>": OUT, "<|": IN, "<|>": BOTH, "->": OUT, "<-": IN, "-": BOTH}
_ARROW = r"<\|>|\|>|<\||->|<-|-"
_PATTERN = re.compile(
    rf"^\s*MATCH\s+(?:(?P<path>\w+)\s*=\s*)?(?P<short>shortestPath\s*\()?\s*\((?P<a>\w*)\)\s*(?P<left>{_ARROW})\s*\[\s*(?P<r>\w*)\s*(?::\s*(?P<kind>\w+))?\s*(?P<star>\*\s*(?:\d*\s*\.\.)?\s*(?P<depth>\d*))?\s*\]\s*(?P<right>{_ARROW})\s*\((?P<b>\w*)\)\s*\)?"
    r"\s*(?:WHERE\s+(?P<where>.*?))?\s*(?:RETURN\s+(?P<returns>.*?))?\s*;?\s*$",
    re.I | re.S,
)
_EQUAL = re.compile(r"^\s*(\w+)\.key\s*=\s*(\$\w+|-?\d+|'[^']*')\s*$", re.I)


@dataclass(frozen=True)
class Plan:
    start: object
    end: object | None
    policy: Policy
    shortest: bool
    returns: tuple[str, ...] = ()


def parse(text: str, kinds: dict[str, int] = KINDS) -> Plan:
    m = _PATTERN.match(text)
    if not m:
        raise ValueError("the pattern cannot be read")
    arrow = max((g for g in (m["left"], m["right"])), key=lambda g: (g != "-", len(g)))  # in -[r]-> the head is on one side
    bound: dict[str, object] = {}
    for part in re.split(r"\bAND\b", m["where"] or "", flags=re.I):
        if not part.strip():
            continue
        e = _EQUAL.match(part)
        if not e:
            raise ValueError(f"only equality with a node's key is understood, not {part.strip()!r}")
        v = e[2]
        bound[e[1]] = v if v.startswith("$") else v[1:-1] if v.startswith("'") else int(v)
    if m["a"] not in bound:
        raise ValueError("the pattern needs a start: WHERE a.key = …")
    kind = None
    if m["kind"]:
        kind = kinds.get(m["kind"].upper(), int(m["kind"]) if m["kind"].isdigit() else None)
        if kind is None:
            raise ValueError(f"unknown relation kind {m['kind']}")
    depth = int(m["depth"]) if m["depth"] else (10 if m["star"] or m["short"] else 1)
    returns = tuple(x.strip() for x in (m["returns"] or "").split(",") if x.strip())
    return Plan(bound[m["a"]], bound.get(m["b"]), Policy(direction=_ARROWS[arrow], max_depth=depth, kind=kind), bool(m["short"]), returns)


class PreparedPattern:
    """A parsed pattern that runs with changing ``$parameters``."""

    def __init__(self, graph: Graph, text: str, kinds: dict[str, int] = KINDS):
        self.graph, self.plan = graph, parse(text, kinds)

    def execute(self, **params) -> DataFrame:
        value = lambda v: params[v[1:]] if isinstance(v, str) and v.startswith("$") else v
        start, end = value(self.plan.start), value(self.plan.end)
        if self.plan.shortest:
            if end is None:
                raise ValueError("a shortest path needs an end: AND b.key = …")
            return self.graph.shortest_path(start, end, self.plan.policy)
        found = self.graph.traverse(start, self.plan.policy)
        return found if end is None else found.filter(F.col("key") == F.lit(end))


def run(graph: Graph, text: str, kinds: dict[str, int] = KINDS, **params) -> DataFrame:
    return PreparedPattern(graph, text, kinds).execute(**params)


def arrow_path(graph: Graph, text: str, kinds: dict[str, int] = KINDS) -> DataFrame:
    """An arrow expression ``key |>kind|> kind2 …`` such as ``5 |>CONTAINS|> *``: (key) of the nodes at its end, each once.

    ``<|kind<|`` goes against the edges, ``<|>kind<|>`` both ways; chained joins, one a step.
    """
    parts = re.split(r"(<\|>|\|>|<\|)", text.replace(" ", ""))
    kind = dict(graph.edges.dtypes)["source_key"]
    now = graph.edges.sparkSession.createDataFrame([(int(parts[0]) if re.fullmatch(r"-?\d+", parts[0]) else parts[0],)], f"key {kind}")
    for k in range(1, len(parts) - 2, 4):
        name = parts[k + 1].upper()
        steps = graph._steps(Policy(direction=_ARROWS[parts[k]], kind=None if name in ("", "*") else kinds.get(name, int(name) if name.isdigit() else -1)))
        now = now.join(steps, F.col("key") == F.col("a")).select(F.col("b").alias("key")).distinct()
    return now

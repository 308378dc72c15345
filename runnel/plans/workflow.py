"""Workflows: steps, edges, options; loading, checking and the text notation.

A workflow is small driver-side metadata.  What runs over data is built from it
in :mod:`runnel.operators.flow`.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column


class ValidationError(ValueError):
    """A workflow that cannot run; ``problems`` lists everything found."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Edge:
    """To ``target`` when ``condition`` holds: True, False, a named condition, a Spark SQL string or a Column.

    None never fires, as an edge object without a condition does not.
    """

    target: str
    condition: bool | str | Column | None = True
    label: str | None = None
    disabled: bool = False


@dataclass(frozen=True)
class Step:
    id: str
    name: str | None = None
    edges: tuple[Edge, ...] = ()
    expression: str | None = None
    adaptors: tuple[str, ...] = ()
    configuration: str | None = None
    trigger: bool = False


@dataclass(frozen=True)
class Workflow:
    steps: tuple[Step, ...]
    start: str | None = None
    id: str | None = None
    name: str | None = None
    options: dict = field(default_factory=dict)

    def step(self, id_: str) -> Step:
        return next(s for s in self.steps if s.id == id_)

    @property
    def first(self) -> str:
        """``options.start``, else ``start``, else the first step."""
        return self.options.get("start") or self.start or self.steps[0].id

    def upstream(self, id_: str) -> str | None:
        """The first step that leads to ``id_``."""
        return next((s.id for s in self.steps if any(e.target == id_ for e in s.edges)), None)

    def only(self, id_: str) -> Workflow:
        return replace(self, options={**self.options, "start": id_, "end": id_})


def ordered_keys(keys: list[str]) -> list[str]:
    """Edge order: keys that are array indices first, ascending, then the others as written."""
    numeric = [k for k in keys if re.fullmatch(r"0|[1-9]\d*", k) and int(k) < 2**32 - 1]
    return sorted(numeric, key=int) + [k for k in keys if k not in numeric]


def edges_from(spec) -> tuple[Edge, ...]:
    """Edges from ``next``: a target, or targets with a bool, a condition or an object."""
    if spec is None:
        return ()
    if isinstance(spec, str):
        return (Edge(spec),)
    out = []
    for target in ordered_keys(list(spec)):
        e = spec[target]
        if isinstance(e, dict):
            out.append(Edge(target, e.get("condition"), e.get("label"), bool(e.get("disabled"))))
        else:
            out.append(Edge(target, e))
    return tuple(out)


ALLOWED = {"id", "name", "next", "previous", "expression", "adaptor", "adaptors", "configuration", "state", "globals", "type", "enabled", "cron_expression"}


def from_dict(spec: dict) -> Workflow:
    """From ``{workflow, options}``, a bare workflow, or the older form with ``jobs``."""
    options = dict(spec.get("options") or {})
    body = spec.get("workflow", spec)
    steps = body.get("steps", body.get("jobs"))
    if not steps:
        raise ValidationError(["a workflow needs steps"])
    out = []
    for i, s in enumerate(steps, 1):
        unknown = sorted(set(s) - ALLOWED)
        if unknown:
            raise ValidationError([f"step {s.get('id', i)}: unknown keys {', '.join(unknown)}"])
        adaptors = tuple(s.get("adaptors") or ([s["adaptor"]] if s.get("adaptor") else []))
        if adaptors and not s.get("expression"):
            raise ValidationError([f"step {s.get('id', i)}: an adaptor needs an expression"])
        out.append(
            Step(s.get("id") or f"job-{i}", s.get("name"), edges_from(s.get("next")), s.get("expression"), adaptors, s.get("configuration"), not s.get("expression"))
        )
    return Workflow(tuple(out), body.get("start") or spec.get("start"), body.get("id"), body.get("name"), options)


def load(path: str) -> Workflow:
    """A JSON plan; expressions given as ``.sql`` paths beside it are read in."""
    at = Path(path)
    spec = json.loads(at.read_text())
    for s in spec.get("workflow", spec).get("steps", []):
        if isinstance(s.get("expression"), str) and s["expression"].endswith(".sql"):
            s["expression"] = (at.parent / s["expression"]).read_text()
    return from_dict(spec)


def single(expression: str, id_: str = "job-1") -> Workflow:
    return Workflow((Step(id_, expression=expression),))


def _bracket(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; brackets nest, and quotes hide them."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i + 1
    raise ValidationError([f"no closing bracket: {text[at:]}"])


def _props(text: str) -> dict[str, str]:
    """``a=b, c=d``; commas inside brackets and quotes do not part."""
    parts, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "(":
            i = _bracket(text, i)
            continue
        if text[i] in "'\"":
            i = text.find(text[i], i + 1)
            if i < 0:
                raise ValidationError([f"no closing quote: {text}"])
        elif text[i] == ",":
            parts.append(text[start:i])
            start = i + 1
        i += 1
    pairs = [p.partition("=") for p in [*parts, text[start:]] if p.strip()]
    if any(not eq for _, eq, _ in pairs):
        raise ValidationError([f"not a property: {text}"])
    return {k.strip(): v.strip() for k, _, v in pairs}


def parse(text: str) -> Workflow:
    """The text notation: ``a-b b-c a-(condition=on_job_failure)-d``, steps with properties ``a(name=x)``, lines ``@name x`` for the workflow, ``# comments``."""
    edges: dict[str, list[Edge]] = {}
    about: dict[str, str] = {}
    props: dict[str, dict] = {}
    for line in text.splitlines():
        line = line.strip()
        if m := re.fullmatch(r"@(\w+)\s+(.*)", line):
            about[m[1]] = m[2]
            continue
        at = 0

        def step() -> str:
            nonlocal at
            m = re.compile(r"\w+").match(line, at)
            if not m:
                raise ValidationError([f"a step's name is missing: {line[at:]}"])
            at = m.end()
            edges.setdefault(m[0], [])
            if line[at : at + 1] == "(":
                end = _bracket(line, at)
                props.setdefault(m[0], {}).update(_props(line[at + 1 : end - 1]))
                at = end
            return m[0]

        while at < len(line):
            if line[at].isspace():
                at += 1
                continue
            if line[at] == "#":
                break
            a = step()
            while line[at : at + 1] == "-":
                at, p = at + 1, {}
                if line[at : at + 1] == "(":
                    end = _bracket(line, at)
                    p, at = _props(line[at + 1 : end - 1]), end
                    if line[at : at + 1] != "-":
                        raise ValidationError([f"an edge leads nowhere: {line}"])
                    at += 1
                b = step()
                c = p.get("condition", "true")
                edges[a].append(Edge(b, {"true": True, "false": False}.get(c, c), p.get("label"), p.get("disabled") == "true"))
                a = b
            if at < len(line) and not line[at].isspace() and line[at] != "#":
                raise ValidationError([f"not understood: {line[at:]}"])
    known = {"name", "expression", "configuration"}
    for k, v in props.items():
        if unknown := sorted(set(v) - known - {"adaptor"}):
            raise ValidationError([f"step {k}: unknown keys {', '.join(unknown)}"])
    steps = [Step(k, edges=tuple(v), adaptors=tuple([props[k]["adaptor"]] if "adaptor" in props.get(k, {}) else []), **{n: x for n, x in props.get(k, {}).items() if n in known}) for k, v in edges.items()]
    return Workflow(tuple(steps), about.get("start"), about.get("id"), about.get("name"))


def from_wire(plan: dict) -> Workflow:
    """From a run as a queue hands it over: ``triggers``, ``jobs`` and ``edges`` between them.

    Edges name their ends by ``source_trigger_id`` or ``source_job_id`` and
    ``target_job_id``; a missing condition is always true, a named one stays as it
    is, and edges that are not enabled are kept as disabled.  A plan without a
    starting node starts at its first trigger.
    """
    nodes = [(t["id"], True, t) for t in plan.get("triggers") or []] + [(j["id"], False, j) for j in plan.get("jobs") or []]
    out: dict[str, list[Edge]] = {id_: [] for id_, _, _ in nodes}
    for e in plan.get("edges") or []:
        source = e.get("source_trigger_id") or e.get("source_job_id")
        if source not in out or e.get("target_job_id") not in out:
            raise ValidationError([f"edge {e.get('id')} has an end that does not exist"])
        c = e.get("condition", "always")
        out[source].append(Edge(e["target_job_id"], {"always": True, "never": False}.get(c, c), e.get("label"), e.get("enabled") is False))
    steps = [
        Step(id_, x.get("name"), tuple(out[id_]), None if trigger else x.get("body"), tuple([x["adaptor"]] if x.get("adaptor") else []), x.get("credential_id"), trigger)
        for id_, trigger, x in nodes
    ]
    if not steps:
        raise ValidationError(["a workflow needs steps"])
    options = {k: v for k, v in (plan.get("options") or {}).items()}
    return Workflow(tuple(steps), plan.get("starting_node_id"), plan.get("id"), plan.get("name"), options)


def validate(w: Workflow) -> list[str]:
    """Step ids in an order in which every step follows all that lead to it; raises with all problems at once."""
    ids = [s.id for s in w.steps]
    problems = [f"duplicate step {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    problems += [f"start step {w.first} does not exist"] if w.first not in ids else []
    end = w.options.get("end")
    problems += [f"end step {end} does not exist"] if end and end not in ids else []
    problems += [f"step {s.id} leads to {e.target}, which does not exist" for s in w.steps for e in s.edges if e.target not in ids]
    order, left = [], {s.id: sum(e.target == s.id for u in w.steps for e in u.edges) for s in w.steps}
    ready = [i for i in ids if not left[i]]
    while ready and not problems:
        i = ready.pop(0)
        order.append(i)
        for e in w.step(i).edges:
            left[e.target] -= 1
            if not left[e.target]:
                ready.append(e.target)
    if not problems and len(order) < len(ids):
        problems.append(f"a cycle through {', '.join(i for i in ids if i not in order)}")
    if problems:
        raise ValidationError(problems)
    return order


def match_step(w: Workflow, text: str) -> str:
    """A step by its exact id, else by the only id or name that contains ``text``."""
    if any(s.id == text for s in w.steps):
        return text
    found = [s.id for s in w.steps if text in s.id or text in (s.name or "")]
    if len(found) != 1:
        raise LookupError(f"{'ambiguous' if found else 'no'} step: {text}")
    return found[0]


def with_adaptors(w: Workflow, override: dict[str, str]) -> Workflow:
    """Adaptor names replaced by ``override``, others as they are."""
    return replace(w, steps=tuple(replace(s, adaptors=tuple(override.get(a, a) for a in s.adaptors)) for s in w.steps))

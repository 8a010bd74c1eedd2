"""Logical models with levels (qualitative SBML, GINML, BooleanNet), as automata networks and some of them back."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from itertools import product

from ..model import Move, Network
from .text import FormatError, clauses, evaluate, parse_boolean, variables

QUAL = "http://www.sbml.org/sbml/level3/version1/qual/version1"
CORE = "http://www.sbml.org/sbml/level3/version1/core"
MATH = "http://www.w3.org/1998/Math/MathML"
#: Rows of a truth table that one function may have.
LARGEST_TABLE = 1 << 16

_COMPARE = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "geq": lambda a, b: a >= b, "gt": lambda a, b: a > b, "leq": lambda a, b: a <= b, "lt": lambda a, b: a < b}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _get(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _value(e: ET.Element, state: dict[str, int]):
    """Value of a MathML expression in a state."""
    kind = _tag(e)
    if kind == "math":
        return _value(e[0], state)
    if kind == "ci":
        return state[(e.text or "").strip()]
    if kind == "cn":
        return float((e.text or "").strip())
    if kind in ("true", "false"):
        return kind == "true"
    if kind == "apply":
        op, args = _tag(e[0]), e[1:]
        if op == "not":
            return not _value(args[0], state)
        if op in ("and", "or"):
            return (all if op == "and" else any)(_value(x, state) for x in args)
        if op == "xor":
            return sum(bool(_value(x, state)) for x in args) % 2 == 1
        if op in _COMPARE:
            return _COMPARE[op](*(_value(x, state) for x in args))
    raise FormatError(f"not understood in a formula: {kind}")


def unit_moves(name: str, levels: dict[str, int], regulators: list[str], target) -> list[Move]:
    """Moves of one level towards target(state), with disjoint guards over the regulators, from each own level apart."""
    names = [r for r in regulators if r != name]
    rows = 1
    for r in names:
        rows *= levels[r]
    if rows > LARGEST_TABLE:
        raise FormatError(f"{name}: a table of {rows} rows")
    out = []
    for own in range(levels[name]):
        table = {bits: target({**dict(zip(names, bits)), name: own}) for bits in product(*(range(levels[r]) for r in names))}

        def paths(prefix: tuple[int, ...], rest: list[tuple[int, ...]]):
            """(prefix, step) of the largest blocks that all step the same way."""
            steps = {(table[b] > own) - (table[b] < own) for b in rest}
            if len(steps) == 1:
                yield prefix, steps.pop()
                return
            at = len(prefix)
            for k in range(levels[names[at]]):
                yield from paths((*prefix, k), [b for b in rest if b[at] == k])

        for prefix, step in paths((), list(table)):
            if step:
                out.append(Move(name, own, own + step, tuple(sorted(zip(names, prefix)))))
    return out


def read_sbml(text: str, name: str = "model") -> Network:
    """Species are automata; a transition's terms give its outputs' target levels, the first that holds."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise FormatError(str(e)) from None
    levels, initial, functions = {}, {}, {}
    for e in root.iter():
        if _tag(e) == "qualitativeSpecies":
            species = _get(e, "id") or _get(e, "name")
            levels[species] = int(_get(e, "maxLevel") or 1) + 1
            if (start := _get(e, "initialLevel")) is not None:
                initial[species] = frozenset((int(start),))
    if not levels:
        raise FormatError("no qualitative species")
    for e in root.iter():
        if _tag(e) != "transition":
            continue
        terms, default = [], 0
        for t in e.iter():
            if _tag(t) == "defaultTerm":
                default = int(_get(t, "resultLevel") or 0)
            elif _tag(t) == "functionTerm":
                terms.append((int(_get(t, "resultLevel") or 0), next(x for x in t if _tag(x) == "math")))
        regulators = sorted({(x.text or "").strip() for _, m in terms for x in m.iter() if _tag(x) == "ci"} & levels.keys())
        for output in (x for x in e.iter() if _tag(x) == "output"):
            functions[_get(output, "qualitativeSpecies")] = (terms, default, regulators)
    moves = {a: [] for a in levels}
    for a, (terms, default, regulators) in functions.items():
        if a in levels:
            moves[a] = unit_moves(a, levels, regulators, lambda s, t=terms, d=default: next((k for k, m in t if _value(m, s)), d))
    return Network(name, levels, moves, initial or None, "sbml")


def write_sbml(net: Network) -> str:
    """Boolean networks only: a node's rising guards are its function, as in the BoolNet writer."""
    if many := [a for a in net.automata if net.levels[a] != 2]:
        raise ValueError(f"not Boolean: {', '.join(many)}")
    for prefix, uri in (("", CORE), ("qual", QUAL), ("math", MATH)):
        ET.register_namespace(prefix, uri)
    q = lambda x: f"{{{QUAL}}}{x}"
    root = ET.Element(f"{{{CORE}}}sbml", {"level": "3", "version": "1", q("required"): "true"})
    model = ET.SubElement(root, f"{{{CORE}}}model", {"id": "model"})
    species = ET.SubElement(model, q("listOfQualitativeSpecies"))
    transitions = ET.SubElement(model, q("listOfTransitions"))
    for a in net.automata:
        start = (net.initial or {}).get(a, frozenset())
        ET.SubElement(species, q("qualitativeSpecies"), {q("id"): a, q("compartment"): "c", q("constant"): "false", q("maxLevel"): "1", **({q("initialLevel"): str(min(start))} if len(start) == 1 else {})})
        own = net.moves.get(a, [])
        if not own:
            continue
        ups = [m.conditions for m in own if (m.source, m.target) == (0, 1)]
        t = ET.SubElement(transitions, q("transition"), {q("id"): f"tr_{a}"})
        inputs = ET.SubElement(t, q("listOfInputs"))
        for b in sorted({b for c in ups for b, _ in c}):
            ET.SubElement(inputs, q("input"), {q("qualitativeSpecies"): b, q("transitionEffect"): "none"})
        ET.SubElement(ET.SubElement(t, q("listOfOutputs")), q("output"), {q("qualitativeSpecies"): a, q("transitionEffect"): "assignmentLevel"})
        terms = ET.SubElement(t, q("listOfFunctionTerms"))
        ET.SubElement(terms, q("defaultTerm"), {q("resultLevel"): "0"})
        if ups:
            math = ET.SubElement(ET.SubElement(terms, q("functionTerm"), {q("resultLevel"): "1"}), f"{{{MATH}}}math")
            either = _join(math, "or", len(ups))
            for c in ups:
                both = _join(either, "and", len(c))
                if not c:
                    ET.SubElement(either, f"{{{MATH}}}true")
                for b, k in c:
                    eq = ET.SubElement(both, f"{{{MATH}}}apply")
                    ET.SubElement(eq, f"{{{MATH}}}eq")
                    ET.SubElement(eq, f"{{{MATH}}}ci").text = b
                    ET.SubElement(eq, f"{{{MATH}}}cn", {"type": "integer"}).text = str(k)
    return ET.tostring(root, encoding="unicode")


def _join(parent: ET.Element, op: str, n: int) -> ET.Element:
    if n < 2:
        return parent
    out = ET.SubElement(parent, f"{{{MATH}}}apply")
    ET.SubElement(out, f"{{{MATH}}}{op}")
    return out


def read_booleannet(text: str, name: str = "model") -> Network:
    """'target* = expression' lines, and 'target = True' lines for starts."""
    functions, initial = {}, {}
    for line in (x.partition("#")[0].strip() for x in text.splitlines()):
        left, eq, right = (x.strip() for x in line.partition("="))
        if not eq:
            continue
        left = left.rpartition(":")[2].strip()
        if left.endswith("*"):
            functions[left[:-1].strip()] = right
        elif right.lower() in ("true", "false"):
            initial[left] = frozenset((int(right.lower() == "true"),))
    if not functions:
        raise FormatError("no update rule")
    levels = dict.fromkeys([*functions, *initial], 2)
    moves = {a: [] for a in levels}
    for a, f in functions.items():
        tree = parse_boolean(f)
        held = clauses(tree)
        names = sorted({b for c in [*held, *clauses(tree, False)] for b in c})
        for b in names:
            levels.setdefault(b, 2)
            moves.setdefault(b, [])
        moves[a] = unit_moves(a, levels, names, lambda s, h=held: int(any(all(s[b] == k for b, k in c.items()) for c in h)))
    return Network(name, levels, moves, initial or None, "booleannet")


def read_ginml(text: str, name: str = "model") -> Network:
    """Nodes with levels; a node's target is given by logical parameters, sets of active incoming edges, or by
    expressions for values, in which A is A at 1 or more and A:2 is A at 2 or more. Else the base value, or 0."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    except ET.ParseError as e:
        raise FormatError(str(e)) from None
    nodes = [e for e in root.iter() if _tag(e) == "node"]
    if not nodes:
        raise FormatError("no node")
    levels = {e.get("id"): int(e.get("maxvalue") or 1) + 1 for e in nodes}
    edges: dict[str, list[tuple[str, str, int, int]]] = {}
    for e in root.iter():
        if _tag(e) == "edge":
            source = e.get("from")
            high = int(e.get("maxvalue")) if (e.get("maxvalue") or "-1").isdigit() else levels[source] - 1
            edges.setdefault(e.get("to"), []).append((e.get("id"), source, int(e.get("minvalue") or 1), high))
    moves: dict[str, list[Move]] = {a: [] for a in levels}
    for e in nodes:
        a = e.get("id")
        if (e.get("input") or "").lower() == "true":
            continue
        own = edges.get(a, [])
        parameters = {frozenset((p.get("idActiveInteractions") or "").split()): int(p.get("val") or 0) for p in e.iter() if _tag(p) == "parameter"}
        expressions = [(int(v.get("val") or 0), parse_boolean(re.sub(r"(\w+):(\d+)", r"\1.\2", x.get("str") or "0"))) for v in e.iter() if _tag(v) == "value" for x in v.iter() if _tag(x) == "exp"]

        def target(state: dict[str, int], own=own, parameters=parameters, expressions=expressions, base=int(e.get("basevalue") or 0)) -> int:
            for value, tree in expressions:
                held = {v: int(state.get(v.partition(".")[0], 0) >= int(v.partition(".")[2] or 1)) for v in variables(tree)}
                if evaluate(tree, held):
                    return value
            active = frozenset(i for i, source, low, high in own if low <= state[source] <= high)
            return parameters.get(active, base if not expressions else 0)

        names = {source for _, source, _, _ in own} | {v.partition(".")[0] for _, t in expressions for v in variables(t)}
        moves[a] = unit_moves(a, levels, sorted(names & levels.keys()), target)
    return Network(name, levels, moves, None, "ginml")


def read_zginml(data: bytes, name: str = "model") -> Network:
    """The regulatory graph in a zipped GINML file: its first member of that ending."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = next((x for x in z.namelist() if x.lower().endswith(".ginml")), None)
            if inside is None:
                raise FormatError("no .ginml file in the archive")
            return read_ginml(z.read(inside).decode("utf-8", "replace"), name)
    except zipfile.BadZipFile as e:
        raise FormatError(str(e)) from None


def _atom(net: Network, b: str, k: int, at: str) -> str:
    """b=k in terms of 'b is at this level or more'."""
    low = "" if k == 0 else b if k == 1 else f"{b}{at}{k}"
    high = "" if k + 1 >= net.levels.get(b, 2) else f"!{b}" if k == 0 else f"!{b}{at}{k + 1}"
    return " & ".join(x for x in (low, high) if x)


def _rises(net: Network, a: str, level: int, at: str) -> str | None:
    """Where a goes up to the level or past it, as an expression; None: never."""
    found = []
    for m in net.moves.get(a, ()):
        if m.source < level <= m.target:
            atoms = [x for b, k in m.conditions if b != a for x in (_atom(net, b, k, at),) if x]
            found.append("(" + " & ".join(atoms) + ")" if atoms else "1")
    return " | ".join(dict.fromkeys(found)) or None


def write_ginml(net: Network) -> str:
    """Nodes with their largest levels, edges from regulators, and for each level the expression of the moves that rise
    to it. Moves that fall are where no such expression holds, so a network whose moves do not follow a function does
    not come back as it is; rates and starts are left out."""
    graph = ET.Element("gxl")
    own = ET.SubElement(graph, "graph", {"class": "regulatory", "id": net.name or "model", "nodeorder": " ".join(net.automata)})
    for a in net.automata:
        node = ET.SubElement(own, "node", {"id": a, "maxvalue": str(net.levels[a] - 1)})
        if not net.moves.get(a):
            node.set("input", "true")
        for level in range(net.levels[a] - 1, 0, -1):
            if text := _rises(net, a, level, ":"):
                ET.SubElement(ET.SubElement(node, "value", {"val": str(level)}), "exp", {"str": text})
    for a in net.automata:
        for b in sorted(net.regulators(a) & net.levels.keys()):
            ET.SubElement(own, "edge", {"id": f"{b}:{a}", "from": b, "to": a, "minvalue": "1"})
    return "<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(graph, encoding="unicode") + "\n"


def write_booleannet(net: Network) -> str:
    """Starts and update rules of a Boolean network; a node without moves keeps its value."""
    if many := [a for a in net.automata if net.levels[a] != 2]:
        raise ValueError(f"not Boolean: {', '.join(many)}")
    words = lambda t: t.replace("!", "not ").replace("&", "and").replace("|", "or")
    out = [f"{a} = {bool(k)}" for a, x in sorted((net.initial or {}).items()) if len(x) == 1 for k in x]
    for a in net.automata:
        rule = a if not net.moves.get(a) else _rises(net, a, 1, "") or "0"
        out.append(f"{a}* = {words(rule)}")
    return "\n".join([*out, ""])

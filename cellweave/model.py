"""Asynchronous automata networks: what a model is, before and after it becomes rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Law:
    """A delay law as its phases' rates: one is exponential; k equal ones given as such are an Erlang law."""

    rates: tuple[float, ...] = (1.0,)
    kind: str = "exp"

    @staticmethod
    def exp(rate: float) -> Law:
        return Law((float(rate),))

    @staticmethod
    def erlang(k: int, rate: float) -> Law:
        return Law((float(rate),) * k, "erlang")

    @staticmethod
    def phase(rates) -> Law:
        return Law(tuple(map(float, rates)), "phase")

    @property
    def mean(self) -> float:
        return sum(1 / r if r else float("inf") for r in self.rates)

    @property
    def rate(self) -> float:
        return self.rates[0] if self.kind == "exp" else (1 / self.mean if self.rates else 0.0)

    def text(self) -> str:
        if self.kind == "exp":
            return repr(self.rates[0])
        if self.kind == "erlang":
            return f"erlang({len(self.rates)}, {self.rates[0] if self.rates else 0.0!r})"
        return f"phase({', '.join(map(repr, self.rates))})"


@dataclass(frozen=True)
class Move:
    """A guarded local transition. conditions: (automaton, level), all to hold."""

    automaton: str
    source: int
    target: int
    conditions: tuple[tuple[str, int], ...] = ()
    law: Law = Law()

    def text(self) -> str:
        when = " when " + " and ".join(f"{a}={k}" for a, k in self.conditions) if self.conditions else ""
        return f"{self.automaton}: {self.source} -> {self.target}{when}"


Goal = tuple[str, int]
Context = dict[str, frozenset[int]]


def parse_goal(text: str) -> Goal:
    """'a=3'; a whole number is no name."""
    name, eq, level = (x.strip() for x in text.partition("="))
    if not eq or not name or name.lstrip("-").isdigit() or not level.isdigit():
        raise ValueError(f"not a local state: {text!r}")
    return name, int(level)


def parse_context(text: str | None) -> Context | None:
    """'a=0,b=1', levels of a repeated automaton together; 'default' or nothing is no constraint."""
    if not text or text.strip() in ("", "default"):
        return None
    out: dict[str, set[int]] = {}
    for atom in text.split(","):
        if atom.strip():
            name, level = parse_goal(atom)
            out.setdefault(name, set()).add(level)
    return {a: frozenset(x) for a, x in out.items()}


@dataclass
class Network:
    """levels: number of levels of each automaton. Order everywhere: automata by name, moves as declared."""

    name: str
    levels: dict[str, int]
    moves: dict[str, list[Move]] = field(default_factory=dict)
    initial: Context | None = None
    source: str | None = None

    @property
    def automata(self) -> list[str]:
        return sorted(self.levels)

    @property
    def transitions(self) -> list[Move]:
        return [m for a in self.automata for m in self.moves.get(a, ())]

    def admitted(self, context: Context | None, a: str) -> list[int]:
        """Levels at which automaton a may start."""
        own = (context or {}).get(a)
        return sorted(own) if own is not None else list(range(self.levels[a]))

    def regulators(self, a: str) -> set[str]:
        return {b for m in self.moves.get(a, ()) for b, _ in m.conditions if b != a}

    def cone(self, a: str) -> set[str]:
        """The automata that a depends on, itself included."""
        seen, todo = set(), [a]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [c for c in self.regulators(b) if c in self.levels]
        return seen

    def keep(self, names: set[str], drop_conditions: bool = False) -> Network:
        """The automata of names; moves with a condition elsewhere go, or with drop_conditions lose that condition."""
        moves = {}
        for a in names & self.levels.keys():
            own = self.moves.get(a, [])
            if drop_conditions:
                moves[a] = [replace(m, conditions=tuple(c for c in m.conditions if c[0] in names)) for m in own]
            else:
                moves[a] = [m for m in own if all(c in names for c, _ in m.conditions)]
        start = None if self.initial is None else {a: x for a, x in self.initial.items() if a in names}
        return Network(self.name, {a: n for a, n in self.levels.items() if a in names}, moves, start, self.source)

    def frozen(self, a: str, level: int) -> Network:
        """The mutant whose automaton a stays at a level."""
        return Network(self.name, self.levels, {**self.moves, a: []}, {**(self.initial or {}), a: frozenset((level,))}, self.source)

    def expanded(self) -> Network:
        """Laws of several phases as chains of exponential moves over new levels; the first step keeps the guard."""
        if all(len(m.law.rates) <= 1 for m in self.transitions):
            return self
        levels, moves = dict(self.levels), {}
        for a in self.automata:
            moves[a] = []
            for m in self.moves.get(a, ()):
                stops = [m.source, *range(levels[a], levels[a] + len(m.law.rates) - 1), m.target]
                levels[a] += len(stops) - 2
                for i, r in enumerate(m.law.rates):
                    moves[a].append(Move(a, stops[i], stops[i + 1], m.conditions if i == 0 else (), Law.exp(r)))
        return Network(self.name, levels, moves, self.initial, self.source)

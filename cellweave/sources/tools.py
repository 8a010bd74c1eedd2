"""External model checkers, where they are installed: text in, answer out."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from ..model import Goal, Network
from .text import read_nusmv_result, read_probtraj, read_storm_result, write_nusmv, write_prism


class ToolMissing(RuntimeError):
    """The program is not on the path."""


def detect(program: str) -> str | None:
    return shutil.which(program)


def run(program: str, *args: str, timeout: float = 120.0) -> str:
    """Standard output of the program; both streams are read together, so neither blocks the other."""
    if detect(program) is None:
        raise ToolMissing(program)
    return subprocess.run([program, *args], capture_output=True, text=True, timeout=timeout, check=False).stdout


def _with_file(text: str, ending: str, call):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "model" + ending)
        with open(path, "w") as f:
            f.write(text)
        return call(path)


def nusmv_reachable(net: Network, goal: Goal, program: str = "NuSMV") -> bool | None:
    return _with_file(write_nusmv(net, goal), ".smv", lambda p: read_nusmv_result(run(program, p)))


def storm_probability(net: Network, goal: Goal, program: str = "storm") -> float | None:
    return _with_file(write_prism(net, goal), ".sm", lambda p: read_storm_result(run(program, "--prism", p, "--prop", f"P=? [ F {goal[0]}={goal[1]} ]")))


def storm_time(net: Network, goal: Goal, program: str = "storm") -> float | None:
    return _with_file(write_prism(net), ".sm", lambda p: read_storm_result(run(program, "--prism", p, "--prop", f'R{{"time"}}=? [ F {goal[0]}={goal[1]} ]')))


def maboss_series(bnd: str, cfg: str, samples: int | None = None, max_time: float | None = None, program: str = "MaBoSS") -> list[tuple[float, dict[str, float]]]:
    """By time, the chance of each node to be active, as the simulator has it. samples and max_time go before what the
    parameters say, in a second file of parameters."""
    more = "".join(f"{k} = {v};\n" for k, v in (("sample_count", samples), ("max_time", max_time)) if v is not None)
    with tempfile.TemporaryDirectory() as folder:
        at = lambda name: os.path.join(folder, name)
        for name, text in (("model.bnd", bnd), ("model.cfg", cfg), ("more.cfg", more)):
            with open(at(name), "w") as f:
                f.write(text)
        run(program, "-c", at("model.cfg"), *(["-c", at("more.cfg")] if more else []), "-o", at("out"), at("model.bnd"))
        found = sorted((x for x in os.listdir(folder) if x.startswith("out") and "probtraj" in x), key=len)
        if not found:
            raise FileNotFoundError("the simulator wrote no trajectory")
        with open(at(found[0])) as f:
            rows = read_probtraj(f.read())
    series: dict[float, dict[str, float]] = {}
    for time, active, p, _ in rows:
        own = series.setdefault(time, {})
        for node in active:
            own[node] = own.get(node, 0.0) + p
    return sorted(series.items())

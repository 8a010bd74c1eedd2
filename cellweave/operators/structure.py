"""Questions about a network's structure, for all models at once: joins and aggregations over the model frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semirings import SEMIRINGS
from ..plans.frames import Models
from ..plans.staging import cut
from . import kernels


def info(models: Models) -> DataFrame:
    """Sizes: automata, local states, transitions, automata of more than two levels."""
    a = models.automata.groupBy("model_id").agg(F.count(F.lit(1)).alias("automata"), F.sum("levels").alias("local_states"), F.count_if(F.col("levels") > 2).alias("multivalued"))
    t = models.transitions.groupBy("model_id").agg(F.count(F.lit(1)).alias("transitions"))
    return a.join(t, "model_id", "left").select("model_id", "automata", "local_states", F.coalesce("transitions", F.lit(0)).alias("transitions"), "multivalued")


def _atoms(models: Models) -> DataFrame:
    t = models.transitions
    return t.select("model_id", "tid", "automaton", "from_level", "to_level", F.explode("conditions").alias("c")).select("model_id", "tid", "automaton", "from_level", "to_level", F.col("c.automaton").alias("regulator"), F.col("c.level").alias("level"))


def regulators(models: Models) -> DataFrame:
    """(model_id, regulator, automaton): who stands in whose conditions, itself excepted."""
    return _atoms(models).where("regulator <> automaton").select("model_id", "regulator", "automaton").distinct()


def influences(models: Models) -> DataFrame:
    """(model_id, src, dst, sign): 1 where a high regulator raises or a low one lowers, -1 the other way, 0 both."""
    levels = models.automata.select("model_id", F.col("automaton").alias("regulator"), "levels")
    a = _atoms(models).where("regulator <> automaton").join(levels, ["model_id", "regulator"], "left")
    high = F.col("level") >= F.coalesce("levels", F.lit(0)) / 2
    effect = F.when((F.col("to_level") >= F.col("from_level")) == high, 1).otherwise(-1)
    return a.groupBy("model_id", F.col("regulator").alias("src"), F.col("automaton").alias("dst")).agg(F.when(F.min(effect) == F.max(effect), F.min(effect)).otherwise(0).alias("sign"))


def closure(edges: DataFrame, seeds: DataFrame, key: list[str], max_rounds: int = 10_000) -> DataFrame:
    """(key, node) reachable from the seeds along edges (key, src, dst), seeds included: semi-naive rounds.

    Each round joins only what the last one found, drops what is known by an anti-join, and is written, so that plans
    do not grow. Rounds are as many as the longest shortest path.
    """
    known = cut(seeds.select(*key, "node").distinct())
    front = known
    for _ in range(max_rounds):
        step = front.join(edges, [*(front[k] == edges[k] for k in _shared(front, edges, key)), front["node"] == edges["src"]]).select(*(front[k] for k in key), edges["dst"].alias("node")).distinct()
        front = cut(step.join(known, [*key, "node"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.union(front)
    raise RuntimeError("closure did not end")


def _shared(a: DataFrame, b: DataFrame, key: list[str]) -> list[str]:
    return [k for k in key if k in a.columns and k in b.columns]


def cones(models: Models, goals: DataFrame) -> DataFrame:
    """(query_id, model_id, node) for goals (query_id, model_id, automaton): what each goal's automaton depends on."""
    back = regulators(models).join(models.automata.select("model_id", F.col("automaton").alias("regulator")), ["model_id", "regulator"]).select("model_id", F.col("automaton").alias("src"), F.col("regulator").alias("dst"))
    return closure(cut(back), goals.select("query_id", "model_id", F.col("automaton").alias("node")), ["query_id", "model_id"])


def restrict(models: Models, keep: DataFrame, drop_conditions: bool = False) -> Models:
    """The models without automata that are not in keep (model_id, automaton). Moves with a condition elsewhere go, or
    with drop_conditions lose that condition."""
    keep = keep.select("model_id", "automaton").distinct()
    t = models.transitions.join(keep, ["model_id", "automaton"], "left_semi")
    held = keep.groupBy("model_id").agg(F.collect_set("automaton").alias("_held"))
    t = t.join(held, "model_id")
    inside = F.filter("conditions", lambda c: F.array_contains("_held", c["automaton"]))
    t = t.withColumn("conditions", inside) if drop_conditions else t.where(F.size(inside) == F.size("conditions"))
    semi = lambda df: df.join(keep, ["model_id", "automaton"], "left_semi")
    return Models(semi(models.automata), t.drop("_held"), semi(models.initial), models.models)


def transition_texts(models: Models) -> DataFrame:
    when = F.array_join(F.transform("conditions", lambda c: F.concat_ws("=", c["automaton"], c["level"].cast("string"))), " and ")
    text = F.concat(F.col("automaton"), F.lit(": "), F.col("from_level").cast("string"), F.lit(" -> "), F.col("to_level").cast("string"), F.when(F.size("conditions") > 0, F.concat(F.lit(" when "), when)).otherwise(""))
    return models.transitions.select("model_id", "tid", "automaton", text.alias("text"))


def components(edges: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, comp, nodes) of the strongly connected components of more than one node or with a loop, per graph.

    edges: (key, src, dst). One task a graph, whose size is a model's; comp is the smallest node.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in sorted(zip(own["src"], own["dst"])):
            after.setdefault(a, []).append(b)
        nodes = sorted({*own["src"], *own["dst"]})
        found = [sorted(c) for c in kernels.components(nodes, lambda v: after.get(v, ())) if len(c) > 1 or c[0] in after.get(c[0], ())]
        return pd.DataFrame([(own[key].iloc[0], c[0], ",".join(c)) for c in sorted(found)], columns=[key, "comp", "nodes"])

    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(run, f"{key} string, comp string, nodes string")


def circuits(signed: DataFrame, key: str = "model_id", max_steps: int = 5_000_000) -> DataFrame:
    """(key, nodes, sign, truncated): elementary cycles, from their smallest node; sign is the product of the edges'
    signs.

    Cycles over one set of nodes with one sign count once. signed: (key, src, dst, sign). One task a graph. Cycles may
    be exponentially many: after max_steps edges the search of a graph ends, and all its rows say truncated (one row
    without nodes where it had found none).
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[tuple[str, int]]] = {}
        for a, b, s in sorted(zip(own["src"], own["dst"], own["sign"])):
            after.setdefault(a, []).append((b, int(s)))
        found: dict[tuple, None] = {}
        steps = 0
        for start in sorted(after):
            stack = [(start, (start,), 1)]
            while stack and steps < max_steps:
                at, path, sign = stack.pop()
                for b, s in after.get(at, ()):
                    steps += 1
                    if b == start:
                        found[",".join(sorted(path)), sign * s] = None
                    elif b > start and b not in path:
                        stack.append((b, (*path, b), sign * s))
        cut_off = steps >= max_steps
        rows = [(own[key].iloc[0], nodes, sign, cut_off) for nodes, sign in sorted(found)] or ([(own[key].iloc[0], None, None, True)] if cut_off else [])
        return pd.DataFrame(rows, columns=[key, "nodes", "sign", "truncated"])

    return signed.select(key, "src", "dst", "sign").groupBy(key).applyInPandas(run, f"{key} string, nodes string, sign int, truncated boolean")


def feedback(circuits: DataFrame) -> DataFrame:
    """(model_id, total, positive, negative, truncated)"""
    return circuits.groupBy("model_id").agg(F.count("nodes").alias("total"), F.count_if(F.col("sign") == 1).alias("positive"), F.count_if(F.col("sign") == -1).alias("negative"), F.bool_or("truncated").alias("truncated"))


def stats(models: Models) -> DataFrame:
    """info, with edges, density, largest in- and out-degree, and the number of feedback components."""
    inf = influences(models)
    edges = inf.groupBy("model_id").agg(F.count(F.lit(1)).alias("edges"))
    degree = lambda col: inf.groupBy("model_id", col).agg(F.count(F.lit(1)).alias("n")).groupBy("model_id").agg(F.max("n").alias(f"max_{'in' if col == 'dst' else 'out'}_degree"))
    loops = components(inf).groupBy("model_id").agg(F.count(F.lit(1)).alias("feedback_components"))
    out = info(models).drop("multivalued")
    for part in (edges, degree("dst"), degree("src"), loops):
        out = out.join(part, "model_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("edges", "max_in_degree", "max_out_degree", "feedback_components")}
    n = F.col("automata")
    density = F.coalesce("edges", F.lit(0)) / F.when(n > 1, n * (n - 1)).otherwise(1)
    return out.select("model_id", "automata", "local_states", "transitions", zero["edges"], density.alias("density"), zero["max_in_degree"], zero["max_out_degree"], zero["feedback_components"])


def diff_pairs(models: Models, pairs: DataFrame) -> DataFrame:
    """(pair, change, item) for pairs (pair, l, r) of model ids: automata on one side, changed numbers of levels,
    transitions on one side. Rates do not count, nor do repeated transitions."""

    def side(df: DataFrame, which: str) -> DataFrame:
        return df.join(pairs.select("pair", F.col(which).alias("model_id")), "model_id")

    a = side(models.automata, "l").select("pair", "automaton", F.col("levels").alias("before"))
    b = side(models.automata, "r").select("pair", "automaton", F.col("levels").alias("after"))
    both = a.join(b, ["pair", "automaton"], "full_outer")
    texts = transition_texts(models).select("model_id", "text").distinct()
    lt, rt = (side(texts, which).select("pair", F.col("text").alias("item")) for which in ("l", "r"))
    one = lambda x, y, change: x.join(y, ["pair", "item"], "left_anti").select("pair", F.lit(change).alias("change"), "item")
    return (
        both.where("after IS NULL").select("pair", F.lit("only_left").alias("change"), F.col("automaton").alias("item"))
        .union(both.where("before IS NULL").select("pair", F.lit("only_right"), "automaton"))
        .union(both.where("before <> after").select("pair", F.lit("levels"), F.format_string("%s: %d -> %d", "automaton", "before", "after")))
        .union(one(rt, lt, "added"))
        .union(one(lt, rt, "removed"))
    )


def diff(left: Models, right: Models) -> DataFrame:
    """(change, item) of two frames of one model each; as diff_pairs()."""
    own = lambda df, name: df.withColumn("model_id", F.lit(name))
    both = Models(*(own(getattr(left, x), "left").unionByName(own(getattr(right, x), "right")) for x in ("automata", "transitions", "initial", "models")))
    pair = both.models.sparkSession.createDataFrame([(0, "left", "right")], "pair int, l string, r string")
    return diff_pairs(both, pair).drop("pair")


def validate(models: Models) -> DataFrame:
    """(model_id, severity, message): errors make a model unusable, warnings do not."""
    a, t = models.automata, models.transitions
    own = t.join(a.select("model_id", "automaton", "levels"), ["model_id", "automaton"], "left")
    text = transition_texts(models).select("model_id", "tid", "text")
    own = own.join(text, ["model_id", "tid"])
    atoms = _atoms(models).join(a.select("model_id", F.col("automaton").alias("regulator"), "levels"), ["model_id", "regulator"], "left").join(text, ["model_id", "tid"])
    row = lambda df, sev, *msg: df.select("model_id", F.lit(sev).alias("severity"), F.concat(*(F.lit(m) if isinstance(m, str) else m for m in msg)).alias("message"))
    T, R = F.col("text"), F.col("regulator")
    rates = F.col("dist.rates")
    checks = [
        row(a.where("levels < 1"), "error", F.col("automaton"), ": no level"),
        row(own.where("from_level >= levels or from_level < 0"), "error", T, ": source level out of range"),
        row(own.where("to_level >= levels or to_level < 0"), "error", T, ": target level out of range"),
        row(own.where((F.size(rates) > 0) & F.exists(rates, lambda r: r <= 0)), "error", T, ": rate not positive"),
        row(own.where(F.size(rates) == 0), "error", T, ": no phase"),
        row(atoms.where("levels is null"), "error", T, ": unknown automaton ", R),
        row(atoms.where("level >= levels or level < 0"), "error", T, ": level of ", R, " out of range"),
        row(a.join(t, ["model_id", "automaton"], "left_anti"), "warning", F.col("automaton"), ": no transition"),
        row(own.where("from_level = to_level"), "warning", T, ": stays where it is"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def projection_losses(models: Models) -> DataFrame:
    """(model_id, loss, what): what a Boolean logical model can't hold."""
    many = models.automata.where("levels <> 2").groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_list("automaton")), ", ").alias("what"))
    laws = models.transitions.where("dist.kind <> 'exp' or rate <> 1.0").select("model_id").distinct()
    return many.select("model_id", F.lit("levels").alias("loss"), "what").union(laws.select("model_id", F.lit("rates"), F.lit("")))


def expand_phases(models: Models) -> Models:
    """Laws of several phases as chains over new levels, numbered per automaton in order of the moves; only the first
    step keeps the guard."""
    from pyspark.sql import Window as W

    t = models.transitions
    w = W.partitionBy("model_id", "automaton").orderBy("tid").rowsBetween(W.unboundedPreceding, -1)
    extra = F.size("dist.rates") - 1
    based = t.withColumn("_before", F.coalesce(F.sum(extra).over(w), F.lit(0))).join(models.automata, ["model_id", "automaton"])
    steps = based.select("*", F.posexplode("dist.rates").alias("_i", "_r"))
    at = F.col("levels") + F.col("_before") + F.col("_i")
    source = F.when(F.col("_i") == 0, F.col("from_level")).otherwise(at - 1)
    target = F.when(F.col("_i") == extra, F.col("to_level")).otherwise(at)
    guard = F.when(F.col("_i") == 0, F.col("conditions")).otherwise(F.filter("conditions", lambda c: F.lit(False)))
    order = W.partitionBy("model_id").orderBy("tid", "_i")
    law = F.struct(F.lit("exp").alias("kind"), F.lit(1).alias("phases"), F.array("_r").alias("rates"))
    rows = steps.select("model_id", (F.row_number().over(order) - 1).cast("int").alias("tid"), "automaton", source.cast("int").alias("from_level"), target.cast("int").alias("to_level"), guard.alias("conditions"), law.alias("dist"), F.col("_r").alias("rate"))
    more = t.groupBy("model_id", "automaton").agg(F.sum(extra).alias("_more"))
    autos = models.automata.join(more, ["model_id", "automaton"], "left").select("model_id", "automaton", (F.col("levels") + F.coalesce("_more", F.lit(0))).cast("int").alias("levels"))
    return Models(autos, rows, models.initial, models.models)


def assign_rates(models: Models, low: float | None = None, high: float | None = None, seed: int = 0) -> DataFrame:
    """transitions with exponential laws: rate 1, or log-uniform between low and high, drawn from the
    MD5 of (seed, model, tid), so the same on any partitioning."""
    if low is None or high is None:
        rate = F.lit(1.0)
    else:
        if not 0 < low <= high:
            raise ValueError("0 < low <= high is needed")
        key = F.concat_ws("|", F.lit(str(seed)), "model_id", F.col("tid").cast("string"))
        u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
        rate = F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))
    return models.transitions.withColumn("rate", rate).withColumn("dist", F.struct(F.lit("exp").alias("kind"), F.lit(1).alias("phases"), F.array("rate").alias("rates")))


def render_anx(models: Models) -> DataFrame:
    """(model_id, line, text): the model's lines in the order of a file."""
    law = F.when(F.col("dist.kind") == "erlang", F.format_string("erlang(%d, %s)", F.col("dist.phases"), F.col("dist.rates")[0].cast("string"))).when(F.col("dist.kind") == "phase", F.concat(F.lit("phase("), F.array_join(F.transform("dist.rates", lambda r: r.cast("string")), ", "), F.lit(")"))).otherwise(F.col("dist.rates")[0].cast("string"))
    declared = models.automata.select("model_id", F.concat(F.lit("1"), F.col("automaton")).alias("line"), F.concat(F.lit("automaton "), F.col("automaton"), F.lit(" ["), F.array_join(F.sequence(F.lit(0), F.col("levels") - 1).cast("array<string>"), ", "), F.lit("]")).alias("text"))
    moves = transition_texts(models).join(models.transitions.select("model_id", "tid", law.alias("law")), ["model_id", "tid"]).select("model_id", F.concat(F.lit("2"), F.lpad(F.col("tid").cast("string"), 9, "0")).alias("line"), F.concat("text", F.lit(" @ "), "law").alias("text"))
    start = models.initial.groupBy("model_id").agg(F.concat(F.lit("init "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("automaton", "level"))), lambda x: F.concat_ws("=", x["automaton"], x["level"].cast("string"))), ", ")).alias("text"))
    named = models.models.where("name <> ''").select("model_id", F.lit("0").alias("line"), F.concat(F.lit('model "'), F.col("name"), F.lit('"')).alias("text"))
    return named.union(declared).union(moves).union(start.select("model_id", F.lit("3"), "text"))


def with_texts(models: Models) -> Models:
    """The models with texts made from their other frames, as kernels read them; made only where they are read."""
    lines = render_anx(models).groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return Models(models.automata, models.transitions, models.initial, models.models.drop("text").join(lines, "model_id"))


def semiring_step(edges: DataFrame, vector: DataFrame, kind: str) -> DataFrame:
    """(node, value): one matrix-vector product over a semiring. edges: (src, dst, w); vector: (node, value).

    kind: a name of functions.semirings.SEMIRINGS.
    """
    j = edges.join(vector, edges["src"] == vector["node"])
    own = SEMIRINGS[kind]
    value = own.gather(own.along(edges["w"], vector["value"]))
    return j.groupBy(F.col("dst").alias("node")).agg(value.alias("value"))

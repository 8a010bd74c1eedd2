"""Networks as DataFrames: many models side by side, keyed by model_id."""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Network
from ..sources.text import READERS, FormatError, format_of, read_anx, write_anx
from .staging import cut

AUTOMATA = "model_id string, automaton string, levels int"
TRANSITIONS = "model_id string, tid int, automaton string, from_level int, to_level int, conditions array<struct<automaton:string,level:int>>, dist struct<kind:string,phases:int,rates:array<double>>, rate double"
INITIAL = "model_id string, automaton string, level int"
MODELS = "model_id string, name string, source string, text string"
#: Models that are held parsed at once: nested rows are many times their texts.
AT_ONCE = 200
#: A model a row, its parts nested.
PARSED = (
    "model_id string, name string, source string, automata array<struct<automaton:string,levels:int>>, "
    "transitions array<struct<tid:int,automaton:string,from_level:int,to_level:int,conditions:array<struct<automaton:string,level:int>>,dist:struct<kind:string,phases:int,rates:array<double>>,rate:double>>, "
    "initial array<struct<automaton:string,level:int>>, text string"
)


def _rows(model_id: str, net: Network) -> dict[str, list[tuple]]:
    return {
        "automata": [(model_id, a, net.levels[a]) for a in net.automata],
        "transitions": [(model_id, i, m.automaton, m.source, m.target, list(m.conditions), (m.law.kind, len(m.law.rates), list(m.law.rates)), m.law.rate) for i, m in enumerate(net.transitions)],
        "initial": [(model_id, a, k) for a, x in sorted((net.initial or {}).items()) for k in sorted(x)],
        "models": [(model_id, net.name, net.source, write_anx(net))],
    }


def parsed_row(model_id: str, net: Network) -> dict:
    """A network as a row of PARSED."""
    atoms = lambda pairs: [{"automaton": a, "level": k} for a, k in pairs]
    moves = [
        {"tid": i, "automaton": m.automaton, "from_level": m.source, "to_level": m.target, "conditions": atoms(m.conditions), "dist": {"kind": m.law.kind, "phases": len(m.law.rates), "rates": list(m.law.rates)}, "rate": m.law.rate}
        for i, m in enumerate(net.transitions)
    ]
    start = atoms((a, k) for a, x in sorted((net.initial or {}).items()) for k in sorted(x))
    return {"model_id": model_id, "name": net.name, "source": net.source, "automata": [{"automaton": a, "levels": net.levels[a]} for a in net.automata], "transitions": moves, "initial": start, "text": write_anx(net)}


def parsed_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of PARSED from batches (model_id, format, text, extra), AT_ONCE models at most in each part."""
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            part = batch.iloc[at : at + AT_ONCE]
            yield pd.DataFrame([parsed_row(row[0], _parse(*row)) for row in zip(part["model_id"], part["format"], part["text"], part["extra"])])


def _parse(model_id: str, kind: str, text: str, extra: str | None) -> Network:
    if kind == "maboss":
        return READERS[kind](text, extra, name=model_id)
    return READERS[kind](b64decode(text) if kind == "zginml" else text, name=model_id)


@dataclass
class Models:
    """Four frames. An automaton without a row in `initial` may start at any level. Order is data: aidx ranks automata
    by name, tid ranks transitions by automaton and declaration."""

    automata: DataFrame
    transitions: DataFrame
    initial: DataFrame
    models: DataFrame

    @staticmethod
    def of(spark: SparkSession, nets: dict[str, Network]) -> Models:
        """From networks in memory, a few."""
        parts: dict[str, list[tuple]] = {"automata": [], "transitions": [], "initial": [], "models": []}
        for model_id, net in nets.items():
            for k, rows in _rows(model_id, net).items():
                parts[k] += rows
        frame = lambda k, schema: spark.createDataFrame(parts[k], schema)
        return Models(frame("automata", AUTOMATA), frame("transitions", TRANSITIONS), frame("initial", INITIAL), frame("models", MODELS))

    @staticmethod
    def from_texts(texts: DataFrame) -> Models:
        """From (model_id, format, text) rows, any number: parsed on the executors, one model a row, each once: what was read
        is written to the shared folder. A column `extra` holds what a format keeps in a second file (the parameters of a
        MaBoSS model), or null. Zipped files are in base64."""
        if "extra" not in texts.columns:
            texts = texts.withColumn("extra", F.lit(None).cast("string"))

        return Models.of_parsed(cut(texts.select("model_id", "format", "text", "extra").mapInPandas(parsed_parts, PARSED)))

    @staticmethod
    def of_parsed(rows: DataFrame) -> Models:
        """From rows of PARSED, a model each, as the data source reads them."""
        part = lambda c: rows.select("model_id", F.explode(c).alias("x")).select("model_id", "x.*")
        return Models(part("automata"), part("transitions"), part("initial"), rows.select("model_id", "name", "source", "text"))

    @staticmethod
    def read(spark: SparkSession, path: str, format: str | None = None) -> Models:
        """From text files by any path that Spark reads; the file's name without ending is the model_id.

        A MaBoSS model is a .bnd file with the .cfg file of the same name beside it, if there is one.
        """
        kind = format_of(path.replace("*", "x"), format)
        if kind == "maboss" and path.lower().endswith(".cfg"):
            raise FormatError("a .cfg file is no model; give the .bnd file")

        def files(path: str) -> DataFrame:
            return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("model_id"), F.col("value").alias("text"))

        if kind == "zginml":
            packed = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("model_id"), F.lit(kind).alias("format"), F.base64("content").alias("text"))
            return Models.from_texts(packed)
        texts = files(path).withColumn("format", F.lit(kind))
        if kind == "maboss":
            try:
                texts = texts.join(files(path[: -len(".bnd")] + ".cfg").withColumnRenamed("text", "extra"), "model_id", "left")
            except AnalysisException:
                pass  # no such file: rates are 1 and starts free
        return Models.from_texts(texts)

    def networks(self) -> dict[str, Network]:
        """Back in memory; for a few models."""
        return {r.model_id: read_anx(r.text, r.name or "") for r in self.models.collect()}


def kernel(queries: DataFrame, schema: str, answer: Callable[[Network, pd.Series], Iterable[tuple]]) -> DataFrame:
    """Rows of `schema` from answer(network, query) for each row of queries, which carries the network's `text`.

    Queries are dealt out one by one, so that a slow one holds back no other.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, q in batch.iterrows():
                if rows := list(answer(read_anx(q["text"]), q)):
                    yield pd.DataFrame(rows, columns=names)

    return dealt(queries).mapInPandas(run, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out one by one over as many tasks as there are shuffle partitions, whatever values they share. A
    fixed number of partitions is not coalesced, as a few small rows would be, however long each takes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_strides(automata: DataFrame, extra: int = 0) -> DataFrame:
    """automata with aidx and stride: place values of a mixed-radix number over levels + extra digits, lowest first.

    A model whose states outnumber 2^62 has null strides.
    """
    w = W.partitionBy("model_id").orderBy("automaton")
    size = F.sum(F.log2(F.col("levels") + extra)).over(W.partitionBy("model_id"))
    before = F.collect_list(F.col("levels") + extra).over(w.rowsBetween(W.unboundedPreceding, -1))
    stride = F.aggregate(before, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return automata.withColumn("aidx", F.row_number().over(w) - 1).withColumn("stride", F.when(size <= 62, stride.cast("long")))


def encode(models: Models, extra: int = 0) -> tuple[DataFrame, DataFrame]:
    """(spaces, transitions): spaces: model_id, n_states and digits (name, stride, levels) by model; transitions with
    guard (stride, levels, lvl), own level first, and delta. A condition on an unknown automaton gets lvl -1: never."""
    autos = with_strides(models.automata, extra)
    spaces = autos.where("stride is not null").groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("aidx", "automaton", "stride", "levels"))).alias("digits"))
    spaces = spaces.withColumn("n_states", F.aggregate("digits", F.lit(1).cast("long"), lambda a, d: a * (d["levels"] + extra)))
    t = models.transitions
    atoms = t.select("model_id", "tid", F.posexplode(F.concat(F.array(F.struct("automaton", F.col("from_level").alias("level"))), "conditions")).alias("k", "x")).select("model_id", "tid", "k", "x.automaton", F.col("x.level").alias("lvl"))
    known = atoms.join(autos.select("model_id", "automaton", "stride", "levels"), ["model_id", "automaton"], "left")
    guards = known.groupBy("model_id", "tid").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("stride", F.lit(1).cast("long")).alias("stride"), F.coalesce("levels", F.lit(1)).alias("levels"), F.when(F.col("stride").isNull(), -1).otherwise(F.col("lvl")).alias("lvl")))).alias("guard"))
    return spaces, t.join(guards, ["model_id", "tid"]).withColumn("delta", (F.col("to_level") - F.col("from_level")) * F.col("guard")[0]["stride"])


def fires(sid: str | Column, guard: str = "guard") -> Column:
    """Whether a transition's guard holds in a state."""
    sid = F.col(sid) if isinstance(sid, str) else sid
    return F.forall(guard, lambda g: F.pmod(F.call_function("div", sid, g["stride"]), g["levels"]) == g["lvl"])


def state_text(sid: str = "sid", digits: str = "digits") -> Column:
    """'a=0, b=1' in the order of names."""
    return F.array_join(F.transform(digits, lambda d: F.concat_ws("=", d["automaton"], F.pmod(F.call_function("div", F.col(sid), d["stride"]), d["levels"]).cast("string"))), ", ")

"""What the operators of this subpackage share: staged tables, input columns, held-out rows."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary folder, in
    local mode only: on a cluster no other machine sees it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is needed: a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
        sc.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs its own tasks, not the stages before. Files stay until the
    shared folder is cleaned, as for checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark has for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that travel to or from Python at once: a thousand texts, not Spark's ten thousand.
BATCH = 1_000


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows at most, for this session: their copies on both sides stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def map_pandas(rows: DataFrame, run, schema) -> DataFrame:
    _bounded(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def map_arrow(rows: DataFrame, run, schema) -> DataFrame:
    _bounded(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def long_id(df: DataFrame, id_col: str = "doc_id") -> Column:
    """The id as a long named doc_id; the bare column where it is that already, so that equal scans stay equal."""
    if id_col == "doc_id" and dict(df.dtypes)[id_col] == "bigint":
        return F.col(id_col)
    return F.col(id_col).cast("long").alias("doc_id")


def raw_text(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The kept columns and the text's UTF-8 bytes (null text: no bytes); nothing else is read."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def clean_labels(labels: DataFrame, mark: str, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled id with a 0/1 label: null ids and labels are ignored, repeated rows vote (a tie is 1)."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(mark).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg((F.avg(F.col(mark).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


#: Cells of the filter of maybe_among(), each a bit, and how many of them are one bitmap: 4 MB in 1,024 rows at most.
CELLS, BITMAP = 1 << 25, 1 << 15


def maybe_among(rows: DataFrame, id_col: str, ids: DataFrame, mark: str) -> DataFrame:
    """rows with a boolean column `mark`: false only where the id, as a long, is none of ids (doc_id).

    A row that is told apart by this need not be shuffled to meet the ids. The filter that is broadcast has CELLS bits,
    however many ids there are; with more ids more rows are marked, and an exact join of those decides.
    """
    cell = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(CELLS)).cast("int")
    number, bits = fresh(rows, "bitmap_number", "bitmap_bits")
    at = cell(F.col("doc_id"))
    cells = ids.where("doc_id is not null").select(F.shiftright(at, 15).alias(number), at.bitwiseAND(BITMAP - 1).cast("long").alias("place"))
    filters = stage(cells.repartition(number).groupBy(number).agg(F.bitmap_construct_agg("place").alias(bits)), "id-filter")
    own = cell(named(id_col))
    place = own.bitwiseAND(BITMAP - 1)
    byte = F.conv(F.hex(F.substr(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, place.bitwiseAND(7)) == 1, F.lit(False))
    met = rows.join(F.broadcast(filters), F.shiftright(own, 15) == F.col(number), "left")
    return met.select(*map(named, rows.columns), hit.alias(mark))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer in use, as after a table was written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` rows: those with the smallest hash of their id. The same rows whatever the partitions."""
    n = rows.count()
    h = F.xxhash64(F.col(id_col), F.lit(7))
    if n > most:
        # leave fewer rows to sort; twice the share is enough for `most` rows but for a vanishing chance
        share = min(1.0, 2.0 * most / n)
        rows = rows.where(F.pmod(h, F.lit(1 << 20)) <= int(share * (1 << 20)))
        return rows.orderBy(F.pmod(h, F.lit(1 << 20)), h, id_col).limit(most)
    return rows


def labelled_texts(docs: DataFrame, labels: DataFrame, mark: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents of the training folds, staged.

    A row is for training if crc32 of its id modulo 3 is not 1. Of rows that repeat an id the least text counts, null
    as empty. The ids, at most `most` of two numbers each, are
    broadcast; the texts stay distributed.
    """
    ids = hash_sample(clean_labels(labels, mark, id_col).where(fold("doc_id", 3) != 1), "doc_id", most)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = own.join(F.broadcast(stage(ids, "label-ids")), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    return stage(met, "labelled")


def fitted(spark: SparkSession, model):
    """model where tasks find it: a broadcast variable. Its size is bounded by the parameters it was fitted with."""
    return spark.sparkContext.broadcast(model)

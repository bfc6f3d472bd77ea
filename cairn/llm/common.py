"""What several operators share: reading, Arrow batches, stored intermediates and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Rows turned into Python objects at once; a batch of Spark's may hold 10,000.
SLICE = 128
#: Of the filter of `likely`, a power of two: 4 MB, in words of 64 bits.
BITS = 1 << 25


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def id_crc(doc_id: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's setting, or the one that the context was given. A session that runs
    on one machine and names none gets a temporary folder of its own; a cluster that names none is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once and survives lost executors.

    Unlike checkpoint() the table is columnar and compressed, so it takes less disk and a reader that needs
    few columns reads only these.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing that is still to run reads it."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def likely(rows: DataFrame, ids: DataFrame, column: str = "id", bits: int = BITS) -> DataFrame:
    """rows whose column is in ids (one column), and some others: the more ids, the more. A Bloom filter of a bounded size goes to every
    task, so rows need no shuffle; a join that follows sheds the others."""
    place = lambda c: F.xxhash64(F.col(c)).bitwiseAND(F.lit(bits - 1))
    own, name = "_" * (1 + max(map(len, rows.columns))), ids.columns[0]  # own begins no name of rows
    words = ids.select(F.shiftright(place(name), 6).alias(f"{own}word"), place(name).alias(f"{own}place"))
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} & 63 AS int))")
    words = words.groupBy(f"{own}word").agg(F.bit_or(bit(f"{own}place")).alias(f"{own}bits"))
    marked = rows.withColumn(f"{own}place", place(column)).withColumn(f"{own}word", F.shiftright(f"{own}place", 6))
    return marked.join(F.broadcast(words), f"{own}word").where(bit(f"{own}place").bitwiseAND(F.col(f"{own}bits")) != 0).select(rows.columns)


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """doc_id of more than one row, or None; only ids are read."""
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        return repeated
    discard(repeated)
    return None


def one_text_each(docs: DataFrame) -> DataFrame:
    """doc_id, text with one row for each doc_id that is not null: of rows that share one, the least text (a null one only
    if there is no other). Only these rows are shuffled with their texts."""
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    repeated = repeated_ids(known)
    if repeated is None:
        return known
    least = known.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    out = known.join(repeated, "doc_id", "left_anti").union(least)
    out._repeated = True
    return out


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs (no null doc_id) with one row for each doc_id, one with the least text."""
    repeated = repeated_ids(docs)
    if repeated is None:
        return docs
    row = F.struct(*(F.col(c) for c in docs.columns))
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text")).alias("_row")).select("_row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns).union(least)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of links (a, b: long, any order, repeats allowed); root: the least node of its component.

    Alternating large-star and small-star: each round makes every node point nearer to the least node that it
    reaches, in a number of rounds that grows with the logarithm of the longest chain. Rows never outnumber the links,
    so a hot node only gets rows as links that it has; the minimum per node is pre-aggregated before the shuffle. Minima are
    stored before they are joined: Spark splits a hot partition only where both sides come straight from a shuffle.
    """
    edges = stored(links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), "large")
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = stored(small.union(down.select("a", F.col("m").alias("b"))).distinct(), name)
        # ended: a set of stars (each node has one parent, and no parent has a parent)
        parents = after.select(F.col("b").alias("a")).distinct()
        done = after.groupBy("a").count().where("count > 1").isEmpty() and after.join(parents, "a", "left_semi").isEmpty()
        discard(edges, least, large, down)
        edges = after
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, names: list[str], size: int = SLICE) -> DataFrame:
    """df through make()(columns as lists) -> columns as lists, slice by slice; make runs once a task."""

    def run(batches):
        step, kinds = make(), None
        for batch in slices(batches, size):
            out = step(batch.to_pydict())
            if kinds is None:
                kinds = arrow_schema(schema)
            yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_ddl(ddl))


def _ddl(ddl: str):
    """DDL of flat columns and arrays of flat columns, without a JVM (executors have none at hand)."""
    from pyspark.sql import types as T

    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}

    def kind(name: str):
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return T.StructType([T.StructField(*(lambda n, k: (n, kind(k)))(*field.split())) for field in ddl.split(", ")])

"""A live journal: JSON lines that arrive in files, replayed to the state of each block, last write wins."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.operators.journal import ENTRY


def entries(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """o, len, sha, file, line, of a folder of journal files, as a stream; headers, torn and malformed lines are dropped. One
    writer names its files in rising order; a file is read whole, so that its lines are numbered."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(folder)
    lines = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    rows = lines.select(F.from_json("value", ENTRY).alias("e"), "file", "line")
    return rows.select("e.*", "file", "line").where("o IS NOT NULL AND sha IS NOT NULL")


def state(stream: DataFrame) -> DataFrame:
    """o, len, sha: the last entry of each block, for outputMode("complete"); a row for each block is the state."""
    last = stream.groupBy("o").agg(F.max_by(F.struct("len", "sha"), F.struct("file", "line")).alias("e"))
    return last.select("o", "e.*").where("sha <> ''")


def replay_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream's state over the files that are there and gives the table; the checkpoint remembers what was read."""
    query = state(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

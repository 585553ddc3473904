"""Documents that keep arriving: new files are decoded and their cards appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nodes as N
from ..sources import trees


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, content) of new files below the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][mM][iI][rR]").load(folder)


def cards_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards of a batch of files and the files that can't be read; file_id is a hash of the path, so it is the same in any batch."""
    nodes = trees.decode(files.select(F.xxhash64("path").alias("file_id"), "content"))
    return N.cards(trees.good(nodes)), trees.failed(nodes)


def start(spark: SparkSession, folder: str, out: str, state: str) -> StreamingQuery:
    """Appends cards of new files to out/cards and errors to out/errors, a folder a batch, so a batch that is run again after
    a fault replaces itself. Frequencies and vectors are those of a full build, not kept up here."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = cards_of(batch)
        good.write.mode("overwrite").parquet(f"{out}/cards/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return arrivals(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()

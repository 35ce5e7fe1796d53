"""Files as they arrive: the tables of each batch, appended to a folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.plans.views import Corpus


def latest_files(files: DataFrame) -> DataFrame:
    """Of the rows of a path the one modified last; works on a stream in update or complete mode as well."""
    rest = [c for c in files.columns if c != "file_id"]
    return files.groupBy("file_id").agg(F.max_by(F.struct(*rest), F.col("modificationTime")).alias("_row")).select("file_id", "_row.*")


def append_tables(files: DataFrame, folder: str, checkpoint: str, tables: Iterable[str] = ("pdf_objects", "pdf_pages", "pdf_warnings")) -> StreamingQuery:
    """Start a query that writes ``tables`` of ``plans.views.Corpus`` for each batch of the stream ``files``.

    A batch goes to ``folder/table/batch=N`` and overwrites what an attempt at
    it left, so a restarted query neither loses nor repeats rows.
    """
    wanted = tuple(tables)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.select("file_id", "content").persist()
        try:
            found = Corpus(held).tables()
            for name in wanted:
                found[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            held.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

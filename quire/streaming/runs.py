"""A resumable run with stored state: running, then ok or error; what failed resumes where it last succeeded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import state

SCHEMA = "connector string, indexer string, cursor_at long, cursor_id string, status string, message string, processed long, indexed long, skipped long, failed long, removed long, chunks long"


class StateStore:
    """A small table of states in a shared folder; each save is a whole new version, and the newest counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that are complete."""
        path, files = self._files()
        if not files.exists(path):
            return []
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(make(f"{self.folder}/{n}/_SUCCESS")))

    def load(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)

    def save(self, changed: DataFrame) -> DataFrame:
        """Puts changed states in and returns them all; the version before is kept as well, older ones go."""
        found = self.versions()
        state.save(self.load(), changed).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/v{(found[-1] if found else 0) + 1}")
        _, files = self._files()
        for old in found[:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{old}"), True)
        return self.load()


def run_once(store: StateStore, products: DataFrame, indexers: DataFrame, before: int, apply: Callable[[DataFrame], None], limit: int = 100, reset: bool = False, explicit: tuple[int, str] | None = None, dry_run: bool = False, **more) -> DataFrame:
    """One run of all indexers up to a time; returns the states with next_cursor and has_more.

    ``apply`` gets the rows of ``state.plan`` and must be idempotent, since a
    run that failed is repeated from its last success.  A dry run computes the
    same and writes nothing.
    """
    start = state.get_or_create(indexers, store.load())
    planned = state.plan(products, state.resolve_cursors(start, reset, explicit), before, limit, **more)
    begun = state.resolve_cursors(start, reset, explicit)
    if dry_run:
        return state.advance(begun, planned)
    store.save(start.withColumns({"status": F.lit("running"), "message": F.lit("")}))
    try:
        apply(planned)
        done = state.advance(begun, planned)
        rows = done.collect()  # a row an indexer
    except Exception as e:
        store.save(state.failed(start, f"{type(e).__name__}: {e}"[:1000]))
        raise
    done = store.spark.createDataFrame(rows, done.schema)
    store.save(done)
    return done


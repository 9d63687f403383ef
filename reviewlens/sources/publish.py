"""Reports written so that a run may fail at any point and be run again.

    FOLDER/<report>              a report, whole, as it was before the run or as it is after
    FOLDER/_run/<run>/<report>   one that is being written
    FOLDER/_run/<run>/_done/...  a mark for each report of the run that is in place
    FOLDER/_MANIFEST             the run whose reports these all are; written last

A report is written beside the one before and takes its place by renaming, once Spark has committed it. What
a run has done is told by its marks, so that the same run, started again, goes on with what is missing: a
report whose renaming was broken off is renamed, one that was broken off earlier is written anew. Another
run starts over. Spark's readers pass over names that begin with `_`.

Renaming is one step in a file system. In an object store it is a copy; a report is then whole once its
mark is there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from reviewlens.sources.files import delete, exists, file_list, file_system, make_folder, rename

MANIFEST = "_MANIFEST"

# Marks a report written whole, whatever marks Spark's committers leave.
COMPLETE = "_COMPLETE"


def run_name(spark: SparkSession, source: str | list[str], **options) -> str:
    """A name for a run over what `source` holds now: other files or other options, another name."""
    listed = sorted(map(tuple, file_list(spark, source).collect()))
    told = json.dumps([listed, options], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The run whose reports are in `folder` and their names; None while a run has not ended."""
    system, path = file_system(spark, f"{folder}/{MANIFEST}")
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, target = file_system(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_table(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


class Run:
    """The writing of reports to `folder`, begun or gone on with."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.staged = f"{self.folder}/_run/{name}"
        if not exists(spark, self.staged):
            delete(spark, f"{self.folder}/_run")  # what another run left
        make_folder(spark, f"{self.staged}/_done")

    def is_done(self, report: str) -> bool:
        return exists(self.spark, f"{self.staged}/_done/{report}")

    def put(self, report: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = write_table) -> str:
        """The report in its place, made and written unless this run has done so. Returns the place."""
        if not report or report.startswith(("_", ".")) or "/" in report:
            raise ValueError(f"{report!r} cannot name a report")
        place, fresh, old = f"{self.folder}/{report}", f"{self.staged}/{report}", f"{self.staged}/_old/{report}"
        if self.is_done(report):
            return place
        delete(self.spark, f"{self.folder}/{MANIFEST}")  # from here on the reports are not all of one run
        if not exists(self.spark, f"{fresh}/{COMPLETE}"):
            # Either not yet written whole, or already renamed and not yet marked.
            if not (exists(self.spark, old) and exists(self.spark, place)):
                delete(self.spark, fresh)
                write(make(), fresh)
                _write_text(self.spark, f"{fresh}/{COMPLETE}", "")
        if exists(self.spark, f"{fresh}/{COMPLETE}"):
            if exists(self.spark, place):
                delete(self.spark, old)
                rename(self.spark, place, old)
            rename(self.spark, fresh, place)
        _write_text(self.spark, f"{self.staged}/_done/{report}", "")
        return place

    def end(self, reports: list[str]) -> None:
        """Removes what the run no longer needs and writes the manifest."""
        delete(self.spark, f"{self.folder}/_run")
        _write_text(self.spark, f"{self.folder}/{MANIFEST}", json.dumps({"run": self.name, "reports": sorted(reports)}))


def publish(spark: SparkSession, folder: str, name: str, reports: Mapping[str, Callable[[], DataFrame]]) -> None:
    """All `reports` as the run `name`, each made when it is its turn and only if it is not done."""
    run = Run(spark, folder, name)
    for report, make in reports.items():
        run.put(report, make)
    run.end(list(reports))

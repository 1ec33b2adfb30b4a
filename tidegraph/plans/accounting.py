"""What a piece of work cost: bytes, rows and task time of its jobs, from the numbers that Spark keeps of each stage."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Cost:
    """Sums over all stages that ran; a stage that was skipped, since its result was there, costs nothing."""

    jobs: int = 0
    tasks: int = 0
    rows_read: int = 0
    bytes_read: int = 0
    bytes_written: int = 0
    shuffle_read: int = 0
    shuffle_written: int = 0
    spilled: int = 0
    task_seconds: float = 0.0
    gather_seconds: float = 0.0


#: Milliseconds to wait until Spark has noted the last task.
PATIENCE = 30_000


def _kept(read: Callable):
    """What Spark still keeps, else None."""
    try:
        return read()
    except Py4JJavaError as e:
        if e.java_exception.getClass().getName() != "java.util.NoSuchElementException":
            raise
        return None


@contextmanager
def accounted(spark: SparkSession) -> Iterator[Cost]:
    """The cost of the jobs that this thread starts within the block, whole once the block ends.

    Jobs are told apart by a tag of their own, so other tags and groups stay and other threads do not count.
    Stages that read a shuffle are the gathering side; the rest of the task time is scattering.
    Spark keeps only its newest stages (``spark.ui.retainedStages``) and lets go of skipped ones first, which cost
    nothing; if the numbers of one that ran are gone, a warning says that the sums are too low.
    """
    context, tag, cost = spark.sparkContext, f"accounted-{uuid.uuid4().hex}", Cost()
    context.addJobTag(tag)
    try:
        yield cost
    finally:
        context.removeJobTag(tag)
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty(PATIENCE)
    store, seen, skipped, gone, lost = scala.statusStore(), set(), 0, 0, 0
    for job in scala.statusTracker().getJobIdsForTag(tag):
        cost.jobs += 1
        kept = _kept(lambda: store.job(job))
        if kept is None:
            lost += 1
            continue
        skipped += kept.numSkippedStages()
        stages = kept.stageIds()
        for k in range(stages.size()):
            seen.add(stages.apply(k))
    for stage in seen:
        told = _kept(lambda: store.lastStageAttempt(stage))
        if told is None:
            gone += 1
            continue
        if told.status().toString() == "SKIPPED":
            skipped -= 1
            continue
        cost.tasks += told.numCompleteTasks()
        cost.rows_read += told.inputRecords()
        cost.bytes_read += told.inputBytes()
        cost.bytes_written += told.outputBytes()
        cost.shuffle_read += told.shuffleReadBytes()
        cost.shuffle_written += told.shuffleWriteBytes()
        cost.spilled += told.diskBytesSpilled()
        cost.task_seconds += told.executorRunTime() / 1000
        if told.shuffleReadBytes():
            cost.gather_seconds += told.executorRunTime() / 1000
    if lost or gone > max(0, skipped):
        warnings.warn(f"Spark has let go of the numbers of {lost} jobs and {gone - max(0, skipped)} stages: what is told is too low", stacklevel=3)

"""Messages that make their batch fail: found by halving, and set aside.

A row that raises takes its whole job down. When a batch fails, it is numbered and halved until each
raising row stands alone; all others are answered on the way. Finding one of ``n`` rows takes some
``2 log2(n)`` jobs, and a batch without such rows takes one.

A step that can tell in its tasks which rows make it raise, such as a model, is asked first. That takes
one job, however many rows raise; only what raises for another reason is left to the halving.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.operators.keys import few_sent
from skillbridge.operators.numbering import numbered
from skillbridge.session import stored

_FEW = 64  # rows that need no second task
MOST = 100  # raising rows of a batch; with more, the fault is hardly the messages'
_RAISED = re.compile(r"^(?:E +)?(?:\w+\.)*\w*(?:Error|Exception|Warning|Exit): (.*)$", re.MULTILINE)


def reason_of(error: Exception) -> str:
    """What a failed job says of its cause: the innermost message, without types and traces."""
    text = str(error)
    python = text.rpartition("Traceback (most recent call last)")[2] if "Traceback (most" in text else ""
    found = _RAISED.findall(python)
    return (found[-1] if found else text.strip().splitlines()[0] if text.strip() else type(error).__name__).strip()


@dataclass
class _Search:
    rows: DataFrame
    work: Callable[[DataFrame], None]
    most: int
    found: list[tuple[int, str]] = field(default_factory=list)

    def fails(self, lo: int, hi: int) -> str | None:
        """Run rows ``lo .. hi - 1``; the reason if they raise."""
        part = self.rows.filter((F.col("_number") >= lo) & (F.col("_number") < hi))
        if hi - lo < _FEW * self.rows.sparkSession.sparkContext.defaultParallelism:
            part = part.coalesce((hi - lo) // _FEW + 1)  # not a task for every file of the batch
        try:
            self.work(part)
        except AnalysisException:
            raise  # the job is wrong, and not a row
        except (PySparkException, Py4JJavaError) as error:
            return reason_of(error)
        return None

    def run(self, lo: int, hi: int, known: bool) -> bool:
        """Whether any of the rows raise; ``known`` says that some do, which saves a job."""
        if hi - lo == 1:
            reason = self.fails(lo, hi)
            if reason is not None:
                self.found.append((lo, reason))
                if len(self.found) > self.most:
                    raise RuntimeError(f"over {self.most} messages of a batch raise; the last one: {reason}")
            return reason is not None
        if not known and self.fails(lo, hi) is None:
            return False
        middle = (lo + hi) // 2
        left = self.run(lo, middle, False)
        # if the left half is fine, the fault is in the right one
        return self.run(middle, hi, not left) or left


Suspects = Callable[[DataFrame], DataFrame]


def isolate(
    batch: DataFrame,
    work: Callable[[DataFrame], None],
    reset: Callable[[], None],
    most: int = MOST,
    suspects: Suspects | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run ``work`` on all rows of ``batch`` but those that raise: the rows done, and the others.

    ``work`` runs a job on the rows it is given and adds to what it has stored; ``reset`` empties that,
    and is called before each attempt at the whole batch. Raising rows have an ``error``, the
    reason. If more than ``most`` rows raise, so does this: an outage must not turn all messages
    into failures. Errors in the job itself, before any row is read, are raised as they are.

    ``suspects`` returns the rows it is given that raise, with ``error``, without raising itself. It is asked
    when the whole batch has failed. As these come at no cost for each, it is an outage if
    they are more than half of the batch (and more than ``most``).
    """
    reset()
    try:
        work(batch)
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError):
        reset()
        rows, n = numbered(batch, "_number")
        if suspects is not None:
            return _told(rows, n, work, reset, most, suspects)
        # with their numbers, so that a part is read and not looked for
        return _halved(stored(rows, "failing-batch"), n, n > 1, work, most)
    return batch, batch.filter(F.lit(False)).withColumn("error", F.lit(None).cast("string"))


def _halved(
    rows: DataFrame, n: int, known: bool, work: Callable[[DataFrame], None], most: int
) -> tuple[DataFrame, DataFrame]:
    search = _Search(rows, work, most)
    if n:
        search.run(0, n, known)
    # as many rows as ``most`` at the most
    reasons = rows.sparkSession.createDataFrame(search.found, "_number bigint, error string")
    raising = rows.join(F.broadcast(reasons), "_number").drop("_number")
    fine = rows.join(F.broadcast(reasons), "_number", "left_anti").drop("_number")
    return fine, raising


def _told(
    rows: DataFrame, n: int, work: Callable[[DataFrame], None], reset: Callable[[], None], most: int, suspects: Suspects
) -> tuple[DataFrame, DataFrame]:
    """The rows that ``suspects`` names are set aside; the others are run, and halved if they raise all the same."""
    told = stored(suspects(rows).select("_number", F.col("error").cast("string").alias("error")), "raising")
    found, size = told.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("error")), F.lit(0))).first()
    if found > max(most, n // 2):
        raise RuntimeError(f"{found} of {n} messages of a batch raise; one of them: {told.first()['error']}")
    raising = rows.join(few_sent(told, found, size), "_number").drop("_number")
    fine = rows.join(few_sent(told.select("_number"), found), "_number", "left_anti").drop("_number")
    try:
        work(fine)
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError):
        reset()
        left, n = numbered(fine, "_number")
        fine, others = _halved(stored(left, "failing-batch"), n, n > 1, work, most)
        raising = raising.unionByName(others)
    return fine, raising

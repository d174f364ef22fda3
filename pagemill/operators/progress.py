"""Progress of a conversion: rates, time left, a bar, and a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(progress: DataFrame) -> DataFrame:
    """progress (done, total, seconds) with pages_per_second, eta_seconds, percent and a bar of 20 places."""
    speed = F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("seconds")), F.lit(0.0))
    part = F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    eta = F.coalesce(F.try_divide(F.col("total") - F.col("done"), speed), F.lit(0.0))
    full = F.floor(part * 20).cast("int")
    return progress.withColumns({"pages_per_second": F.round(speed, 2), "eta_seconds": F.round(eta, 1), "percent": F.round(part * 100, 1), "bar": F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(20) - full))})


def summary(pages: DataFrame) -> DataFrame:
    """book_id, pages, failed, first_errors (three) of pages (book_id, page_number, error)."""
    bad = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page_number", "error")))))
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count("error").alias("failed"), F.transform(F.slice(bad, 1, 3), lambda x: x["error"]).alias("first_errors"))


@dataclass
class Log:
    """Warnings and errors of a driver's run, with a count of pages done."""

    total: int
    done: int = 0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def page(self) -> str:
        self.done += 1
        return f"{self.done}/{self.total}"

    def finish(self) -> str:
        return f"{self.done} of {self.total} pages, {len(self.warnings)} warnings, {len(self.errors)} errors" + "".join(f"\n  {e}" for e in self.errors[:3])

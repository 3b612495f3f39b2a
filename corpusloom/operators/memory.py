"""Working memory: the task, the files and symbols used last, and notes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES, MOST_SYMBOLS = 50, 100


def recent(uses: DataFrame, item: str, at: list, most: int, group: list[str] = ()) -> DataFrame:
    """The ``most`` items used last, each at its last use, with rank 1 for the latest."""
    last = uses.groupBy(*group, item).agg(F.max(F.struct(*at)).alias("last"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.desc("last"), item)
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*group, item, "last.*", "rank")


@dataclass
class WorkingMemory:
    """What a session remembers; it is passed to queries, never changed by them."""

    task: str | None = None
    files: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def remember(self, task: str, files: list[str], symbols: list[str]) -> WorkingMemory:
        """A memory in which these come last; the oldest beyond the limits are forgotten."""
        moved = lambda old, new, most: [*(x for x in old if x not in set(new)), *dict.fromkeys(new)][-most:]
        return WorkingMemory(task, moved(self.files, files, MOST_FILES), moved(self.symbols, symbols, MOST_SYMBOLS), list(self.notes))

    def render(self) -> str:
        rows = [f"Task: {self.task or 'none'}", f"Files: {', '.join(self.files[::-1][:12]) or 'none'}", f"Symbols: {', '.join(self.symbols[::-1][:20]) or 'none'}", *(f"Note: {n}" for n in self.notes)]
        return "# Working memory\n" + "\n".join(rows) + "\n"

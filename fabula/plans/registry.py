"""Rules by phase and priority: a rule is a function of lines that carry their legend's cast; one that can't be planned leaves the lines as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds, legend


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows``, written to the folder that the cluster names in spark.checkpoint.dir (below the warehouse where it names none); they keep their partitions and order."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))
    return rows.checkpoint()


@dataclass(frozen=True)
class Rule:
    name: str
    phase: int
    priority: int
    apply: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Rules that run in the order of phase, priority and name; ``log`` notes which failed when the last plan was made.

    What a rule raises at run time on a document stays with that document (``folds.fold``)."""

    rules: dict[str, Rule] = field(default_factory=dict)
    #: Rules after which lines are written to the checkpoint folder, as plans of all rules are slow to make and to recompute.
    cuts: set[str] = field(default_factory=set)
    log: list[str] = field(default_factory=list)

    def rule(self, phase: int, priority: int = 0, name: str | None = None):
        """Decorator: adds a function lines -> lines; of equal names the last counts."""

        def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            key = name or f.__name__
            self.rules[key] = Rule(key, phase, priority, f)
            return f

        return add

    def ordered(self, skip: Iterable[str] = (), only: Iterable[str] | None = None) -> list[Rule]:
        left, wanted = set(skip), None if only is None else set(only)
        kept = [r for r in self.rules.values() if r.name not in left and (wanted is None or r.name in wanted)]
        return sorted(kept, key=lambda r: (r.phase, r.priority, r.name))

    def run(self, lines: DataFrame, casts: DataFrame, skip: Iterable[str] = (), only: Iterable[str] | None = None) -> DataFrame:
        """``lines`` after all rules, with ``cast`` (of ``casts``), block_id and faults; columns are the same after each rule."""
        self.log = []
        for name, kind in (("block_id", "int"), ("faults", folds.FAULTS)):
            if name not in lines.columns:
                lines = lines.withColumn(name, F.lit(None).cast(kind))
        columns = lines.columns
        lines = legend.attach(lines, casts)
        for rule in self.ordered(skip, only):
            try:
                after = rule.apply(lines)
                lines = after.select(*columns, "cast") if "cast" in after.columns else legend.attach(after.select(columns), casts)
                if rule.name in self.cuts:
                    lines = checkpointed(lines)
            except (PySparkException, KeyError, TypeError, ValueError) as e:
                self.log.append(f"{rule.name}: {type(e).__name__}: {e}")
        return lines

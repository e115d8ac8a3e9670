"""Running values over groups of any length: segmented scans over range partitions.

``Window.partitionBy(group).orderBy(...)`` moves a whole group into one task. Here the rows are range-partitioned in
(group, order), so that a long group takes up several partitions, and stored. Inside a *piece* (the rows of one group in one partition)
an ordinary window does the work. What a piece has to know of those before or after it (the last row's value, the sum
so far, the nearest value) is carried over the partition borders by a window over one summary row per piece: at most
one per partition and group, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.session import cut_lineage


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column


def previous(value: Column | str) -> Scan:
    """The value of the row before (null at a group's first row)."""
    return Scan("previous", _column(value))


def following(value: Column | str) -> Scan:
    """The value of the row after."""
    return Scan("following", _column(value))


def running_sum(value: Column | str) -> Scan:
    """Sum over the rows up to and with this one."""
    return Scan("running_sum", _column(value))


def last_before(value: Column | str) -> Scan:
    """The nearest non-null value of the rows before this one."""
    return Scan("last_before", _column(value))


def first_after(value: Column | str) -> Scan:
    """The nearest non-null value of the rows after this one."""
    return Scan("first_after", _column(value))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a null matching a null; the keys of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


class Pieces:
    """``df`` in (group, order), stored, with its range partition (``_part``) and place (``_at``). Rows that tie in ``order`` keep one
    arbitrary order, the same for every scan."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str], partitions: int | None = None):
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.group = group
        ordered = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
        self.rows = cut_lineage(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))

    def scan(self, **wanted: Scan) -> DataFrame:
        """The stored rows with a column for each wanted scan."""
        key = [*self.group, "_part"]
        inside = Window.partitionBy(*key).orderBy("_at")
        pieces = Window.partitionBy(*self.group).orderBy("_part")  # at most one row per partition
        # what comes after a row is what came before it from behind: Spark computes a frame that ends at unboundedFollowing anew for
        # every row (quadratic in a piece), one that begins at unboundedPreceding grows by a row
        inside_back, pieces_back = (Window.partitionBy(*k).orderBy(F.col(o).desc()) for k, o in ((key, "_at"), (self.group, "_part")))
        before = (Window.unboundedPreceding, -1)
        ends, carried, own = [], {}, {}
        for name, scan in wanted.items():
            x, carry = scan.value, f"_carry_{name}"
            known = F.when(x.isNotNull(), F.col("_at"))  # max_by and min_by pass over null places
            end, over, here = {
                "previous": (F.max_by(x, "_at"), lambda c: F.lag(c).over(pieces), lambda x=x: F.lag(x).over(inside)),
                "following": (F.min_by(x, "_at"), lambda c: F.lead(c).over(pieces), lambda x=x: F.lead(x).over(inside)),
                "running_sum": (F.sum(x), lambda c: F.sum(c).over(pieces.rowsBetween(*before)),
                                lambda x=x: F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0))),
                "last_before": (F.max_by(x, known), lambda c: F.last(c, ignorenulls=True).over(pieces.rowsBetween(*before)),
                                lambda x=x: F.last(x, ignorenulls=True).over(inside.rowsBetween(*before))),
                "first_after": (F.min_by(x, known), lambda c: F.last(c, ignorenulls=True).over(pieces_back.rowsBetween(*before)),
                                lambda x=x: F.last(x, ignorenulls=True).over(inside_back.rowsBetween(*before))),
            }[scan.kind]
            ends.append(end.alias(carry))
            carried[carry] = over(F.col(carry))
            if scan.kind == "previous":
                own[name] = F.when(F.col("_at") == F.min("_at").over(Window.partitionBy(*key)), F.col(carry)).otherwise(here())
            elif scan.kind == "following":
                own[name] = F.when(F.col("_at") == F.max("_at").over(Window.partitionBy(*key)), F.col(carry)).otherwise(here())
            elif scan.kind == "running_sum":
                own[name] = F.when(F.col(carry).isNull(), here()).otherwise(F.col(carry) + F.coalesce(here(), F.lit(0)))
            else:
                own[name] = F.coalesce(here(), F.col(carry))
        summary = self.rows.groupBy(*key).agg(*ends)
        summary = summary.select(*key, *[c.alias(n) for n, c in carried.items()])
        return same(self.rows, summary, key).withColumns(own).drop(*carried)

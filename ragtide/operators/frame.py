"""Row sources. A Frame is a DataFrame with an order of its rows; arrays are expressions over a Frame.

Rows of a DataFrame have no order, rows of an array do. A Frame therefore names the columns that order its rows (for
Parquet: file and row index). Consecutive numbers are only worked out for operators that need them, in two steps that
never sort everything in one task: rows are cut into buckets of 2 ** config.bucket_bits places by their order columns, the small table of
buckets is summed up by a window, and each bucket then numbers its own rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtide.config import config

HIDDEN = "__rt_"
#: Rows that one task may sort and hand on.
FEW = 10_000


_serial = itertools.count()


def hidden(what: str) -> str:
    """A column name that no input has."""
    return f"{HIDDEN}{what}_{next(_serial)}"


class Frame:
    """df: rows with hidden columns. order: columns that order them. row: a column of consecutive numbers from 0, if
    there is one. part: a column of partition numbers, if there is one. divisions: first row of each partition and the
    number of rows, if known. inner: how many of the last order columns are places within what was a row before. from_files: the rows are those of Parquet files, ordered by file and place once somebody
    asks; whole: and none is filtered out. packed: one of Spark's partitions holds several of these."""

    def __init__(self, df: DataFrame, order: tuple[str, ...] = (), row: str | None = None, part: str | None = None, divisions: tuple[int, ...] | None = None, parts: int | None = None, from_files: bool = False, whole: bool = False, inner: int = 0, packed: bool = False):
        self.df, self.order, self.row, self.part, self.divisions, self._parts = df, order, row, part, divisions, parts
        self.from_files, self.whole, self.inner, self.packed = from_files, whole, inner, packed

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    # Hidden columns are added in place: every array over this frame stays valid, and columns nobody reads are pruned.
    def bind(self, col: Column, what: str = "s") -> Column:
        name = hidden(what)
        self.df = self.df.withColumn(name, col)
        return F.col(name)

    def ordered(self) -> tuple[str, ...]:
        """The order columns; rows from elsewhere are ordered as Spark happens to read them."""
        if not self.order and self.from_files:
            self.order = (hidden("file"), hidden("pos"))
            self.df = self.df.withColumns(dict(zip(self.order, (F.col("_metadata.file_path"), F.col("_metadata.row_index")))))
        if not self.order:
            name = hidden("id")
            self.df = self.df.withColumn(name, F.monotonically_increasing_id())
            self.order = (name,)
        return self.order

    def derived(self, df: DataFrame, order: tuple[str, ...] | None = None, keeps_part: bool = True, parts: int | None = None, inner: int = 0) -> Frame:
        """A frame over other rows made of this one's."""
        return Frame(df, self.order if order is None else order, inner=self.inner if order is None else inner, part=self.part if keeps_part else None, parts=parts or (self._parts if keeps_part else None), packed=self.packed and keeps_part)

    def where(self, mask: Column) -> Frame:
        if not self.order and self.from_files:
            return Frame(self.df.where(mask), part=self.part, parts=self._parts, from_files=True)
        self.ordered()
        return self.derived(self.df.where(mask))

    def _bucket(self) -> tuple[list[Column], list[str]]:
        # Places within rows are left out, or there would be a bucket for each row; a bucket then holds fewer rows as they were.
        order = self.ordered()
        base = order[: len(order) - self.inner] or order
        *outer, last = base
        bits = config.bucket_bits if len(base) == len(order) else max(0, config.bucket_bits - 4)
        dtype = dict(self.df.dtypes)[last]
        cut = F.shiftright(F.col(last), bits) if dtype in ("bigint", "int") else F.col(last)
        return [*map(F.col, outer), cut], [hidden("b") for _ in (*outer, last)]

    def running(self, value: Column, before: str, over: DataFrame | None = None) -> DataFrame:
        """df with column `before`: the sum of value over all earlier rows."""
        cuts, names = self._bucket()
        df = self.df if over is None else over
        df = df.withColumns({**dict(zip(names, cuts)), before: value.cast("long")})
        start, total = hidden("o"), hidden("t")
        # One row for each bucket, so that one task can sum them up.
        keys = [hidden("k") for _ in names]
        sums = df.groupBy(*names).agg(F.sum(before).alias(total))
        earlier = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(start))
        # Rows from several sources have nulls in each other's order columns.
        joined = df.join(sums, [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, keys)])
        own = Window.partitionBy(*names).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        return joined.withColumn(before, F.col(start) + F.coalesce(F.sum(before).over(own), F.lit(0))).drop(*names, *keys, start)

    def ranked(self) -> str:
        """The column of consecutive row numbers; made when first asked for."""
        if self.row is None:
            name = hidden("row")
            if self.whole:
                path, at = self.ordered()
                counts = self.df.groupBy(path).agg(F.count("*").alias("n"))
                first = counts.select(F.col(path).alias(f"{name}p"), (F.sum("n").over(Window.orderBy(path)) - F.col("n")).alias(f"{name}f"))
                self.df = self.df.join(first, F.col(path) == F.col(f"{name}p")).withColumn(name, F.col(f"{name}f") + F.col(at)).drop(f"{name}p", f"{name}f")
            else:
                self.df = self.running(F.lit(1), name)
            self.row = name
        return self.row

    def count(self) -> int:
        return self.df.count()

    # Partitions.
    def parted(self) -> str:
        """The column of partition numbers."""
        if self.part is None:
            if self.from_files and len(self.ordered()) == 2:
                path = self.order[0]
                name = hidden("part")
                paths = self.df.select(F.col(path).alias(f"{name}p")).distinct()
                paths = paths.withColumn(name, F.row_number().over(Window.orderBy(f"{name}p")) - 1)
                self.df = self.df.join(paths, F.col(path) == F.col(f"{name}p")).drop(f"{name}p")
            else:
                name = hidden("part")
                self.df = self.df.withColumn(name, F.spark_partition_id())
            self.part = name
        return self.part

    @property
    def npartitions(self) -> int:
        if self.divisions is not None:
            return len(self.divisions) - 1
        if self._parts is None:
            if self.part is None and not self.from_files:
                self._parts = self.df.rdd.getNumPartitions()
            else:
                part = self.parted()
                top = self.df.agg(F.max(part)).first()
                self._parts = 1 + (top[0] if top[0] is not None else 0)
        return self._parts

    def compute_divisions(self) -> tuple[int, ...]:
        """Rows before each partition, and all rows: a row for each partition comes to the driver, no more."""
        if self.divisions is None:
            n, part = self.npartitions, self.parted()
            sizes = {r[0]: r[1] for r in self.df.groupBy(part).count().collect()}
            self.divisions = tuple(itertools.accumulate((sizes.get(i, 0) for i in range(max([n, *(k + 1 for k in sizes)]))), initial=0))
        return self.divisions

    def sorted(self) -> DataFrame:
        order = self.ordered()
        return self.df.orderBy(*order)

    def first_rows(self, n: int) -> Frame:
        if n > FEW:  # too many for one task
            row = F.col(self.ranked())
            return self.derived(self.df.where(row < n), keeps_part=False)
        order = self.ordered()
        return self.derived(self.df.orderBy(*order).limit(n), keeps_part=False, parts=1)

"""Durable intermediate results in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back: the files
outlive a lost executor, are compressed, and give the optimiser real sizes. Tables staged inside a
``Scratch`` block go when it ends, but for those it is told to keep. What a result still reads lazily
stays until the folder is cleaned (Spark's checkpoint folders are, by whoever runs the cluster); a
folder of our own, which only a session on one machine gets, goes with the process.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame

from recollect.sources import work as W


_scratch = threading.local()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores where df has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Drops, at its end, the tables staged inside it that weren't kept."""

    def __enter__(self) -> Scratch:
        self._held: list[Staged] = []
        _scratch.open = [*getattr(_scratch, "open", []), self]
        return self

    def keep(self, table: Staged) -> DataFrame:
        """The table's rows, which outlive this block (an outer block, if any, drops them)."""
        self._held.remove(table)
        if len(_scratch.open) > 1:
            _scratch.open[-2]._held.append(table)
        return table.df

    def __exit__(self, *exc) -> None:
        _scratch.open = _scratch.open[:-1]
        for table in self._held:
            table.drop()


class Staged:
    """A written table: ``df`` reads it, ``drop()`` removes its files."""

    def __init__(self, df: DataFrame, label: str):
        self._spark = df.sparkSession
        self.path = W.fresh(self._spark, label)
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        if getattr(_scratch, "open", None):
            _scratch.open[-1]._held.append(self)

    def drop(self) -> None:
        W.remove(self._spark, self.path)

"""A vector store in a folder: the contract of an external index, kept in Parquet.

Vectors are kept as int8 codes with their scale, partitioned by the last digits of the id's hash, so an
upsert rewrites only the parts it touches. ``query`` ranks by the codes; callers rank the candidates
again by the vectors they hold themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.sources import work as W


class FolderIndex:
    """ensure, upsert, delete, count and query over vectors (id, embedding) below a path."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path, parts

    def ensure(self, dim: int) -> None:
        """Makes the index for vectors of this length, or checks that it is one."""
        if not W.names(self.spark, f"{self.path}/meta"):
            self.spark.createDataFrame([(dim, self.parts)], "dim int, parts int").coalesce(1).write.parquet(f"{self.path}/meta")
        meta = self.spark.read.parquet(f"{self.path}/meta").first()
        if meta["dim"] != dim:
            raise ValueError(f"the index holds vectors of {meta['dim']} components, not {dim}")
        self.parts = meta["parts"]

    def _rows(self) -> DataFrame:
        if not any(n.startswith("part=") for n in W.names(self.spark, f"{self.path}/codes")):
            return self.spark.createDataFrame([], "id long, codes array<int>, scale double, part int")
        return self.spark.read.schema("id long, codes array<int>, scale double, part int").parquet(f"{self.path}/codes")

    def _replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Writes new contents of the touched parts, beside the old ones first: a read never sees half of it."""
        staged = W.fresh(self.spark, "index-parts")
        rows.repartition("part").write.partitionBy("part").parquet(staged)
        kept = {n for n in W.names(self.spark, staged) if n.startswith("part=")}
        self.spark.read.schema("id long, codes array<int>, scale double, part int").parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/codes")
        for r in touched.collect():  # at most ``parts`` rows
            if f"part={r['part']}" not in kept:
                W.remove(self.spark, f"{self.path}/codes/part={r['part']}")
        W.remove(self.spark, staged)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def upsert(self, vectors: DataFrame) -> None:
        """Adds vectors or replaces those of the same id; of several under one id that of the least hash counts."""
        one = vectors.select(F.col("id").cast("long").alias("id"), "embedding").groupBy("id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
        new = one.select("id", V.quantize(F.col("embedding")).alias("q")).select("id", "q.codes", "q.scale").withColumn("part", self._part())
        touched = new.select("part").distinct()
        stay = self._rows().join(touched, "part", "left_semi").join(new.select("id"), "id", "left_anti")
        self._replace(stay.select("id", "codes", "scale", "part").unionByName(new), touched)

    def delete(self, ids: DataFrame) -> None:
        """Removes the vectors of ids (id)."""
        gone = ids.select(F.col("id").cast("long").alias("id")).withColumn("part", self._part())
        touched = gone.select("part").distinct()
        self._replace(self._rows().join(touched, "part", "left_semi").join(gone.select("id"), "id", "left_anti").select("id", "codes", "scale", "part"), touched)

    def count(self) -> int:
        return self._rows().count()

    def query(self, vector: list[float], depth: int) -> DataFrame:
        """(id, score) of the first ``depth`` by cosine with the codes, ties by id."""
        probe = F.array(*(F.lit(float(x)) for x in vector))
        return self._rows().select("id", V.cosine(F.col("codes"), probe).alias("score")).orderBy(F.desc("score"), "id").limit(depth)

"""A kept inverted file of vectors: cells, rows by cell and versions, as tables that grow by appends.

Below one folder lie ``cells`` (a centroid each), ``retired`` (cells that were split), ``rows``
(by the cell that they were put in) and ``gone`` (ids with the time of their removal), all by
the version that wrote them, and ``versions``, whose entry is written last. A reader takes the
newest version and only what versions up to it wrote, so a change that fails half way is not
seen, and is overwritten when it is made again. Rows of a retired cell stay where they are: no
search looks there, since the cells that took its place have them too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decilog.operators import knn as K

#: Cells up to which a cell is split; their centroids are what every task holds.
MAX_CELLS = 65_536
#: Rows of an overfull cell from which its two new centroids are found.
SPLIT_SAMPLE = 2_000


def nearest_cells(numbers: np.ndarray, centroids: np.ndarray, n: int):
    """A function of a vector column: the numbers of its ``n`` nearest cells."""

    @F.pandas_udf("array<long>")
    def found(v: pd.Series) -> pd.Series:
        near = K.unit(v) @ centroids.T
        top = np.argsort(-near, axis=1, kind="stable")[:, :n]
        return pd.Series(list(numbers[top]))

    return found


@dataclass
class VectorIndex:
    """The index below ``path``. Rows: id, vec, the hard-filter ``keys`` and added_at."""

    spark: SparkSession
    path: str
    keys: list[str]
    probes: int = 1

    def written(self, name: str, version: int | None = None) -> DataFrame:
        """What versions up to ``version`` (the newest) wrote to one of the tables."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/version=*").where(F.col("version") <= (self.version() if version is None else version))

    def version(self) -> int:
        """The newest version, -1 before the first."""
        from decilog.streaming.stream import exists

        if not exists(self.spark, f"{self.path}/versions"):
            return -1
        return self.spark.read.parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]

    def write(self, version: int, tables: dict[str, DataFrame], probes: int) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def cells(self, version: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit centroids of the cells that are not retired; at most MAX_CELLS."""
        version = self.version() if version is None else version
        live = self.written("cells", version).join(F.broadcast(self.written("retired", version).select("cell")), "cell", "left_anti")
        rows = live.select("cell", "centroid").orderBy("cell").collect()
        return np.array([r.cell for r in rows], np.int64), np.array([r.centroid for r in rows])

    def placed(self, rows: DataFrame, version: int) -> DataFrame:
        numbers, centroids = self.cells(version)
        return rows.select("id", "vec", *self.keys, F.col("added_at").cast("long").alias("added_at"), nearest_cells(numbers, centroids, 1)("vec")[0].alias("cell"))

    @classmethod
    def build(cls, rows: DataFrame, path: str, keys: list[str], k: int = 10, recall: float = 0.95, max_sample: int = 20_000) -> VectorIndex:
        """Version 0: cells fitted on a bounded sample (see :func:`decilog.operators.knn.fit_cells`), every row in its nearest."""
        spark = rows.sparkSession
        fitted = K.fit_cells(rows, k, recall=recall, max_sample=max_sample, keys=keys)
        made = cls(spark, path, keys, fitted.probes)
        cells = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(fitted.centroids)], "cell long, centroid array<double>")
        empty = spark.createDataFrame([], "cell long"), spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, removed_at long")
        place = nearest_cells(np.arange(len(fitted.centroids)), fitted.centroids, 1)
        placed = rows.select("id", "vec", *keys, F.col("added_at").cast("long").alias("added_at"), place("vec")[0].alias("cell"))
        made.write(0, {"cells": cells, "retired": empty[0], "gone": empty[1], "rows": placed}, fitted.probes)
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: list[str]) -> VectorIndex:
        """An index that was kept, as of its newest version."""
        found = cls(spark, path, keys)
        found.probes = spark.read.parquet(f"{path}/versions").where(F.col("version") == found.version()).first().probes
        return found

    def add(self, rows: DataFrame) -> int:
        """Append ``rows``, each in its nearest cell; returns the new version. An id that is in the index already is an error of the caller."""
        version = self.version() + 1
        self.write(version, {"rows": self.placed(rows, version - 1)}, self.probes)
        return version

    def remove(self, ids: DataFrame, at: int) -> int:
        """From time ``at`` on the ids are not found; searches as of earlier times still find them."""
        version = self.version() + 1
        self.write(version, {"gone": ids.select("id", F.lit(at).cast("long").alias("removed_at"))}, self.probes)
        return version

    def split(self, most: int) -> int:
        """Give every cell of over ``most`` rows up for two, as far as MAX_CELLS allows; only the rows of such cells are written anew.

        The new centroids are those of two-means over at most SPLIT_SAMPLE rows of the cell; a
        cell whose sample cannot be parted stays. Probes grow with the cells that a query
        must now look into. Returns the new version, or the present one if no cell is overfull.
        """
        version = self.version()
        numbers, centroids = self.cells(version)
        live = self.spark.createDataFrame([(int(n),) for n in numbers], "cell long")
        rows = self.written("rows", version).join(F.broadcast(live), "cell", "left_semi")
        full = [r.cell for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy(F.desc("n"), "cell").limit(max(0, MAX_CELLS - len(numbers))).collect()]
        if not full:
            return version
        counts = rows.where(F.col("cell").isin(full))
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
        size = counts.groupBy("cell").agg((SPLIT_SAMPLE / F.count(F.lit(1)) * (1 << 20)).alias("_cut"))
        some = counts.join(F.broadcast(size), "cell").where(share <= F.col("_cut"))

        def halves(part: pd.DataFrame) -> pd.DataFrame:
            m = K.unit(part.sort_values("id")["vec"])
            a = m[0]
            b = m[np.argmin(m @ a)]
            for _ in range(8):
                near = m @ a >= m @ b
                if near.all() or not near.any():
                    return pd.DataFrame({"cell": [], "centroid": []})
                a, b = (x / max(np.linalg.norm(x), 1e-12) for x in (m[near].sum(0), m[~near].sum(0)))
            return pd.DataFrame({"cell": part["cell"].iloc[0], "centroid": [a.tolist(), b.tolist()]})

        pairs = some.groupBy("cell").applyInPandas(halves, "cell long, centroid array<double>").orderBy("cell").collect()  # two for each overfull cell
        if not pairs:
            return version
        first = int(self.written("cells", version).agg(F.max("cell")).first()[0]) + 1
        parted = sorted({p.cell for p in pairs})
        new = self.spark.createDataFrame([(first + n, p.centroid) for n, p in enumerate(pairs)], "cell long, centroid array<double>")
        place = nearest_cells(np.arange(first, first + len(pairs)), np.array([p.centroid for p in pairs]), 1)
        moved = rows.where(F.col("cell").isin(parted)).withColumn("cell", place("vec")[0]).drop("version")
        self.probes = min(len(numbers) + len(parted), -(-self.probes * (len(numbers) + len(parted)) // len(numbers)) + 1)
        self.write(version + 1, {"cells": new, "retired": self.spark.createDataFrame([(c,) for c in parted], "cell long"), "rows": moved}, self.probes)
        return version + 1

    def search(self, queries: DataFrame, k: int = 10, at: int | None = None, version: int | None = None) -> DataFrame:
        """For every query (id, vec, keys) its ``k`` nearest rows among its ``probes`` nearest cells: query, nb, distance, rank.

        ``at``: only rows that had been added by then and not removed. Without it rows that
        were ever removed are out. ``version``: the index as that version left it.
        """
        version = self.version() if version is None else version
        numbers, centroids = self.cells(version)
        gone = self.written("gone", version).groupBy("id").agg(F.min("removed_at").alias("removed_at"))
        rows = self.written("rows", version).drop("version").join(gone, "id", "left")
        rows = rows.where("removed_at IS NULL") if at is None else rows.where((F.col("added_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at)))
        asked = queries.select("id", "vec", *self.keys).withColumn("cell", F.explode(nearest_cells(numbers, centroids, self.probes)("vec")))
        return K.knn(asked, rows.select("id", "vec", *self.keys, "cell"), [*self.keys, "cell"], k)

"""Stage results that are kept, and a manifest that says which of them still hold.

A stage's results lie in a folder per run. The manifest tells, per incident
and stage, the fingerprint of what went in, that of what came out, and the
run. A run's rows are written first; then its entries are published as the
manifest's next version, by one rename: what isn't published doesn't exist, and a
version that another job has published meanwhile makes the rename fail.

A stage's input fingerprint comes from its parameters, its input tables and
the output fingerprints of the stages it needs. So a changed input recomputes the
stages that hang on it, for the incidents it concerns, and no others; a stage
that comes to the same result as before leaves those after it valid.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillspark.sources import workspace

ENTRY = "incident_id bigint, stage string, input bigint, output bigint, run string, version bigint"


def fingerprint(rows: DataFrame, key: str | None = "incident_id", name: str = "fp") -> DataFrame:
    """(key, fp): a hash of each key's rows that doesn't depend on their order; without a key one row for all."""
    cols = sorted(rows.columns)
    # Equal rows don't cancel out: they are counted, and sums wrap nowhere.
    each = rows.select(*([key] if key else []), F.xxhash64(*[F.col(c) for c in cols]).alias("h"))
    total = [F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("s")]
    sums = each.groupBy(key).agg(*total) if key else each.agg(*total)
    return sums.select(*([key] if key else []), F.xxhash64("n", "x", "s").alias(name))


@dataclass
class Input:
    """A table that stages read: with a row's incident as ``key``, or the same for all incidents (None).

    ``version`` stands for its fingerprint where the table has one, such as the
    number of a snapshot: then its rows aren't read to find out what changed.
    """

    rows: DataFrame
    key: str | None = "incident_id"
    version: str | None = None

    def told(self, incidents: DataFrame) -> DataFrame:
        """(incident_id, fp) of ``incidents``."""
        if self.version is not None:
            return incidents.select("incident_id", F.xxhash64(F.lit(self.version)).alias("fp"))
        if self.key is None:
            return incidents.select("incident_id", F.lit(fingerprint(self.rows, None).first().fp).alias("fp"))
        known = fingerprint(self.rows.join(incidents.select(F.col("incident_id").alias(self.key)), self.key, "left_semi"), self.key)
        return incidents.join(known.withColumnRenamed(self.key, "incident_id"), "incident_id", "left").select("incident_id", F.coalesce("fp", F.lit(0)).alias("fp"))


@dataclass
class Stage:
    """``make`` gets the incidents to run (incident_id) and the tables named in ``needs``, inputs or earlier stages."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    params: tuple = ()


@dataclass
class Store:
    """The results under ``root``, a folder that the driver and all executors share."""

    spark: SparkSession
    root: str
    ran: dict[str, int] = field(default_factory=dict)  # incidents that each stage of the last ``run`` was made for

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._files()
        at = path(f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v"))

    def entries(self, stage: str) -> DataFrame:
        """The last entry of each incident for ``stage``."""
        paths = [f"{self.root}/manifest/v{v}" for v in self.versions()]
        every = self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)
        last = F.max_by(F.struct("input", "output", "run", "version"), "version").alias("e")
        return every.where(F.col("stage") == stage).groupBy("incident_id").agg(last).select("incident_id", "e.*")

    def publish(self, entries: DataFrame) -> None:
        """Make ``entries`` (incident_id, stage, input, output, run) the next version; fails if there is one by now."""
        fs, path = self._files()
        version = max(self.versions(), default=0) + 1
        draft, final = f"{self.root}/drafts/{uuid.uuid4().hex}", f"{self.root}/manifest/v{version}"
        entries.withColumn("version", F.lit(version).cast("bigint")).coalesce(1).write.parquet(draft)
        fs.mkdirs(path(f"{self.root}/manifest"))
        if fs.exists(path(final)) or not fs.rename(path(draft), path(final)):
            raise RuntimeError(f"another job published version {version}")

    def rows(self, stage: str, incidents: DataFrame) -> DataFrame:
        """The valid results of ``incidents``: only runs that still hold some are read."""
        held = workspace.written(self.entries(stage).join(incidents.select("incident_id"), "incident_id", "left_semi").select("incident_id", "run"), "held")
        runs = [r.run for r in held.select("run").distinct().collect()] or self._runs(stage)
        read = None
        for run in runs:
            part = self.spark.read.parquet(f"{self.root}/{stage}/{run}")
            read = part.withColumn("run__", F.lit(run)) if read is None else read.unionByName(part.withColumn("run__", F.lit(run)))
        return read.join(held.withColumnRenamed("run", "run__"), ["incident_id", "run__"], "left_semi").drop("run__")

    def _runs(self, stage: str) -> list[str]:
        fs, path = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{stage}")))[:1]

    def run(self, incidents: DataFrame, inputs: dict[str, Input], stages: list[Stage], force: bool = False) -> dict[str, DataFrame]:
        """The results of all ``stages`` for ``incidents``, made where none is valid (or for all with ``force``).

        A stage without incidents to run is still made once, so that its empty
        table has its columns.
        """
        asked = workspace.written(incidents.select("incident_id").distinct(), "asked")
        told = {name: i.told(asked) for name, i in inputs.items()}
        tables = {name: i.rows for name, i in inputs.items()}
        self.ran = {}
        for stage in stages:
            wanted = asked
            for k, need in enumerate(stage.needs):
                wanted = wanted.join(told[need].withColumnRenamed("fp", f"fp{k}"), "incident_id", "left")
            wanted = wanted.select("incident_id", F.xxhash64(F.lit(repr(stage.params)), *[f"fp{k}" for k in range(len(stage.needs))]).alias("input"))
            have = self.entries(stage.name).select("incident_id", F.col("input").alias("was"))
            todo = wanted if force else wanted.join(have, "incident_id", "left").where(~F.col("input").eqNullSafe(F.col("was"))).drop("was")
            todo = workspace.written(todo, "todo")
            self.ran[stage.name] = todo.count()
            if self.ran[stage.name] or not self.entries(stage.name).limit(1).count():
                run = uuid.uuid4().hex
                made = stage.make(todo.select("incident_id"), *(tables[n] for n in stage.needs))
                made.write.parquet(f"{self.root}/{stage.name}/{run}")
                out = fingerprint(self.spark.read.parquet(f"{self.root}/{stage.name}/{run}"))
                if self.ran[stage.name]:
                    both = todo.join(out, "incident_id", "left")
                    self.publish(both.select("incident_id", F.lit(stage.name).alias("stage"), "input", F.coalesce("fp", F.lit(0)).alias("output"), F.lit(run).alias("run")))
            told[stage.name] = self.entries(stage.name).select("incident_id", F.col("output").alias("fp"))
            tables[stage.name] = self.rows(stage.name, asked)
        return {s.name: tables[s.name] for s in stages}

"""Profiles and patterns as a log of what each batch changed, put together on reading.

A batch writes two kinds of tables, both in proportion to the batch: sums (counters, gap
counts, times, places), of which it writes what it adds, and replaced tables (metrics,
patterns), of which it writes all rows of the users that it touched. Version n of a table
is the sum over the batches up to n, or per user the rows of the newest batch that wrote
some.

A batch counts once its commit file stands. The file names the folder of the batch's
tables and takes its place by a rename, so readers see all of a batch or nothing: an
attempt that failed half-way leaves a folder that nobody reads, and a batch that is
repeated puts a new folder in the place of the old one.

`compact` writes the tables of a version whole, sorted by user so that few files hold a
given user, and then commits that as a base. Versions from the base on are read from
there; older ones can be read until `vacuum` removes what no base or later commit names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlens.operators.outliers import covariance_sums, merge_sums
from loginlens.operators.profiles import MERGES, Profile, increments
from loginlens.operators.seeded import Seed
from loginlens.operators.segments import SKEW, SkewPolicy
from loginlens.schema import TIME, USER
from loginlens.session import shuffled_joins

#: Tables that add up: those of a profile, and the sums behind the covariance model.
ADDED = {**MERGES, "sums": merge_sums}
REPLACED = ("gaps", "spread", "patterns")
VERSION = "_version"


@dataclass(frozen=True)
class ProfileLog:
    spark: SparkSession
    path: str

    # ---- writing

    def commit(self, version: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame]) -> None:
        """Write one batch's tables, in place of an earlier attempt at it."""
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        with shuffled_joins(self.spark):
            for name, rows in added.items():
                rows.drop("percentage").write.parquet(f"{folder}/{name}")
            for name, rows in replaced.items():
                rows.withColumn(VERSION, F.lit(version).cast("bigint")).write.parquet(f"{folder}/{name}")
        self._publish("commits", version, folder, [*added, *replaced])

    def commit_seed(self, version: int, seed: Seed, patterns: DataFrame) -> None:
        """A profile, its sums and patterns that were made elsewhere, as one batch."""
        profile = seed.profile
        self.commit(version, {**{name: getattr(profile, name) for name in MERGES}, "sums": seed.sums},
                    {"gaps": profile.gaps, "spread": profile.spread, "patterns": patterns})

    def compact(self, version: int) -> None:
        """Write the tables of a version whole, as the base of later reads."""
        folder = f"{self.path}/data/base-{version}-{uuid.uuid4().hex}"
        names = sorted({n for c in self._commits(version) for n in c["tables"]})
        for name in names:
            rows = self._rows(name, version) if name in REPLACED else self.read(name, version).drop("percentage")
            rows.repartitionByRange(USER).sortWithinPartitions(USER).write.parquet(f"{folder}/{name}")
        self._publish("bases", version, folder, names)

    def vacuum(self) -> None:
        """Delete folders and commits that the newest base and later commits do not need."""
        base = self._base(None)
        if base is None:
            return
        for kind, keep in (("commits", lambda v: v > base["version"]), ("bases", lambda v: v == base["version"])):
            for found in self._listed(kind):
                if not keep(found["version"]):
                    self._delete(f"{self.path}/{kind}/{found['file']}")
        needed = {c["folder"].rsplit("/", 1)[1] for c in [base, *self._commits(None)]}
        files, folder = self._at(f"{self.path}/data")
        for status in files.listStatus(folder):
            if status.getPath().getName() not in needed:
                files.delete(status.getPath(), True)

    # ---- reading

    def versions(self) -> list[int]:
        """Committed versions from the newest base on."""
        base = self._base(None)
        return ([base["version"]] if base else []) + sorted(
            c["version"] for c in self._commits(None) if base is None or c["version"] > base["version"])

    def written(self, name: str) -> list[int]:
        """Versions, from the newest base on, whose batch wrote a table."""
        base = self._base(None)
        found = [c for c in self._commits(None) if base is None or c["version"] > base["version"]] + ([base] if base else [])
        return sorted(c["version"] for c in found if name in c["tables"])

    def read(self, name: str, version: int | None = None, users: DataFrame | None = None) -> DataFrame | None:
        """A table as of a version (the newest by default), for wanted users or all; None if no batch wrote it."""
        rows = self._rows(name, version)
        if rows is None:
            return None
        if users is not None:
            rows = rows.join(users.select(USER).distinct(), USER, "left_semi")
        return rows.drop(VERSION) if name in REPLACED else ADDED[name](rows)

    def profile(self, version: int | None = None, users: DataFrame | None = None) -> Profile:
        return Profile(**{name: self.read(name, version, users) for name in (*MERGES, "gaps", "spread")})

    def seed(self, version: int | None = None, users: DataFrame | None = None) -> Seed:
        """What a replay of wanted users' logins starts from."""
        return Seed(self.profile(version, users), self.read("sums", version, users))

    def patterns(self, version: int | None = None, users: DataFrame | None = None) -> DataFrame | None:
        """Clusters per user as of a version; the lookup of wanted users reads no others past the scan."""
        return self.read("patterns", version, users)

    def _rows(self, name: str, version: int | None) -> DataFrame | None:
        base, folders = self._base(version), []
        if base is not None and name in base["tables"]:
            folders.append(base["folder"])
        folders += [c["folder"] for c in self._commits(version) if name in c["tables"]
                    and (base is None or c["version"] > base["version"])]
        if not folders:
            return None
        rows = self.spark.read.parquet(*[f"{f}/{name}" for f in folders])
        if name in REPLACED and len(folders) > 1:
            newest = F.max(VERSION).over(Window.partitionBy(USER))
            rows = rows.withColumn("_newest", newest).where(F.col(VERSION) == F.col("_newest")).drop("_newest")
        return rows

    # ---- commit files

    def _commits(self, version: int | None) -> list[dict]:
        found = sorted(self._listed("commits"), key=lambda c: c["version"])
        return [c for c in found if version is None or c["version"] <= version]

    def _base(self, version: int | None) -> dict | None:
        found = [b for b in self._listed("bases") if version is None or b["version"] <= version]
        return max(found, key=lambda b: b["version"], default=None)

    def _at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _listed(self, kind: str) -> list[dict]:
        """The commit files of a kind: one small file a batch since the last `vacuum`."""
        files, folder = self._at(f"{self.path}/{kind}")
        if not files.exists(folder):
            return []
        out = []
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith((".", "_")):
                stream = files.open(status.getPath())
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                out.append({"file": name, **json.loads(text)})
        return out

    def _publish(self, kind: str, version: int, folder: str, tables: list[str]) -> None:
        """Make a commit visible: written under a passing name, then renamed over an earlier attempt's."""
        text = json.dumps({"version": version, "folder": folder, "tables": tables})
        passing, place = f"{self.path}/{kind}/.{uuid.uuid4().hex}", f"{self.path}/{kind}/{version:012d}.json"
        files, written = self._at(passing)
        files.mkdirs(written.getParent())
        stream = files.create(written, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm, fs = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        target = fs.Path(place)
        fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
            files.makeQualified(written), files.makeQualified(target), options)

    def _delete(self, path: str) -> None:
        files, found = self._at(path)
        files.delete(found, True)


def increments_after(batch: DataFrame, log: ProfileLog, previous: int | None, skew: SkewPolicy = SKEW) -> dict[str, DataFrame]:
    """What a batch adds after version `previous`; nothing of the log is read but its users' rows."""
    users = batch.select(USER).distinct()
    totals = log.read("totals", previous, users) if previous is not None else None
    times = log.read("times", previous, users) if previous is not None else None
    if totals is None:
        totals = batch.select(USER, F.col(TIME).alias("last_login")).limit(0)
    if times is None:
        times = batch.select(USER, F.lit(0).cast("bigint").alias("slot"), F.array(F.lit(0).cast("bigint")).alias("times")).limit(0)
    return {**increments(batch, totals, times, skew), "sums": covariance_sums(batch)}

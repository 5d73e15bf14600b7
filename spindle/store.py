"""The power table as a sequence of snapshots, with the reference and the statistics kept up under adds.

Layout of a store's folder::

    _versions/00000000000000000007.json   what version 7 consists of
    power/add=<id>/rat=/dt=/channel=/     power rows of one add
    sums/add=<id>/                        (time, frequency, s, c): what the add changes of the sums behind the reference
    moments/add=<id>/, bins/add=<id>/     statistics of every series in the time bins that the add touched, and those bins
    state/<id>/                           what a stream needs to go on

An add writes folders of its own and becomes visible with its version file, which is made under another name and renamed: of two writers
of one version one fails, looks at the other's version and derives its changes anew. A reader holds one version, so it
sees an add wholly or not at all, and an add that was killed leaves only folders that nobody reads (:meth:`PowerStore.vacuum`).

Adding a series that is there replaces it (``how="replace"``: its rows are taken out of the earlier add, and their sums are subtracted) or
continues it (``how="extend"``). Either way only the times of the add are read and written:

* reference: the mean per (time, frequency) is the quotient of the summed deltas;
* statistics: count, mean and squared deviations per (series, frequency, time bin) of the average-referenced rows. A changed
  reference changes every series of the bin, so the touched bins are made anew from the table and replace the older ones; a group's
  statistics merge its bins.
"""

from __future__ import annotations

import json
import time as clock
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.config import DEFAULT, SERIES_KEYS
from spindle.operators.intervals import coarse_ranges, in_ranges
from spindle.schemas import POWER_TABLE
from spindle.sinks import write_power

KEYS = list(SERIES_KEYS)
SUMS = "time bigint, frequency int, s double, c bigint"
MOMENTS = "rat string, dt string, channel string, frequency int, bin bigint, n bigint, mean double, m2 double"


class Conflict(RuntimeError):
    """Another writer made the version first."""


class _Files:
    """The few file operations of a store, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of a folder's entries; none if there is no folder."""
        p = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> None:
        """Make a file with its whole text at once; :class:`Conflict` if it is there."""
        draft = self.path(f"{p}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        to = self.path(p)
        qualified = self.fs.makeQualified(to)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf).rename(
                self.fs.makeQualified(draft), qualified, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(to):
                raise Conflict(p) from e
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class Snapshot:
    """One version of a store. Its frames read the folders of that version only, whatever is added later."""

    def __init__(self, store: "PowerStore", manifest: dict):
        self.store, self.spark, self.manifest = store, store.spark, manifest
        self.version, self.bin_width = manifest["version"], manifest["bin_width"]

    def _folders(self, kind: str) -> list[str]:
        return [f"{self.store.path}/{kind}/add={a}" for a in self.manifest[kind]]

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = self._folders(kind)
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, add string")
        return self.spark.read.schema(f"{schema}, add string").option("basePath", f"{self.store.path}/{kind}").parquet(*folders)

    def _rows(self) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POWER_TABLE.fields)
        return self._read("power", schema)

    def _dropped(self, which: list[list[str]]) -> Column:
        """Whether a row belongs to one of the (add, series) pairs: a condition on folder names, settled before files are read."""
        by_add: dict[str, list[Column]] = {}
        for a, *series in which:
            by_add.setdefault(a, []).append(reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in zip(KEYS, series))))
        return reduce(Column.__or__, ((F.col("add") == a) & reduce(Column.__or__, conds) for a, conds in by_add.items()), F.lit(False))

    def power(self, only: Column | None = None) -> DataFrame:
        """All power rows; ``only`` on rat, dt and channel prunes folders."""
        rows = self._rows()
        if self.manifest["dropped"]:
            rows = rows.where(~self._dropped(self.manifest["dropped"]))
        return (rows if only is None else rows.where(only)).select(*POWER_TABLE.fieldNames())

    def sums(self) -> DataFrame:
        return self._read("sums", SUMS).drop("add")

    def means(self, times: Column | None = None) -> DataFrame:
        """(time, frequency, convolution): the common reference, from the sums alone."""
        sums = self.sums() if times is None else self.sums().where(times)
        total = sums.groupBy("time", "frequency").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        return total.where("c > 0").select("time", "frequency", (F.col("s") / F.col("c")).alias("convolution"))

    def referenced(self, only: Column | None = None, times: Column | None = None) -> DataFrame:
        """Average-referenced rows, of the series and times asked for."""
        rows = self.power(only)
        keys = (rows if times is None else rows.where(times)).select(*KEYS, "time", "frequency").distinct()
        return keys.join(self.means(times), ["time", "frequency"], "left").select("rat", "frequency", "channel", "dt", "convolution", "time")

    def _moments(self) -> DataFrame:
        """The moments of each bin as of the last add that touched it."""
        order = self.spark.createDataFrame([(a, i) for i, a in enumerate(self.manifest["bins"])], "add string, seq int")
        bins = self._read("bins", "bin bigint").join(F.broadcast(order), "add")
        latest = bins.groupBy("bin").agg(F.max_by("add", "seq").alias("add"))
        return self._read("moments", MOMENTS).join(latest, ["bin", "add"]).drop("add")

    def group_stats(self) -> DataFrame:
        """(rat, dt, channel, frequency, mean, sd), as ``group_stats`` over all referenced rows."""
        parts = self._moments()
        whole = parts.groupBy(*KEYS, "frequency").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean"))).alias("_s"))
        apart = F.col("mean") - F.col("_s") / F.col("_n")
        return (parts.join(whole, [*KEYS, "frequency"]).groupBy(*KEYS, "frequency")
                .agg((F.max("_s") / F.max("_n")).cast("float").alias("mean"),
                     F.sqrt(F.sum(F.col("m2") + F.col("n") * apart * apart) / F.max("_n")).cast("float").alias("sd")))

    def bounds(self) -> tuple[int, int] | None:
        """A time range that holds all rows (whole bins)."""
        r = self._read("bins", "bin bigint").agg(F.min("bin"), F.max("bin")).first()
        return None if r[0] is None else (r[0] * self.bin_width, (r[1] + 1) * self.bin_width - 1)

    def has(self, token: tuple[str, int] | None) -> bool:
        return token is not None and self.manifest["tokens"].get(token[0], -1) >= token[1]

    def of(self, series: list[list[str]]) -> list[list[str]]:
        """(add, series) of those of the series that are in the table."""
        own = {tuple(s) for s in series}
        return [e for e in self.manifest["series"] if tuple(e[1:]) in own]

    def state(self, schema) -> DataFrame:
        """What the last add with a state left."""
        name = self.manifest.get("state")
        return self.spark.read.schema(schema).parquet(f"{self.store.path}/state/{name}") if name else self.spark.createDataFrame([], schema)


class PowerStore:
    """A store at ``path``; made when the first version is written. ``bin_width``: time width of the statistics' bins."""

    def __init__(self, spark: SparkSession, path: str, bin_width: int = 10_000, records_per_file: int = DEFAULT.records_per_file):
        self.spark, self.path = spark, path.rstrip("/")
        self.bin_width, self.records_per_file = bin_width, records_per_file
        self.files = _Files(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.names(f"{self.path}/_versions") if n.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/_versions/{version:020d}.json"

    def snapshot(self, version: int | None = None) -> Snapshot:
        known = self.versions() if version is None else [version]
        if not known:
            return Snapshot(self, {"version": 0, "bin_width": self.bin_width, "power": [], "sums": [], "moments": [], "bins": [],
                                   "dropped": [], "series": [], "tokens": {}, "state": None})
        return Snapshot(self, json.loads(self.files.read(self._file(known[-1]))))

    def _commit(self, manifest: dict) -> None:
        self.files.create(self._file(manifest["version"]), json.dumps(manifest))

    def add(self, power: DataFrame, how: str = "replace", token: tuple[str, int] | None = None,
            state: Callable[[Snapshot], DataFrame] | None = None, based_on: Snapshot | None = None, tries: int = 20) -> int:
        """Add power rows; returns the version that has them. Writers of the same store at the same time are both added, one
        after the other.

        ``token`` (writer, number): a number that the writer has already added, or an older one, adds nothing (a stream's batch done twice).
        ``state`` makes the state to keep from the version it follows. ``based_on``: the version the rows were made from;
        :class:`Conflict` if one of their series has changed since."""
        if how not in ("replace", "extend"):
            raise ValueError(f"how: {how}")
        add = uuid.uuid4().hex
        if self.snapshot().has(token):
            return self.snapshot().version
        write_power(power, f"{self.path}/power/add={add}", "errorifexists", self.records_per_file)
        mine = self.spark.read.schema(POWER_TABLE).parquet(f"{self.path}/power/add={add}")
        series = sorted([list(r) for r in mine.select(*KEYS).distinct().collect()])  # a row per recording of this add
        for _ in range(tries):
            snap = self.snapshot()
            if snap.has(token):
                return snap.version
            if based_on is not None and snap.of(series) != based_on.of(series):
                raise Conflict(f"{self.path}: a series has changed since version {based_on.version}")
            try:
                return self._derive(snap, add, mine, series, how, token, state)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} other versions came first")

    def _derive(self, snap: Snapshot, add: str, mine: DataFrame, series: list, how: str, token, state) -> int:
        out = snap.of(series) if how == "replace" else []
        name = f"{add}-{snap.version + 1}"  # the derived folders of this attempt
        manifest = {**snap.manifest, "version": snap.version + 1, "power": [*snap.manifest["power"], add],
                    "dropped": [*snap.manifest["dropped"], *out],
                    "series": [e for e in snap.manifest["series"] if e not in out] + [[add, *s] for s in series],
                    **{k: [*snap.manifest[k], name] for k in ("sums", "moments", "bins")}}
        if token:
            manifest["tokens"] = {**snap.manifest["tokens"], token[0]: token[1]}
        if state is not None:
            state(snap).write.mode("errorifexists").parquet(f"{self.path}/state/{name}")
            manifest["state"] = name
        self._sums(snap, mine, out, name)
        self._bins(Snapshot(self, manifest), name)
        self._commit(manifest)
        return manifest["version"]

    def _sums(self, snap: Snapshot, mine: DataFrame, out: list, name: str) -> None:
        """The signed change of the sums per (time, frequency): the add's rows, less those it replaces."""
        def summed(rows: DataFrame, sign: int) -> DataFrame:
            return rows.groupBy("time", "frequency").agg((F.coalesce(F.sum("convolution"), F.lit(0.0)) * sign).cast("double").alias("s"),
                                                         (F.count("convolution") * sign).alias("c"))

        delta = summed(mine, 1)
        if out:
            delta = delta.unionByName(summed(snap._rows().where(snap._dropped(out)), -1))
            delta = delta.groupBy("time", "frequency").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        # rows that change nothing stay: their times were touched, and the bins are read off this table
        delta.select("time", "frequency", "s", "c").sortWithinPartitions("time").write.mode("errorifexists").parquet(
            f"{self.path}/sums/add={name}")

    def _bins(self, after: Snapshot, name: str) -> None:
        """Statistics of all series in the time bins of the last change, from the table as it is after it."""
        w = after.bin_width
        number = F.floor(F.col("time") / F.lit(w)).alias("bin")
        bins = self.spark.read.schema(SUMS).parquet(f"{self.path}/sums/add={name}").select(number).distinct()
        bins.write.mode("errorifexists").parquet(f"{self.path}/bins/add={name}")
        bins = self.spark.read.schema("bin bigint").parquet(f"{self.path}/bins/add={name}")
        edge = bins.agg(F.min("bin"), F.max("bin")).first()
        times = F.lit(False)
        if edge[0] is not None:
            spans = bins.select((F.col("bin") * w).alias("lo"), (F.col("bin") * w + (w - 1)).alias("hi"))
            times = in_ranges(F.col("time"), coarse_ranges(spans, (edge[0] * w, (edge[1] + 1) * w - 1)))
        rows = after.referenced(times=times).withColumn("bin", F.floor(F.col("time") / F.lit(w))).join(bins, "bin", "left_semi")
        (rows.where("convolution IS NOT NULL").groupBy(*KEYS, "frequency", "bin")
         .agg(F.count("convolution").alias("n"), F.avg("convolution").alias("mean"),
              (F.var_pop("convolution") * F.count("convolution")).alias("m2"))
         .select("rat", "dt", "channel", "frequency", "bin", "n", "mean", "m2")
         .write.mode("errorifexists").parquet(f"{self.path}/moments/add={name}"))

    def compact(self) -> int:
        """One add instead of many, same content: power in time order per series, folded sums, current moments. :class:`Conflict` if another
        version came meanwhile (nothing is lost, call again)."""
        snap = self.snapshot()
        add = uuid.uuid4().hex
        power = snap.power().repartitionByRange(*KEYS, "time").sortWithinPartitions(*KEYS, "time")
        write_power(power, f"{self.path}/power/add={add}", "errorifexists", self.records_per_file)
        sums = snap.sums().groupBy("time", "frequency").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0")
        sums.repartitionByRange("time").sortWithinPartitions("time").write.mode("errorifexists").parquet(f"{self.path}/sums/add={add}")
        snap._moments().select("rat", "dt", "channel", "frequency", "bin", "n", "mean", "m2").write.mode("errorifexists").parquet(
            f"{self.path}/moments/add={add}")
        snap._read("bins", "bin bigint").select("bin").distinct().write.mode("errorifexists").parquet(f"{self.path}/bins/add={add}")
        series = sorted({tuple(s) for _, *s in snap.manifest["series"]})
        manifest = {**snap.manifest, "version": snap.version + 1, "dropped": [], "series": [[add, *s] for s in series],
                    **{k: [add] for k in ("power", "sums", "moments", "bins")}}
        self._commit(manifest)
        return manifest["version"]

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400.0) -> int:
        """Delete folders that none of the last ``keep`` versions has and that have not changed for ``older_than_s`` (longer than any
        add or reader runs), and the older versions' files. Returns the number of folders."""
        known = self.versions()
        kept = [self.snapshot(v).manifest for v in known[-keep:]]
        limit, gone = (clock.time() - older_than_s) * 1000, 0
        for kind in ("power", "sums", "moments", "bins"):
            used = {a for m in kept for a in m[kind]}
            for n, changed in self.files.names(f"{self.path}/{kind}"):
                if n.removeprefix("add=") not in used and changed <= limit:
                    self.files.delete(f"{self.path}/{kind}/{n}")
                    gone += 1
        used = {m["state"] for m in kept}
        for n, changed in self.files.names(f"{self.path}/state"):
            if n not in used and changed <= limit:
                self.files.delete(f"{self.path}/state/{n}")
                gone += 1
        for v in known[:-keep]:
            self.files.delete(self._file(v))
        return gone

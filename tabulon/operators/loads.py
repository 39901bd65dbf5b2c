"""Dataset loads: replace, append, keyed merge, history, versions, rollback, pulls, compaction.

A dataset is a folder of immutable versions. The ledger, a table of events with
one or two rows a load, names the current one: the version of the newest load
that succeeded and was not rolled back. A load writes its version first and its
ledger row last, so a job that dies leaves nothing that counts; the row of a
pull commits version and cursor together. One writer per dataset.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators import contract as C
from tabulon.operators import relational as R
from tabulon.sources import files

LEDGER = (
    "load_id string, dataset string, mode string, status string, version string, parent string, created_at timestamp, recorded_at timestamp, counts map<string,bigint>, "
    "checks string, keys array<string>, source string, cursor_from string, cursor string"
)
#: Loads that reached the lake; their rows stand in a version, in the quarantine or did both.
LANDED = ("succeeded", "quarantined", "rolled_back")


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def load_replace(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return incoming


def load_append(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``current`` and the incoming rows that it lacks by row hash."""
    return current.unionByName(R.append_dedup(incoming, current), allowMissingColumns=True)


def load_merge(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with rows of known keys replaced where they changed, and new keys added."""
    changed = R.classify_merge(incoming, current, keys).filter("__change <> 'unchanged'").drop("__change")
    kept = current.join(changed.select(*keys).distinct(), _on(current, changed, keys), "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def history_rows(incoming: DataFrame, current: DataFrame, keys: list[str], moment: Column) -> DataFrame:
    """Inserts and updates stamped with the time from which they hold."""
    return R.classify_merge(incoming, current, keys).filter("__change <> 'unchanged'").withColumn("__valid_from", moment)


def append_history(history: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows if history is None else history.unionByName(rows, allowMissingColumns=True)


def load_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.col("__change").alias("change")).agg(F.count(F.lit(1)).alias("rows"))


def quarantine(rejected: DataFrame, reason: str, path: str) -> None:
    rejected.withColumn("__reason", F.lit(reason)).write.mode("append").parquet(path)


class Lake:
    """Versioned datasets under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ledger(self) -> DataFrame:
        path = f"{self.root}/_ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if self._exists(path) else self.spark.createDataFrame([], LEDGER)

    def _record(self, **row: object) -> None:
        names = [f.split()[0] for f in LEDGER.split(", ")]
        schema = ", ".join(f for f in LEDGER.split(", ") if f.split()[0] not in ("created_at", "recorded_at"))
        cells = {n: row.get(n, {} if n == "counts" else None) for n in names if n not in ("created_at", "recorded_at")}
        one = self.spark.createDataFrame([tuple(cells.values())], schema)
        begun = F.lit(row["created_at"]).cast("timestamp") if row.get("created_at") else F.current_timestamp()
        one.withColumn("created_at", begun).withColumn("recorded_at", F.current_timestamp()).select(*names).write.mode("append").parquet(f"{self.root}/_ledger")

    def loads(self, dataset: str | None = None) -> DataFrame:
        """One row a load: its newest event."""
        rows = self.ledger().filter(F.col("dataset") == dataset) if dataset else self.ledger()
        newest = rows.groupBy("dataset", "load_id").agg(F.max_by(F.struct(*rows.columns), F.struct("recorded_at", F.col("status") != "started")).alias("row"))
        return newest.select("row.*")

    def _newest(self, dataset: str, condition: Column) -> Row | None:
        return self.loads(dataset).filter(condition).orderBy(F.desc("created_at"), F.desc("load_id")).first()

    def _last(self, dataset: str) -> Row | None:
        """The load whose version is current."""
        return self._newest(dataset, (F.col("status") == "succeeded") & F.col("version").isNotNull())

    def current(self, dataset: str) -> DataFrame | None:
        last = self._last(dataset)
        return self.spark.read.parquet(last["version"]) if last else None

    def history(self, dataset: str) -> DataFrame | None:
        path = f"{self.root}/{dataset}/_history"
        return self.spark.read.option("mergeSchema", True).parquet(path) if self._exists(path) else None

    def run_load(self, dataset: str, raw: DataFrame, mode: str, load_id: str, keys: list[str] | None = None, history: bool = False, samples: list[dict] | None = None, **state: str | None) -> str:
        """One load of raw text rows: contract, gate, typed rows, new version, ledger row. Returns its status.

        Rows with ``_corrupt`` set are malformed: they are counted for the gate and
        left out; ``samples`` (file, line, fields) go to the ledger with the checks.
        ``state`` (source, cursor_from, cursor) is committed by the same ledger row.
        Raw rows are read twice: by the type probe, and to stage them beside their
        typed values, which gate, version and history are read from. Running the
        same ``load_id`` again does nothing.
        """
        keys = keys or []
        if mode not in ("replace", "append", "merge"):
            raise ValueError(f"unknown mode {mode!r}")
        done = self.loads(dataset).filter((F.col("load_id") == load_id) & (F.col("status") != "started")).first()
        if done:
            return done["status"]
        last, current = self._last(dataset), self.current(dataset)
        base = {"load_id": load_id, "dataset": dataset, "mode": mode, "keys": keys, "parent": last["version"] if last else None, **state}
        marked = "_corrupt" in raw.columns
        good = raw.filter("_corrupt is null").drop("_corrupt") if marked else raw
        shape = C.infer_contract(good)
        if current is not None and mode != "replace":
            stored = [C.ContractColumn(n, next(k for k, v in C.SPARK_TYPE.items() if v == t)) for n, t in current.dtypes if not n.startswith("__")]
            try:
                shape = C.evolve_contract(stored, shape)
            except ValueError as e:
                return self._reject(base, raw, str(e))
        staging = f"{self.root}/{dataset}/_staging/{load_id}"
        typed = C.typed_rows(good, shape, load_id, keep="__raw")
        if marked:
            bad = raw.filter("_corrupt is not null").select(F.struct(*[F.col(f"`{c}`") for c in good.columns]).alias("__raw"), "_corrupt")
            typed = typed.withColumn("_corrupt", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
        typed.write.option("compression", "zstd").mode("overwrite").parquet(staging)
        staged = self.spark.read.schema(typed.schema).parquet(staging)
        malformed = staged.filter("_corrupt is not null").count() if marked else 0
        staged = staged.filter("_corrupt is null").drop("_corrupt") if marked else staged
        present = [c for c in shape if c.name in good.columns]
        checks = [r.asDict() for r in C.quality_gate(staged.select("__raw.*"), present, keys, malformed).collect()]  # seven rows
        found = json.dumps({"checks": checks, "malformed_samples": samples or []})
        try:
            if any(c["severity"] == "fail" and not c["passed"] for c in checks):
                return self._reject(base, raw, found)
            return self._curate(base | {"checks": found}, staged.drop("__raw"), current, shape, history, malformed)
        finally:
            self._remove(staging)

    def _curate(self, base: dict, incoming: DataFrame, current: DataFrame | None, shape: list[C.ContractColumn], history: bool, malformed: int) -> str:
        """Write the new version of a batch that passed its gate, and commit it."""
        dataset, mode, keys = base["dataset"], base["mode"], base["keys"]
        version, counts = f"{self.root}/{dataset}/v-{base['load_id']}", {}
        if current is not None and mode != "replace":
            # A contract that grew changes every row's hash; compare on equal terms.
            aligned = R.align_to_schema(current, [(c.name, C.SPARK_TYPE[c.kind]) for c in shape] + [("__load_id", "string"), ("__loaded_at", "timestamp")])
            current = aligned.withColumn("__row_hash", C.expr.row_hash(*[F.col(f"`{c.name}`") for c in shape]))
        if mode == "replace" or current is None:
            out, counts = incoming, {"inserted": incoming.count()}
            changes = incoming.withColumn("__change", F.lit("insert"))
        elif mode == "append":
            new = R.append_dedup(incoming, current)
            n = new.count()
            counts = {"inserted": n, "skipped": incoming.count() - n}
            out, changes = current.unionByName(new, allowMissingColumns=True), new.withColumn("__change", F.lit("insert"))
        else:
            classified = R.classify_merge(incoming, current, keys)
            counts = {r["change"]: r["rows"] for r in load_counts(classified).collect()}
            out, changes = load_merge(current, incoming, keys), classified.filter("__change <> 'unchanged'")
        counts["rejected"] = malformed
        if mode == "append" and current is not None and not counts["inserted"]:
            self._record(**base, status="succeeded", counts=counts)  # nothing new: no version
            return "succeeded"
        out.write.option("compression", "zstd").mode("overwrite").parquet(version)
        if history:
            changes.withColumn("__valid_from", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/{dataset}/_history")
        self._record(**base, status="succeeded", version=version, counts=counts)
        return "succeeded"

    def _reject(self, base: dict, raw: DataFrame, reason: str) -> str:
        quarantine(raw, reason, f"{self.root}/{base['dataset']}/_quarantine/{base['load_id']}")
        self._record(**base | {"checks": reason}, status="quarantined")
        return "quarantined"

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # ------------------------------------------------------------ files and pulls

    def load_files(self, dataset: str, paths: list[str], mode: str, load_id: str, keys: list[str] | None = None, history: bool = False) -> str:
        """Load delimited files of one shape: sniffed, read, malformed rows counted and sampled by file and line."""
        found = files.sniff_files(self.spark, paths).orderBy("path").first()
        how = (found["header"], found["delimiter"], found["encoding"])
        raw = files.read_delimited(self.spark, paths, *how)
        samples = [] if found["encoding"] == "utf-16" else [r.asDict() for r in files.malformed_lines(self.spark, paths, len(found["header"]), found["delimiter"]).orderBy("file", "line").limit(20).collect()]
        return self.run_load(dataset, raw, mode, load_id, keys, history, samples)

    def connector_state(self, dataset: str | None = None) -> DataFrame:
        """Per dataset and source: the cursor, and the last run with its status, load and rows."""
        rows = self.loads(dataset).filter("source is not null")
        by, landed = F.struct("created_at", "load_id"), F.col("status").isin(*LANDED)
        taken = F.aggregate(F.map_values(F.col("counts")), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return rows.groupBy("dataset", "source").agg(
            F.max_by(F.when(landed, F.col("cursor")), F.when(landed & F.col("cursor").isNotNull(), by)).alias("cursor"),
            F.count_if(F.col("status") != "started").alias("runs"),
            F.max_by("status", by).alias("last_status"),
            F.max_by("created_at", by).alias("last_run_at"),
            F.max_by(F.when(landed, F.col("load_id")), F.when(landed, by)).alias("last_load_id"),
            F.coalesce(F.max_by(F.when(landed, taken), F.when(landed, by)), F.lit(0)).alias("last_rows"),
        )

    def pull(self, dataset: str, source: str, rows: DataFrame, cursor: str | None, load_id: str, mode: str = "append", keys: list[str] | None = None, limit: int = 200_000, history: bool = False) -> str:
        """Load what ``rows`` holds beyond the source's stored cursor; ``empty`` if nothing is new.

        The range is recorded before the load starts. A pull that died is taken up
        by its load id and reads the same range, whatever the source has gained;
        another load id starts from the last cursor that landed. Cursors of
        quarantined and rolled back loads stay: their rows were taken.
        """
        known = self.loads(dataset).filter(F.col("load_id") == load_id).first()
        if known and known["status"] != "started":
            return known["status"]
        if known:
            first, last = known["cursor_from"], known["cursor"]
        else:
            state = self.connector_state(dataset).filter(F.col("source") == source).first()
            first, last = state["cursor"] if state else None, None
        if cursor is not None:
            kind = rows.schema[cursor].dataType
            typed = lambda text: F.lit(text).cast(kind)
            if not known:
                end = files.extract_incremental(rows, cursor, None if first is None else typed(first), limit)[1]
                last = end.select(F.col("cursor").cast("string")).first()[0]
                if last is None:
                    self._record(load_id=load_id, dataset=dataset, mode=mode, status="empty", source=source, cursor_from=first, cursor=first)
                    return "empty"
                self._record(load_id=load_id, dataset=dataset, mode=mode, status="started", source=source, cursor_from=first, cursor=last)
            within = F.col(cursor) <= typed(last)
            rows = rows.filter(within if first is None else within & (F.col(cursor) > typed(first)))
        elif not rows.limit(1).count():
            self._record(load_id=load_id, dataset=dataset, mode=mode, status="empty", source=source)
            return "empty"
        text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
        return self.run_load(dataset, text, mode, load_id, keys, history, source=source, cursor_from=first, cursor=last)

    # ------------------------------------------------------------ versions

    def snapshots(self, dataset: str) -> DataFrame:
        """Versions with parent, mode, load id and status; ``is_current`` marks the one that counts."""
        own = self.loads(dataset).filter(F.col("version").isNotNull())
        good = F.col("status") == "succeeded"
        now = own.agg(F.max_by(F.when(good, F.col("version")), F.when(good, F.struct("created_at", "load_id"))).alias("now"))
        return own.join(F.broadcast(now), F.lit(True)).select("version", "parent", "mode", "load_id", "status", "created_at", "counts", F.coalesce(F.col("version") == F.col("now"), F.lit(False)).alias("is_current"))

    def rollback(self, dataset: str, load_id: str) -> None:
        """Undo the newest successful load: it reads ``rolled_back`` from then on, and its parent is current again.

        Newer loads are rolled back first; a load that brought nothing new has no
        version to undo and is only marked.
        """
        last = self._newest(dataset, F.col("status") == "succeeded")
        if not last or last["load_id"] != load_id:
            raise ValueError("only the latest successful load can be rolled back")
        if not last["parent"]:
            raise ValueError("the first version has no parent")
        self._record(**{**last.asDict(), "status": "rolled_back"})

    def compact(self, dataset: str, load_id: str, target_mb: int = 128, min_files: int = 8) -> bool:
        """Rewrite a fragmented current version into files of about ``target_mb``."""
        last = self._last(dataset)
        files = self.spark.read.format("binaryFile").load(last["version"] + "/*.parquet").select("length")
        n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n < min_files:
            return False
        version = f"{self.root}/{dataset}/v-{load_id}"
        self.current(dataset).repartition(max(1, math.ceil(size / (target_mb << 20)))).write.option("compression", "zstd").parquet(version)
        self._record(load_id=load_id, dataset=dataset, mode="compact", status="succeeded", version=version, parent=last["version"])
        return True

    def expired(self, days: int = 30) -> DataFrame:
        """Versions that are neither current nor younger than ``days``."""
        good = F.col("status") == "succeeded"
        rank = F.row_number().over(Window.partitionBy("dataset").orderBy(good.desc(), F.desc("created_at"), F.desc("load_id")))
        known = self.loads().filter("version is not null").withColumn("rn", rank)
        live = known.filter((F.col("rn") == 1) & good).select("version")
        return known.filter(F.col("created_at") < F.current_timestamp() - F.expr(f"interval {days} days")).select("dataset", "version").distinct().join(live, "version", "left_anti")


def load_report(ledger: DataFrame, until: Column | None = None) -> DataFrame:
    """``metric, value`` over all loads.

    Rates are of finished loads (succeeded, quarantined or failed). Rows,
    durations, nearest-rank percentiles and throughput are of succeeded loads;
    rejected rows and raw bytes are of all. ``loads_24h`` counts the day before
    ``until``, by default now.
    """
    until = F.current_timestamp() if until is None else until
    ok = F.col("status") == "succeeded"
    kinds = ("succeeded", "quarantined", "failed", "rolled_back")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = ledger.agg(
        F.count(F.lit(1)).alias("loads_total"),
        F.count_if(F.col("created_at") >= until - F.expr("interval 1 day")).alias("loads_24h"),
        *[F.count_if(F.col("status") == k).alias(k) for k in kinds],
        F.count_if(~F.col("status").isin(*kinds)).alias("other_status"),
        total(F.when(ok, F.col("rows_out"))).alias("rows_loaded"),
        total("rows_rejected").alias("rows_rejected"),
        total("raw_bytes").alias("raw_bytes"),
        F.floor(F.avg(F.when(ok, F.coalesce("duration_ms", F.lit(0))))).alias("avg_ms"),
        F.max(F.when(ok, F.coalesce("duration_ms", F.lit(0)))).alias("max_ms"),
        F.round(F.try_divide(total(F.when(ok, F.col("rows_out"))) * 1000, F.sum(F.when(ok, F.col("duration_ms")))), 1).alias("rows_per_s"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("succeeded") + F.col("quarantined") + F.col("failed")), F.lit(0.0)), 4)
    s = s.withColumns({"quarantine_rate": rate("quarantined"), "failure_rate": rate("failed")})
    flat = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in s.columns])))
    done = ledger.filter(ok).select(F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))
    p = R.nearest_rank_percentile(done, "duration_ms", [0.5, 0.95]).select(F.concat(F.lit("p"), (F.col("share") * 100).cast("int").cast("string")).alias("metric"), F.col("value").cast("double").alias("value"))
    return flat.unionByName(p)


def loads_by_dataset(ledger: DataFrame) -> DataFrame:
    """Per dataset: loads by status, the last load, and the rows of the last one that succeeded."""
    ok, order = F.col("status") == "succeeded", F.struct("created_at", "load_id")
    last = lambda c: F.max_by(c, order)
    return ledger.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("loads"),
        *[F.count_if(F.col("status") == k).alias(k) for k in ("succeeded", "quarantined", "failed")],
        last("load_id").alias("last_load_id"),
        last("status").alias("last_status"),
        last("mode").alias("last_mode"),
        last("finished_at").alias("last_finished_at"),
        F.max_by(F.when(ok, F.col("rows_out")), F.when(ok, order)).alias("rows_current"),
        F.max_by(F.when(ok, F.col("quality_status")), F.when(ok, order)).alias("quality_status"),
    )


def recent_loads(ledger: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` loads."""
    return ledger.orderBy(F.desc("created_at"), F.desc("load_id")).limit(n)

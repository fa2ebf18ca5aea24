"""Operations as plans: preview, execute once, roll back, cancel; and the audit log."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLANS = "plan_id string, operation string, target string, impact long, destructive boolean, needs_confirm boolean, status string, backup string"
AUDIT = "time double, source string, tool string, duration_ms double, target string, ok boolean, error_code string, request_id string, changes_count long, output_bytes long"
#: Cells or replacements over which an operation asks for confirmation; operations that lose data.
RISKY_CELLS, RISKY_REPLACEMENTS = 500, 100
DESTRUCTIVE = ("delete_rows", "delete_columns", "delete_worksheet", "delete_slide", "delete_pdf_page", "delete_paragraph")


def needs_confirm(operation: Column, impact: Column) -> Column:
    """Destructive operations always, others by their impact."""
    return operation.isin(*DESTRUCTIVE) | F.when(operation == "find_and_replace", impact > RISKY_REPLACEMENTS).otherwise(impact > RISKY_CELLS)


def preview(operation: str, target: str, hits: DataFrame) -> DataFrame:
    """One plan row; hits: the rows that the same lazy operation would change, counted only."""
    plan_id = hashlib.sha256(f"{operation}\0{target}".encode()).hexdigest()[:12]
    n = hits.agg(F.count(F.lit(1)).alias("impact"))
    op = F.lit(operation)
    return n.select(F.lit(plan_id).alias("plan_id"), op.alias("operation"), F.lit(target).alias("target"), "impact", op.isin(*DESTRUCTIVE).alias("destructive"), needs_confirm(op, F.col("impact")).alias("needs_confirm"), F.lit("previewed").alias("status"))


def transition(plans: DataFrame, action: str, confirm: bool = False) -> DataFrame:
    """plans with the status after an action: execute runs once and asks for confirmation, cancel and rollback."""
    s = F.col("status")
    if action == "execute":
        new = F.when((s == "previewed") & (~F.col("needs_confirm") | F.lit(confirm)), "executed").otherwise(s)
    elif action == "cancel":
        new = F.when(s == "previewed", "cancelled").otherwise(s)
    elif action == "rollback":
        new = F.when(s == "executed", "rolled_back").otherwise(s)
    else:
        raise ValueError(f"no such action: {action}")
    return plans.withColumn("status", new)


class TableStore:
    """Versions of a table under a folder: staged, verified, then made current; older ones stay for rollback."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def commit(self, df: DataFrame, check=None) -> int:
        """Write aside, verify what was written, rename. A failed check leaves the current version."""
        staging = f"staging-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{staging}")
        if check is not None and not check(self.spark.read.parquet(f"{self.folder}/{staging}")):
            self._fs.delete(self._path(staging), True)
            raise ValueError("the staged table fails its check")
        version = (self.versions() or [0])[-1] + 1
        if not self._fs.rename(self._path(staging), self._path(f"v{version}")):
            raise RuntimeError("the version could not be made current")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version or self.versions()[-1]}")

    def rollback(self) -> int:
        """Drop the current version; the one before is current again."""
        own = self.versions()
        if len(own) < 2:
            raise ValueError("no version to go back to")
        self._fs.delete(self._path(f"v{own[-1]}"), True)
        return own[-2]


def write_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def audit_summary(events: DataFrame, tool: Column, ok: Column, duration: Column) -> DataFrame:
    """tool, calls, failures, total and longest duration."""
    e = events.select(tool.alias("tool"), ok.alias("ok"), duration.alias("d"))
    return e.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("d").alias("total_ms"), F.max("d").alias("longest_ms"))


def timed(spark: SparkSession, tool: str, target: str, run, log: Callable[[DataFrame], None] | None = None) -> tuple[object, DataFrame]:
    """Run a callable; its result and one audit row. The row goes to `log` too, also if the call fails; its error is raised again."""
    began, code = time.time(), None
    try:
        out = run()
    except Exception as e:
        code = type(e).__name__
        raise
    finally:
        row = [(began, "folioframe", tool, (time.time() - began) * 1000, target, code is None, code, uuid.uuid4().hex, None, None)]
        audit = spark.createDataFrame(row, AUDIT)
        if log is not None:
            log(audit)
    return out, audit


class PlanBook:
    """Plans over a TableStore: previewed, looked up, executed once, rolled back or cancelled.

    A plan is an operation (a function of the current table) with the count of rows it would change.
    Execution keeps the version it started from and a hash of it; a rollback goes ahead only if the
    kept version still has that hash.
    """

    def __init__(self, store: TableStore):
        self.store, self.plans = store, {}

    def preview(self, operation: str, target: str, hits: Callable[[DataFrame], DataFrame], run: Callable[[DataFrame], DataFrame]) -> dict:
        impact = hits(self.store.read()).count()
        asks = operation in DESTRUCTIVE or impact > (RISKY_REPLACEMENTS if operation == "find_and_replace" else RISKY_CELLS)
        plan = {"plan_id": uuid.uuid4().hex[:12], "operation": operation, "target": target, "impact": impact, "destructive": operation in DESTRUCTIVE, "needs_confirm": asks, "status": "previewed", "backup": None, "hash": None, "run": run}
        self.plans[plan["plan_id"]] = plan
        return self.status(plan["plan_id"])

    def status(self, plan_id: str) -> dict:
        """What is known of a plan; an unknown id raises."""
        if plan_id not in self.plans:
            raise KeyError(f"no such plan: {plan_id}")
        return {k: v for k, v in self.plans[plan_id].items() if k not in ("run", "hash")}

    def _hash(self, version: int) -> str:
        df = self.store.read(version)
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        return f"{row[0]}:{row[1]}"

    def execute(self, plan_id: str, confirm: bool = False) -> dict:
        plan = self.plans[self.status(plan_id)["plan_id"]]
        if plan["status"] != "previewed":
            raise ValueError(f"the plan is {plan['status']}")
        if plan["needs_confirm"] and not confirm:
            raise PermissionError("the plan needs confirmation")
        version = self.store.versions()[-1]
        plan["hash"] = self._hash(version)
        self.store.commit(plan["run"](self.store.read(version)))
        plan |= {"status": "executed", "backup": f"v{version}"}
        return self.status(plan_id)

    def rollback(self, plan_id: str) -> dict:
        plan = self.plans[self.status(plan_id)["plan_id"]]
        if plan["status"] != "executed":
            raise ValueError(f"the plan is {plan['status']}")
        version = int(plan["backup"][1:])
        if self.store.versions()[-1] != version + 1:
            raise ValueError("the table has changed since")
        if self._hash(version) != plan["hash"]:
            raise ValueError("the kept version is not what it was")
        self.store.rollback()
        plan["status"] = "rolled_back"
        return self.status(plan_id)

    def cancel(self, plan_id: str) -> dict:
        plan = self.plans[self.status(plan_id)["plan_id"]]
        if plan["status"] != "previewed":
            raise ValueError(f"the plan is {plan['status']}")
        plan["status"] = "cancelled"
        return self.status(plan_id)

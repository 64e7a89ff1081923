"""One cycle of the incremental sync: source tables in, stored copy brought up to date."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.errors import RULES_VERSION
from runlens.functions.payload import extract_errors
from runlens.functions.timegrid import ts
from runlens.operators import arrivals, care, queue, sync
from runlens.operators.scope import access_graph
from runlens.operators.upsert import ERROR_RULES, EXECUTION_RULES, different_rows, latest_by_key, upsert
from runlens.params import VOLUME_BUCKETS, VOLUME_STEP
from runlens.plans.volume import merged_cache, refreshed_cache, rolling_origin
from runlens.schemas import FAILED_STATUSES, OPEN_STATUSES, conform, present_columns
from runlens.session import shared_dir, use_utc
from runlens.sources.readers import payloads_for, source_executions, source_workflows
from runlens.sources.store import BlockTable, VersionedTable, stored_bytes

log = logging.getLogger(__name__)

VERSION_KEY, BACKFILL_KEY, HIGH_KEY = "classifier_version", "backfill_cursor", "high_water"
AUDIT_KEY, ACTIVE_KEY, RECOUNT_KEY = "gap_audit", "active_ids", "volume_recount"


@dataclass
class Source:
    """Tables of the system that runs the workflows."""

    workflows: DataFrame
    executions: DataFrame
    payloads: DataFrame
    shared_workflow: DataFrame | None = None
    project: DataFrame | None = None
    project_relation: DataFrame | None = None


@dataclass
class Options:
    load_since: dt.datetime | None = None
    grace: dt.timedelta = sync.MISSING_GRACE
    payload_cap: int | None = None
    batch_limit: int | None = None
    keep_runs: int | None = None
    # Ids that stay away for so long are asked for in audits alone.
    gap_patience: dt.timedelta = dt.timedelta(days=1)
    audit_every: dt.timedelta = dt.timedelta(days=1)
    input_days: object = care.INPUT_RETENTION_DAYS
    stack_days: object = care.STACK_RETENTION_DAYS
    block_size: int = 10_000_000


class Replica:
    """The stored copy under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, block_size: int = 10_000_000):
        self.spark, self.root = use_utc(spark), root
        self.executions = BlockTable(spark, f"{root}/executions", schemas.EXECUTION, block_size)
        self.errors = BlockTable(spark, f"{root}/errors", schemas.ERROR, block_size)
        small = {
            "workflows": schemas.WORKFLOW, "workflow_settings": schemas.WORKFLOW_SETTINGS,
            "volume": schemas.VOLUME, "project": schemas.PROJECT,
            "project_relation": schemas.PROJECT_RELATION, "shared_workflow": schemas.SHARED_WORKFLOW,
            "settings": schemas.SETTINGS, "sync_runs": schemas.SYNC_RUN, "open_blocks": schemas.OPEN_BLOCK, "active": schemas.ACTIVE,
        }
        self.known: dict[str, str] | None = None  # a handful of settings, read once in a cycle
        self.small = {name: VersionedTable(spark, f"{root}/{name}", schema) for name, schema in small.items()}

    def __getitem__(self, name: str) -> VersionedTable:
        return self.small[name]

    def setting(self, key: str) -> str | None:
        if self.known is None:
            self.known = {r["key"]: r["value"] for r in self["settings"].read().collect()}
        return self.known.get(key)

    def put_setting(self, key: str, value: str) -> None:
        if self.setting(key) != value:
            entry = self.spark.createDataFrame([(key, value)], schemas.SETTINGS)
            self["settings"].replace(upsert(self["settings"].read(), entry, "key"))
            self.known[key] = value


@dataclass
class CycleResult:
    status: str = "ok"
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def run_cycle(replica: Replica, source: Source, as_of: dt.datetime,
              options: Options | None = None) -> CycleResult:
    """One pass. Every table is written after everything that goes into it is known,
    and only where rows differ, so a pass that fails leaves each table as it was or as it
    should be, the next pass carries on, and a pass without news writes nothing. The run
    itself is always recorded."""
    options = options or Options()
    shared_dir(replica.spark)
    replica.known = None
    started = dt.datetime.now(dt.timezone.utc)
    result = CycleResult()
    try:
        _copy_workflows(replica, source, result)
        _copy_access(replica, source)
        before, after = _copy_executions(replica, source, as_of, options, result)
        _refresh_volume(replica, before, after, as_of)
        _reclassify(replica, result)
        _expire(replica, as_of, options, result)
        _backfill(replica, source, result)
    except Exception as failure:  # recorded, not raised: the next cycle retries
        log.exception("sync cycle failed")
        result.status, result.error = "failed", str(failure)
    _record(replica, started, options, result)
    return result


def _copy_workflows(replica: Replica, source: Source, result: CycleResult) -> None:
    """Workflows are merged and never deleted."""
    table = replica["workflows"]
    table.put(upsert(table.read(), source_workflows(source.workflows), "id"))
    result.counts["workflows"] = table.read().count()


def _copy_access(replica: Replica, source: Source) -> None:
    """Membership is replaced as a whole, because a revoked right shows as a missing
    row. If it cannot be read, the copy of the last cycle stays."""
    if source.shared_workflow is None:
        return
    try:
        graph = access_graph(source.project, source.project_relation, source.shared_workflow)
        for name, table in (graph or {}).items():
            replica[name].put(table)
    except Exception:
        log.exception("access graph not refreshed")


def _copy_executions(replica: Replica, source: Source, as_of: dt.datetime, options: Options,
                     result: CycleResult) -> tuple[DataFrame, DataFrame]:
    """Refresh open rows, fetch new ones, queue failures and work the queue.

    All of it happens on a working set, the rows that are open or pending and the
    ones just fetched; what differs afterwards is written back, and returned as it was
    and as it is. The ids of open and pending rows are a small table, so the working set
    is read from their blocks alone. Ids below the high-water mark that never arrived
    are kept as bitmaps and asked for again. Open blocks and active ids are noted before
    the rows are written and shortened after it: a crash in between only asks again.
    """
    incoming = source_executions(source.executions)
    mark = _high_water(replica, incoming, as_of)
    audit = _audit_due(replica, as_of, options)
    known = replica["open_blocks"].read()
    if mark is None:
        fetched = sync.initial_load(incoming, options.load_since)
    else:
        fetched = sync.incremental(incoming, mark, arrivals.asked(known, as_of, options.gap_patience, audit))
    fetched = latest_by_key(fetched.drop("deleted_at"), "id", ["stopped_at", "started_at"]).checkpoint()
    blocks = _note_blocks(replica, fetched, mark)
    working = _working(replica).checkpoint()

    refreshed = sync.refresh_open(working, sync.lookup(incoming, sync.open_rows(working)), as_of,
                                  grace=options.grace)
    marked = sync.detect_changes(fetched, working).checkpoint()
    changed_open = refreshed.filter(F.col("status").isin(FAILED_STATUSES))
    failed = sync.failed_ids(changed_open, marked.filter("needs_analytics")).checkpoint()

    merged = upsert(upsert(working, refreshed, "id"), fetched, "id", EXECUTION_RULES)
    queued = queue.enqueue(merged, failed).checkpoint()

    due = queue.due(queued, as_of, options.batch_limit).checkpoint()
    read = payloads_for(source.payloads, incoming, due, options.payload_cap).checkpoint()
    errors = extract_errors(read, ts(as_of)).checkpoint()
    results = queue.outcomes(due, read, errors).checkpoint()
    settled = conform(queue.settle(queued, results, as_of), schemas.EXECUTION).checkpoint()
    changed = different_rows(working, settled).checkpoint()
    active = settled.filter(_is_active()).select("id")

    before = replica.executions.of_ids(changed).checkpoint()
    if not changed.isEmpty():
        replica["active"].put(replica["active"].read().union(active).distinct())
        # Still set from a cycle that was cut off: what that one changed is counted nowhere.
        replica.put_setting(RECOUNT_KEY, "yes" if replica.setting(RECOUNT_KEY) in (None, "no") else "again")
        if not errors.isEmpty():
            replica.errors.upsert(errors, ERROR_RULES)
        replica.executions.upsert(changed)
    replica["active"].put(active)
    replica.put_setting(ACTIVE_KEY, "yes")
    top = fetched.agg(F.max("id")).first()[0]
    if top is not None or mark is not None:
        replica.put_setting(HIGH_KEY, str(max(x for x in (top, mark) if x is not None)))
    if top is not None:
        replica["open_blocks"].put(arrivals.arrived(blocks, fetched, as_of))
    if audit:
        replica.put_setting(AUDIT_KEY, as_of.isoformat())

    tally = results.agg(
        F.count_if(F.col("outcome") == queue.DONE).alias("done"),
        F.count_if(F.col("outcome").isin(queue.VANISHED, queue.OVERSIZED)).alias("failed")).first()
    seen = marked.agg(F.count_if("is_changed").alias("changed"), F.count("*").alias("read")).first()
    result.counts.update(
        executions=seen["changed"], rows_read=seen["read"], errors=failed.count(),
        analytics_done=tally["done"], analytics_failed=tally["failed"],
        analytics_queued=settled.filter("analytics_status = 'pending'").count())
    return before, changed


def _is_active():
    return F.col("status").isin(OPEN_STATUSES) | F.coalesce(F.col("analytics_status") == "pending", F.lit(False))


def _working(replica: Replica) -> DataFrame:
    """Open and pending rows. A copy that was filled otherwise is searched once."""
    if replica.setting(ACTIVE_KEY) is None:
        return replica.executions.read().filter(_is_active())
    return replica.executions.of_ids(replica["active"].read())


def _high_water(replica: Replica, incoming: DataFrame, as_of: dt.datetime) -> int | None:
    """The greatest id that a cycle has fetched, never above the source's own maximum.

    A copy that was filled otherwise takes its greatest id, and everything missing below it is open.
    """
    noted = replica.setting(HIGH_KEY)
    if noted is not None:
        last = incoming.agg(F.max("id")).first()[0]
        return int(noted) if last is None else min(int(noted), last)
    stored = replica.executions.read()
    mark = sync.high_water(stored, incoming).first()["high_water"]
    if mark is not None:
        low = stored.agg(F.min("id")).first()[0]
        replica["open_blocks"].put(arrivals.arrived(arrivals.blocks(replica.spark, low, mark), stored, as_of))
    return mark


def _audit_due(replica: Replica, as_of: dt.datetime, options: Options) -> bool:
    last = replica.setting(AUDIT_KEY)
    return last is None or dt.datetime.fromisoformat(last) <= as_of - options.audit_every


def _note_blocks(replica: Replica, fetched: DataFrame, mark: int | None) -> DataFrame:
    """Open blocks of ids before this cycle, and those its new rows reach into."""
    low, high = fetched.agg(F.min("id"), F.max("id")).first()
    begin = low if mark is None else mark + 1
    if high is not None and high >= begin:
        replica["open_blocks"].put(replica["open_blocks"].read().union(arrivals.blocks(replica.spark, begin, high)).dropDuplicates(["bucket", "low", "high"]))
    return replica["open_blocks"].read()


def _refresh_volume(replica: Replica, before: DataFrame, after: DataFrame, as_of: dt.datetime) -> None:
    """The cache takes over what changed. It is counted anew only at first, after a cycle that did not get this far,
    and while rows start later than the window ends."""
    table = replica["volume"]
    cache = table.read()
    pending = replica.setting(RECOUNT_KEY)
    end = rolling_origin(as_of) + VOLUME_BUCKETS * VOLUME_STEP
    fresh = not after.isEmpty()
    if cache.isEmpty() or pending == "again" or (pending == "yes" and not fresh):
        table.put(refreshed_cache(replica.executions.read(), cache, as_of))
        ahead = not replica.executions.read().filter(F.col("started_at") >= ts(end)).isEmpty()
    else:
        table.put(merged_cache(cache, before, after, as_of))
        ahead = fresh and not after.filter(F.col("started_at") >= ts(end)).isEmpty()
    replica.put_setting(RECOUNT_KEY, "again" if ahead else "no")


def _reclassify(replica: Replica, result: CycleResult) -> None:
    """Bring stored errors in line once when the rules changed. The version is
    stamped after the rows, so a crash in between repeats harmless work."""
    changes = care.reclassify(replica.errors.read(), int(replica.setting(VERSION_KEY) or 0), RULES_VERSION)
    result.counts["reclassified"] = 0
    if changes is None:
        return
    changes = changes.select("id", "error_message", "error_type", "error_category").checkpoint()
    replica.errors.upsert(changes)
    replica.put_setting(VERSION_KEY, str(RULES_VERSION))
    result.counts["reclassified"] = changes.count()


def _expire(replica: Replica, as_of: dt.datetime, options: Options, result: CycleResult) -> None:
    """Retention. Only rows that lose something are rewritten."""
    stored = replica.errors.read()
    counts = care.expired_counts(stored, as_of, options.input_days, options.stack_days).first()
    result.counts.update(purged_input=counts["purged_input"], purged_stack=counts["purged_stack"])
    if counts["purged_input"] or counts["purged_stack"]:
        touched = stored.filter(care.is_expiring(as_of, options.input_days, options.stack_days))
        cleared = care.expire_detail(touched, as_of, options.input_days, options.stack_days)
        replica.errors.upsert(cleared.select("id", "input_data", "error_stack").checkpoint())


def _backfill(replica: Replica, source: Source, result: CycleResult) -> None:
    """Columns added to the copy later, filled once for rows the source still has.

    One block of ids after another, from the last to the first as new rows are most asked for; the number of the
    last finished block is stored, so a walk that is cut off goes on from there.
    """
    columns = present_columns(source.executions, schemas.EXECUTION_OPTIONAL)
    result.counts["backfilled"] = 0
    cursor = replica.setting(BACKFILL_KEY)
    if "mode" not in columns or cursor == "done":
        return
    table = replica.executions
    for number in reversed(table.blocks()):
        if cursor is not None and number >= int(cursor):
            continue
        pending = table.block(number).filter(F.col("mode").isNull()).select("id")
        within = F.col("id").between(number * table.block_size, (number + 1) * table.block_size - 1)
        filled = source_executions(source.executions).filter(within).join(pending, "id", "left_semi").select("id", *columns).checkpoint()
        table.upsert(filled)
        replica.put_setting(BACKFILL_KEY, str(number))
        result.counts["backfilled"] += filled.count()
    replica.put_setting(BACKFILL_KEY, "done")


def _record(replica: Replica, started: dt.datetime, options: Options, result: CycleResult) -> None:
    """Append the run; with ``keep_runs`` old ones go. Bookkeeping must not fail the cycle."""
    try:
        table = replica["sync_runs"]
        runs = table.read()
        last = runs.agg(F.max("id")).first()[0] or 0
        finished = dt.datetime.now(dt.timezone.utc)
        counts = result.counts
        row = {
            "id": last + 1, "started_at": started, "finished_at": finished,
            "duration_ms": int((finished - started).total_seconds() * 1000), "status": result.status,
            **{name: counts.get(name) for name in (
                "workflows", "executions", "rows_read", "errors", "analytics_done", "analytics_failed",
                "analytics_queued", "reclassified", "purged_input", "purged_stack")},
            "replica_bytes": stored_bytes(replica.spark, replica.root), "error_message": result.error,
        }
        entry = replica.spark.createDataFrame([tuple(row[c] for c in schemas.SYNC_RUN.fieldNames())],
                                              schemas.SYNC_RUN)
        table.replace(care.keep_last(conform(runs, schemas.SYNC_RUN).unionByName(entry), options.keep_runs))
    except Exception:
        log.exception("run not recorded")

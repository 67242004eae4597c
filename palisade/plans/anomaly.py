"""Statistical and first-seen anomalies, highest score first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.columns import has_text, instant_us, local_hour, off_hours_privileged, text_or_none
from palisade.functions.net import is_external_ip
from palisade.operators.firstseen import first_external_source, first_rows, known_before
from palisade.session import stage

BASELINE_SOURCES = 3
# Scores, limits and texts of the families.
VOLUME_MIN_EVENTS, VOLUME_MIN_Z, VOLUME_IDS = 25, 1.0, 25
FAILED_MIN = 5
RARE_SCORE, OFF_HOURS_SCORE, PROCESS_SCORE = 0.80, 0.76, 0.81
SUSPICIOUS_COMMANDS = ["-enc", "downloadstring", "frombase64string"]
COMMAND_CHARS = 200
TOP = 20
ACTIONS = {
    "volume": "Review noisy asset for scan, outage, or compromise.",
    "failed_logins": "Investigate brute force or password spraying.",
    "rare_source": "Validate VPN/travel context and check for credential theft.",
    "off_hours": "Confirm approval and review session commands.",
    "process": "Collect process tree and endpoint telemetry.",
}

ORDER = ["o1", "o2", "o3", "o4"]
SHAPE = ["family", "entity", "anomaly_score", "reason", "features_json", "event_id", "user", "src_ip", "asset", *ORDER]


def z_scores(counts: DataFrame) -> DataFrame:
    """Add ``z``: how far ``n`` lies above the mean in population deviations, 0 if not above.

    Mean and deviation are one aggregate row used as a scalar; no window over all rows.
    """
    stats = counts.agg(F.struct(F.count("*").alias("c"), F.avg("n").alias("m"), F.stddev_pop("n").alias("sd")).alias("s"))
    with_stats = counts.withColumn("_s", stats.scalar())
    z = F.when((F.col("_s.c") < 2) | (F.col("_s.sd") == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (F.col("n") - F.col("_s.m")) / F.col("_s.sd"))
    )
    return with_stats.withColumn("z", z).drop("_s")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def _is_failed_login() -> Column:
    return (F.col("event_type") == "ssh_login") & (F.col("status") == "failure")


def asset_volumes(events: DataFrame) -> DataFrame:
    return z_scores(_counted(events.where(has_text("asset")), "asset"))


def failed_login_counts(events: DataFrame) -> DataFrame:
    return z_scores(_counted(events.where(_is_failed_login()), "user", "src_ip"))


def _all_counts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asset_volumes`` and ``failed_login_counts`` from one pass over the events; the counts are written, since each
    score reads its own twice."""
    null = F.lit(None).cast("string")
    kinds = F.array_compact(F.array(
        F.when(has_text("asset"), F.struct(F.lit(0).alias("kind"), F.col("asset"), null.alias("user"), null.alias("src_ip"))),
        F.when(_is_failed_login(), F.struct(F.lit(1).alias("kind"), null.alias("asset"), F.col("user"), F.col("src_ip")))))
    counts = stage(_counted(events.select("seq", F.inline(kinds)), "kind", "asset", "user", "src_ip"), "event-counts")
    own = lambda kind, *keys: counts.where(F.col("kind") == kind).select(*keys, "n", "first_seq")
    return z_scores(own(0, "asset")), z_scores(own(1, "user", "src_ip"))


def _shape(df: DataFrame, family: str, entity: Column, score: Column, reason: Column, features: Column,
           order: list[Column], event_id: Column | None = None) -> DataFrame:
    have = {"user", "src_ip", "asset"} & set(df.columns)
    null = F.lit(None).cast("string")
    return df.select(
        F.lit(family).alias("family"), entity.alias("entity"), score.cast("double").alias("anomaly_score"),
        reason.alias("reason"), F.to_json(features, {"ignoreNullFields": "false"}).alias("features_json"),
        (null if event_id is None else event_id).alias("event_id"),
        *[(F.col(c) if c in have else null).alias(c) for c in ("user", "src_ip", "asset")],
        *[o.cast("bigint").alias(name) for o, name in zip(order, ORDER)],
    )


def volume_anomalies(events: DataFrame, min_events: int = VOLUME_MIN_EVENTS, min_z: float = VOLUME_MIN_Z) -> DataFrame:
    return _volume_rows(asset_volumes(events), min_events, min_z)


def _volume_rows(volumes: DataFrame, min_events: int = VOLUME_MIN_EVENTS, min_z: float = VOLUME_MIN_Z) -> DataFrame:
    hits = volumes.where((F.col("n") >= min_events) & (F.col("z") >= min_z))
    return _shape(
        hits, "volume", F.col("asset"), F.least(F.lit(0.99), F.lit(0.55) + F.col("z") / 5),
        F.concat(F.lit("Unusual event volume for asset "), F.col("asset")),
        F.struct(F.col("n").alias("event_count"), F.round("z", 2).alias("z_score")),
        [F.lit(0), F.col("first_seq"), F.lit(0), F.lit(0)],
    )


def failed_login_anomalies(events: DataFrame, min_failures: int = FAILED_MIN) -> DataFrame:
    return _failed_login_rows(failed_login_counts(events), min_failures)


def _failed_login_rows(counts: DataFrame, min_failures: int = FAILED_MIN) -> DataFrame:
    hits = counts.where(F.col("n") >= min_failures)
    user, src = text_or_none("user"), text_or_none("src_ip")
    return _shape(
        hits, "failed_logins", F.concat(user, F.lit("@"), src), F.least(F.lit(0.98), F.lit(0.60) + F.col("z") / 5),
        F.concat(F.lit("Abnormal failed-login volume for "), user, F.lit(" from "), src),
        F.struct(F.col("n").alias("failed_logins"), F.round("z", 2).alias("z_score")),
        [F.lit(1), F.col("first_seq"), F.lit(0), F.lit(0)],
    )


def _with_us(events: DataFrame) -> DataFrame:
    return events if "us" in events.columns else events.withColumn("us", instant_us("timestamp"))


def _is_source_use() -> Column:
    return has_text("user") & has_text("src_ip") & F.coalesce(F.col("status") == "success", F.lit(False))


def source_firsts(events: DataFrame) -> DataFrame:
    return first_rows(_with_us(events).where(_is_source_use()), ["user", "src_ip"], ["asset"])


def rare_source_hits(events: DataFrame, baseline: int = BASELINE_SOURCES) -> DataFrame:
    return _rare_source_hits(source_firsts(events), baseline)


def _rare_source_hits(firsts: DataFrame, baseline: int = BASELINE_SOURCES) -> DataFrame:
    return first_external_source(firsts, is_external_ip("src_ip"), baseline)


def rare_source_anomalies(events: DataFrame, baseline: int = BASELINE_SOURCES) -> DataFrame:
    return _rare_source_rows(rare_source_hits(events, baseline))


def _rare_source_rows(hits: DataFrame) -> DataFrame:
    """``features_json`` gets its list of known sources only once the row is kept."""
    return _shape(
        hits, "rare_source", F.col("user"), F.lit(RARE_SCORE),
        F.concat(F.lit("Rare external source IP "), F.col("src_ip"), F.lit(" for user "), F.col("user")),
        F.struct("src_ip"), [F.lit(2), F.col("us"), F.col("seq"), F.lit(0)], F.col("id"),
    )


def off_hours_anomalies(events: DataFrame) -> DataFrame:
    hits = _with_us(events).where(off_hours_privileged("us"))
    return _shape(
        hits, "off_hours", F.col("user"), F.lit(OFF_HOURS_SCORE), F.lit("Privileged access outside business hours"),
        F.struct(local_hour("us").alias("hour"), "asset", "src_ip"),
        [F.lit(2), F.col("us"), F.col("seq"), F.lit(1)], F.col("id"),
    )


def _is_run() -> Column:
    return has_text("process_name") & has_text("command_line")


def _actor() -> Column:
    return F.coalesce(F.nullif("user", F.lit("")), F.nullif("asset", F.lit("")), F.lit("unknown"))


def process_firsts(events: DataFrame) -> DataFrame:
    runs = _with_us(events).where(_is_run()).select(
        "us", "seq", "id", "process_name", "command_line", _actor().alias("entity"), F.lower("process_name").alias("proc")
    )
    return first_rows(runs, ["entity", "proc"], ["process_name", "command_line"])


def _all_firsts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source_firsts`` and ``process_firsts`` from one pass over the events, written out: both are read twice."""
    null = F.lit(None).cast("string")
    carried = ("asset", "process_name", "command_line")
    use = F.struct(F.lit(0).alias("kind"), F.col("user").alias("k1"), F.col("src_ip").alias("k2"), F.col("asset"),
                   *[null.alias(c) for c in carried[1:]])
    run = F.struct(F.lit(1).alias("kind"), _actor().alias("k1"), F.lower("process_name").alias("k2"), null.alias("asset"),
                   *[F.col(c) for c in carried[1:]])
    kinds = F.array_compact(F.array(F.when(_is_source_use(), use), F.when(_is_run(), run)))
    rows = _with_us(events).select("us", "seq", "id", F.inline(kinds))
    firsts = stage(first_rows(rows, ["kind", "k1", "k2"], list(carried)), "first-uses")
    order = ("us", "seq", "id")
    return (
        firsts.where("kind = 0").select(F.col("k1").alias("user"), F.col("k2").alias("src_ip"), *order, "asset"),
        firsts.where("kind = 1").select(F.col("k1").alias("entity"), F.col("k2").alias("proc"), *order, *carried[1:]),
    )


def new_process_hits(events: DataFrame) -> DataFrame:
    return _new_process_hits(process_firsts(events))


def _new_process_hits(firsts: DataFrame) -> DataFrame:
    """The first run of a process by an entity that ran another before, with a suspicious command."""
    begun = firsts.groupBy("entity").agg(F.min(F.struct("us", "seq", "id")).alias("begun"))
    command = F.lower("command_line")
    suspicious = F.lit(False)
    for text in SUSPICIOUS_COMMANDS:
        suspicious = suspicious | command.contains(text)
    return firsts.where(suspicious).join(begun, "entity").where(F.struct("us", "seq", "id") > F.col("begun")).drop("begun")


def process_anomalies(events: DataFrame) -> DataFrame:
    return _process_rows(new_process_hits(events))


def _process_rows(hits: DataFrame) -> DataFrame:
    return _shape(
        hits, "process", F.col("entity"), F.lit(PROCESS_SCORE),
        F.concat(F.lit("Unusual command usage: "), F.col("process_name")),
        F.struct(F.col("process_name").alias("process"), F.left("command_line", F.lit(COMMAND_CHARS)).alias("command_line")),
        [F.lit(2), F.col("us"), F.col("seq"), F.lit(2)], F.col("id"),
    )


def _best_first() -> list[Column]:
    return [F.col("anomaly_score").desc(), *[F.col(c).asc() for c in ORDER]]


def detect_anomalies(events: DataFrame, top: int | None = TOP) -> DataFrame:
    """The ``top`` anomalies of all families. Each family is limited before the union, and ids
    and lists are made only for the rows kept (see ``anomaly_events`` for the events behind).

    The events are read three times, each time for few columns: for the counts, for the first uses and for the
    off-hours rows.
    """
    timed = _with_us(events)
    volumes, failures = _all_counts(timed)
    sources, processes = _all_firsts(timed)
    families = [
        _volume_rows(volumes), _failed_login_rows(failures), _rare_source_rows(_rare_source_hits(sources)),
        off_hours_anomalies(timed), _process_rows(_new_process_hits(processes)),
    ]
    if top is not None:
        families = [f.orderBy(*_best_first()).limit(top) for f in families]
    found = families[0]
    for family in families[1:]:
        found = found.unionByName(family)
    if top is not None:
        found = found.orderBy(*_best_first()).limit(top)
    # The rows are joined with what they are made of.
    found = stage(found, "anomalies-found")
    rare = found.where(F.col("family") == "rare_source").select(
        "user", F.col("o2").alias("us"), F.col("o3").alias("seq"), F.col("event_id").alias("id")
    )
    known = known_before(rare, sources).withColumnRenamed("user", "entity")
    found = found.join(known, "entity", "left").withColumn(
        "features_json",
        F.when(F.col("family") == "rare_source",
               F.to_json(F.struct("src_ip", F.col("known").alias("known_sources")))).otherwise(F.col("features_json")),
    )
    # Names as JSON: a missing user and one called None differ, and so do a@b + c and a + b@c.
    parts = F.to_json(F.struct("family", "user", "src_ip", "asset", "entity", "event_id"), {"ignoreNullFields": "false"})
    action = None
    for family, text in ACTIONS.items():
        cond = F.col("family") == family
        action = F.when(cond, F.lit(text)) if action is None else action.when(cond, F.lit(text))
    return found.select(
        F.concat(F.lit("AN-"), F.substring(F.sha2(parts, 256), 1, 10)).alias("anomaly_id"),
        *[c for c in SHAPE if c in ("family", "entity", "anomaly_score", "reason", "features_json")],
        action.alias("recommended_action"), "event_id", "user", "src_ip", "asset", *ORDER,
    ).orderBy(*_best_first())


def anomaly_events(events: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Long form of the related events: ``anomaly_id, seq, event_id``, in arrival order by ``seq``.

    All failures of a flagged pair are listed, however many; the first 25 events of a flagged
    asset; the one event of the other families.
    """
    ids = events.select("asset", "user", "src_ip", "status", "seq", F.col("id").alias("event_id"))
    single = anomalies.where(F.col("event_id").isNotNull()).select("anomaly_id", F.col("o3").alias("seq"), "event_id")
    assets = anomalies.where(F.col("family") == "volume").select("anomaly_id", "asset")
    first = Window.partitionBy("anomaly_id").orderBy("seq", "event_id")
    volume = (
        ids.select("asset", "seq", "event_id").join(assets, "asset")
        .withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= VOLUME_IDS)
    )
    pairs = anomalies.where(F.col("family") == "failed_logins").select(
        "anomaly_id", F.col("user").alias("u"), F.col("src_ip").alias("s")
    )
    failures = ids.where(F.col("status") == "failure").join(
        pairs, F.col("user").eqNullSafe(F.col("u")) & F.col("src_ip").eqNullSafe(F.col("s"))
    )
    cols = ["anomaly_id", "seq", "event_id"]
    return single.select(*cols).unionByName(volume.select(*cols)).unionByName(failures.select(*cols))


def anomaly_report(events: DataFrame, top: int = TOP) -> DataFrame:
    """Anomaly rows with the related ids as a list, for display of the top rows only; a list is as
    long as its anomaly has events (``anomaly_events`` has them row by row)."""
    found = detect_anomalies(events, top)
    ids = anomaly_events(events, found).groupBy("anomaly_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "event_id"))).alias("l")
    )
    listed = F.transform("l", lambda x: x.getField("event_id"))
    return found.join(ids, "anomaly_id", "left").orderBy(*_best_first()).select(
        "anomaly_id", "entity", "anomaly_score", "reason", "features_json",
        F.coalesce(listed, F.array().cast("array<string>")).alias("related_event_ids"), "recommended_action",
    )

"""Raw lines and JSON objects to event rows, as one stateless projection.

Works the same on a batch and on a streaming DataFrame. A line that cannot be used goes to the
quarantine with a reason and never stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.columns import computed, json_columns, quoted
from palisade.functions.timeparse import strip, wall_clock_utc, with_iso
from palisade.schema import EVENT_FIELDS, EVENT_SCHEMA

# The line formats. (?Ud) makes classes cover all of Unicode and '.' stop at '\n' only.
SSHD = r"(?Ud)^(\w{3})\s+(\d{1,2})\s+(\d\d:\d\d:\d\d)\s+(\S+)\s+sshd\[\d+\]:\s+(.*)"
WINDOWS = (
    r"(?Udi)^WinEvent\s+Time=(\S+)\s+Host=(\S+)\s+EventID=(\d+)\s+User=(\S+)"
    r"(?:\s+Process=(\S+))?(?:\s+CommandLine=\"([^\"]*)\")?.*"
)
FIREWALL = (
    r"(?Udi)^(\S+)\s+(\S+)\s+FW\s+action=(\S+)\s+src=(\S+)\s+dst=(\S+)\s+dpt=(\d+)"
    r"\s+proto=(\S+)\s+msg=\"([^\"]*)\""
)
WEB = r"(?Ud)^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+\"(\S+)\s+(\S+)\s+([^\"]+)\"\s+(\d+)\s+\S+\s+\"([^\"]*)\""
WEB_TIME = r"(?Ud)^\s*(\d{1,2})/(\w{3})/(\d{4}):(\d\d:\d\d:\d\d)(?:\s+([+-]\d{2})(\d{2}))?(?:\s|$)"
SSHD_INVALID_USER = r"(?Ud)invalid user (\S+)"
SSHD_USER = r"(?Ud)for (?:invalid user )?(\S+) from"
SSHD_IP = r"(?Ud)from (\d+\.\d+\.\d+\.\d+)"
ADMIN_CHANGE_IDS = ["4720", "4732"]
POWERSHELL_ID = "4104"
WEB_ASSET = "web01"
UNKNOWN_SAMPLES, UNKNOWN_SAMPLE_CHARS = 10, 200

SEPARATOR = "\u0001"
JSON_SCHEMA = ", ".join(
    f"`{name}` string" for name in ["id", "timestamp", "source", "event_type", *EVENT_FIELDS, "raw_log", "_malformed"]
)


def capture(text: str, pattern: str, groups: int) -> str:
    """All groups of a pattern as an array, with one match per line.

    The groups are written out with a separator and split again. A line that itself holds the
    separator is matched group by group instead.
    """
    target = SEPARATOR.join(f"${i}" for i in range(1, groups + 1))
    joined = f"regexp_replace({text}, {quoted(pattern + '[\\s\\S]*$')}, {quoted(target)})"
    single = ", ".join(f"regexp_extract({text}, {quoted(pattern)}, {i})" for i in range(1, groups + 1))
    sep = quoted(SEPARATOR)
    return f"CASE WHEN contains({text}, {sep}) THEN array({single}) ELSE split({joined}, {sep}) END"


def first_match(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, 1), '')"


def pick_format(text: str) -> str:
    return f"""CASE WHEN coalesce({text}, '') = '' THEN 'blank' WHEN startswith({text}, '{{') THEN 'json'
        WHEN {text} RLIKE {quoted(SSHD)} THEN 'sshd' WHEN {text} RLIKE {quoted(WINDOWS)} THEN 'windows'
        WHEN {text} RLIKE {quoted(FIREWALL)} THEN 'firewall' WHEN {text} RLIKE {quoted(WEB)} THEN 'web' ELSE 'unknown' END"""


def by_format(choices: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN format = '{name}' THEN {value}" for name, value in choices.items()) + " END"


def g(i: int) -> str:
    """The i-th capture of the line's format."""
    return f"get(g, {i - 1})"


SSH_STATUS = f"""CASE WHEN startswith(lower({g(5)}), 'accepted ') THEN 'success'
    WHEN startswith(lower({g(5)}), 'failed ') THEN 'failure' ELSE 'unknown' END"""
WINDOWS_TYPE = f"""CASE WHEN {g(3)} = '{POWERSHELL_ID}' OR contains(lower(text), 'powershell') THEN 'powershell_execution'
    WHEN {g(3)} IN ({", ".join(quoted(i) for i in ADMIN_CHANGE_IDS)}) THEN 'admin_account_change' ELSE 'windows_event' END"""
SSH_USER = f"coalesce({first_match(g(5), SSHD_INVALID_USER)}, {first_match(g(5), SSHD_USER)})"
# What each event column is in each format; null where a format is missing.
COLUMNS = {
    "source": {"json": "j.source", "sshd": "'linux_auth'", "windows": "'windows'", "firewall": "'firewall'",
               "web": "'waf'", "unknown": "'unknown'"},
    "event_type": {"json": "j.event_type", "sshd": "'ssh_login'", "windows": WINDOWS_TYPE,
                   "firewall": "'network_connection'", "web": "'http_request'", "unknown": "'unknown'"},
    "asset": {"json": "j.asset", "sshd": g(4), "windows": g(2), "firewall": g(2), "web": quoted(WEB_ASSET)},
    "user": {"json": "j.user", "sshd": SSH_USER, "windows": g(4)},
    "src_ip": {"json": "j.src_ip", "sshd": first_match(g(5), SSHD_IP), "firewall": g(4), "web": g(1)},
    "dst_ip": {"json": "j.dst_ip", "firewall": g(5)},
    "process_name": {"json": "j.process_name", "windows": f"nullif({g(5)}, '')"},
    "command_line": {"json": "j.command_line", "windows": g(6)},
    "status": {"json": "j.status", "sshd": SSH_STATUS, "windows": "'success'", "firewall": f"lower({g(3)})", "web": g(6)},
    "message": {"json": "j.message", "sshd": g(5), "windows": "text",
                "firewall": f"concat({g(8)}, ' dst_port=', {g(6)}, ' proto=', {g(7)})",
                "web": f"concat({g(3)}, ' ', {g(4)}, ' user_agent=', {g(7)})", "unknown": "text"},
    "raw_log": {"json": "coalesce(nullif(j.raw_log, ''), text)", "sshd": "text", "windows": "text", "firewall": "text",
                "web": "text", "unknown": "text"},
}
REASON = """CASE WHEN format = 'oversize' THEN 'oversize' WHEN format = 'blank' THEN 'empty log line'
    WHEN format = 'json' AND (j._malformed IS NOT NULL OR j IS NULL) THEN 'bad json'
    WHEN format = 'json' AND NOT coalesce(j.source <> '' AND j.event_type <> '', false)
      THEN 'event requires source and event_type'
    WHEN line_time IS NULL THEN 'bad timestamp' END"""


def parse_lines(raw: DataFrame, reference_year: int | None = None, ingest_time: Column | None = None,
                honour_web_offset: bool = False, max_raw_bytes: int | None = None) -> DataFrame:
    """Add the event columns, the chosen ``format`` and a quarantine ``reason`` to rows of ``raw``.

    ``ingest_time`` stands in for a missing or unreadable time, and ``reference_year`` for the
    year syslog lines leave out (default: the year of ``ingest_time``). Rows with a ``payload_error``
    are quarantined for it. ``max_raw_bytes`` is the size limit of request bodies; files have none.
    """
    reason = f"coalesce(payload_error, {REASON})" if "payload_error" in raw.columns else REASON
    year = "year(now)" if reference_year is None else str(int(reference_year))
    oversize = f"octet_length(raw) > {int(max_raw_bytes)}" if max_raw_bytes else "false"
    captures = {"sshd": (SSHD, 5), "windows": (WINDOWS, 6), "firewall": (FIREWALL, 8), "web": (WEB, 7)}
    df = computed(raw, text=strip("raw"), now=F.current_timestamp() if ingest_time is None else ingest_time)
    df = computed(df, format=f"CASE WHEN {oversize} THEN 'oversize' ELSE {pick_format('text')} END")
    df = computed(
        df,
        g=by_format({name: capture("text", pattern, n) for name, (pattern, n) in captures.items()}),
        j=by_format({"json": f"from_json(text, '{JSON_SCHEMA}', map('columnNameOfCorruptRecord', '_malformed'))"}),
    )
    df = computed(df, iso=by_format({"json": "j.timestamp", "windows": g(1), "firewall": g(1)}),
                  w=by_format({"web": f"CASE WHEN {g(2)} RLIKE {quoted(WEB_TIME)} THEN {capture(g(2), WEB_TIME, 6)} END"}))
    df = with_iso(df, "iso", "iso_time", "iso_offset")
    web_offset = "(cast(concat(left(get(w, 4), 1), '1') AS int) * (cast(substring(get(w, 4), 2) AS int) * 3600 + cast(get(w, 5) AS int) * 60))"
    web_offset = f"coalesce(CASE WHEN get(w, 4) <> '' THEN {web_offset} END, 0)" if honour_web_offset else "0"
    web_wall = wall_clock_utc("get(w, 2)", "get(w, 1)", "get(w, 0)", "get(w, 3)")
    df = computed(
        df,
        line_time=f"""CASE WHEN format = 'sshd' THEN {wall_clock_utc(year, g(1), g(2), g(3))}
            WHEN format = 'web' THEN timestamp_micros(unix_micros({web_wall}) - {web_offset} * 1000000L)
            ELSE coalesce(iso_time, now) END""",
    )
    return df.selectExpr(
        *raw.columns, "format", f"{reason} AS reason",
        "CASE WHEN format = 'json' THEN nullif(j.id, '') END AS given_id", "line_time AS timestamp",
        f"cast(CASE WHEN format = 'web' THEN {web_offset} ELSE coalesce(iso_offset, 0) END AS int) AS utc_offset",
        *[f"{by_format(choice)} AS {name}" for name, choice in COLUMNS.items()],
    )


def with_positions(raw: DataFrame) -> DataFrame:
    """Number the copies of equal lines within their file.

    Equal lines of a file cannot be told apart, so their running number makes ids that come out
    the same however the file is split and read again. A producer that already gives an offset
    (``position`` column) needs none of this.
    """
    copies = Window.partitionBy("source_uri", "raw").orderBy("seq")
    return raw.withColumn("position", F.row_number().over(copies).cast("string"))


def valid_events(parsed: DataFrame) -> DataFrame:
    """Event rows of parsed lines; ids are a hash of source, position and line."""
    have = parsed.columns
    uri = "coalesce(source_uri, '')" if "source_uri" in have else "''"
    position = "coalesce(cast(position AS string), '')" if "position" in have else "''"
    derived = {
        "id": f"coalesce(given_id, concat('evt-', substring(sha2(concat_ws('|', {uri}, {position}, raw), 256), 1, 12)))",
        "seq": "cast(seq AS bigint)" if "seq" in have else "0L",
        "event_date": "date_from_unix_date(cast(floor(unix_micros(timestamp) / 86400000000) AS int))",
    }
    columns = [f"{derived.get(f.name, f.name)} AS {f.name}" for f in EVENT_SCHEMA.fields]
    return parsed.where("reason IS NULL").selectExpr(*columns)


def quarantined(parsed: DataFrame) -> DataFrame:
    extra = [name for name in ("source_uri", "position", "seq") if name in parsed.columns]
    return parsed.where(F.col("reason").isNotNull()).select("raw", "reason", *extra)


def normalize_logs(raw: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(events, quarantine)``. Both read the same parse; write or persist it to parse once."""
    parsed = parse_lines(raw, **options)
    return valid_events(parsed), quarantined(parsed)


def parser_stats(parsed: DataFrame) -> DataFrame:
    """Parsed, failed and unknown counts, and the first unknown lines as samples."""
    failed, unknown = F.expr("reason IS NOT NULL"), F.expr("format = 'unknown'")
    counts = parsed.agg(
        F.count_if(~failed & ~unknown).alias("parsed_events"),
        F.count_if(failed).alias("parsing_failed_events"),
        F.count_if(~failed & unknown).alias("unknown_events"),
    )
    order = "seq" if "seq" in parsed.columns else "raw"
    samples = (
        parsed.where(~failed & unknown)
        .select(F.col(order).alias("o"), F.expr(f"left({strip('raw')}, {UNKNOWN_SAMPLE_CHARS})").alias("sample"))
        .orderBy("o").limit(UNKNOWN_SAMPLES)
        .agg(F.array_sort(F.collect_list(F.struct("o", "sample"))).alias("s"))
        .select(F.transform("s", lambda x: x.getField("sample")).alias("unknown_samples"))
    )
    return counts.select("*", samples.scalar().alias("unknown_samples"))


# Defaults of the older layout.
LEGACY_DEFAULTS = {
    "title": "Untitled event", "source": "unknown", "asset": "unknown", "message": "",
    "recommendation": "Review evidence and escalate if confirmed.",
}


def legacy_fields(df: DataFrame) -> DataFrame:
    """The older six-field layout; a default stands in only where the column is absent."""
    return df.select(*[
        F.col(name) if name in df.columns else F.lit(LEGACY_DEFAULTS.get(name)).cast("string").alias(name)
        for name in ("timestamp", *LEGACY_DEFAULTS)
    ])


def legacy_fields_from_json(df: DataFrame, column: str = "raw") -> DataFrame:
    """The same from JSON objects, where a key may be absent in one row and null in the next."""
    schema = ", ".join(f"{name} string" for name in ("timestamp", *LEGACY_DEFAULTS))
    keys = F.json_object_keys(F.col(column))
    parsed = df.select("*", F.from_json(column, schema).alias("o"), keys.alias("k"))
    return parsed.select(
        *df.columns,
        F.col("o.timestamp").alias("timestamp"),
        *[
            F.when(F.array_contains("k", name), F.col(f"o.{name}")).otherwise(F.lit(default)).alias(name)
            for name, default in LEGACY_DEFAULTS.items()
        ],
    )


# Field names of the common schema, per kind of source.
COMMON_NAMES = {
    "cloud": {"sourceIPAddress": "source.ip", "eventName": "event.action", "userIdentity.arn": "user.id"},
    "firewall": {"src_ip": "source.ip", "dst_ip": "destination.ip", "dst_port": "destination.port"},
    "linux_auth": {"src_ip": "source.ip", "user": "user.name", "asset": "host.name"},
    "windows": {"event_id": "event.code", "command_line": "process.command_line", "asset": "host.name"},
}
CLOUD_FIELDS = {
    "c_time": "eventTime string", "c_name": "eventName string", "c_identity": "userIdentity struct<arn string, userName string>",
    "c_address": "sourceIPAddress string", "c_region": "awsRegion string",
}


def to_common_schema(df: DataFrame, kind: str) -> DataFrame:
    """Rename the fields of one kind of source to the common schema, keeping all others."""
    names = COMMON_NAMES[kind]
    out = [F.col(c) for c in df.columns if c not in names]
    for old, new in names.items():
        top = old.split(".")[0]
        if top in df.columns:
            out.append(F.col(old).alias(new))
    return df.select(*out)


def parse_cloud_audit(df: DataFrame, column: str = "raw", ingest_time: Column | None = None) -> DataFrame:
    """Cloud audit records (JSON) as event columns."""
    c = computed(df, now=F.current_timestamp() if ingest_time is None else ingest_time)
    c = with_iso(json_columns(c, column, CLOUD_FIELDS), "c_time", "event_time", "event_offset")
    return c.selectExpr(
        *df.columns, "coalesce(event_time, now) AS timestamp", "coalesce(event_offset, 0) AS utc_offset",
        "'cloud' AS source", "'cloud_event' AS event_type", "c_region AS asset",
        "coalesce(c_identity.userName, c_identity.arn) AS user", "c_address AS src_ip", "c_name AS message",
    )

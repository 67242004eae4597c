"""Rules over events: candidates, emission, and the alert rows with their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.columns import (
    SEVERITY_RANK, action_text, evidence_text, has_text, instant_us, local_minute, lookup, off_hours_privileged, present, severity_rank,
    stable_id, string_list,
)
from palisade.functions.net import is_external_ip
from palisade.operators.digest import short_id
from palisade.operators.firstseen import first_external_source, first_rows, known_before
from palisade.operators.lookback import (
    ROW as LOOK_ROW, window_digests, window_lists, window_lists_in_spans, window_members, with_latest,
)
from palisade.operators.sliding import sliding_count
from palisade.operators.suppress import ENTITY, emitted, offsets_in_use, scope_fields
from palisade.rules import (
    OFF_HOURS, OFF_HOURS_ACTION, RARE_SOURCE, RARE_SOURCE_ACTION, RULES, Rule, equals_all, predicate, rule_column,
)
from palisade.schema import ALERT_SCHEMA
from palisade.session import stage

EVIDENCE_ROWS = 10
BASELINE_SOURCES = 3
RARE_SOURCE_ID = f"array('{RARE_SOURCE.rule_id}', user, src_ip)"
#: Spans of a sorted report: so many to a window, and none shorter than this.
SPANS, LEAST_SPAN_US = 4, 60 * 60 * 1_000_000


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("us", instant_us("timestamp")).withColumn("minute", local_minute("us"))


def group_key(rules: Sequence[Rule]) -> Column:
    """The values of the rule's grouping fields; nulls are equal to each other."""
    out = None
    for i, rule in enumerate(rules):
        key = F.array(*[F.col(c) for c in rule.group_by]).cast("array<string>")
        out = F.when(F.col("rule") == i, key) if out is None else out.when(F.col("rule") == i, key)
    return out


def _hits(rules: Sequence[Rule], chosen: Sequence[int]) -> Column:
    """Numbers of the rules whose conditions an event meets."""
    return F.array_compact(F.array(*[F.when(predicate(rules[i]), F.lit(i)) for i in chosen]))


def relevant_events(events: DataFrame, rules: Sequence[Rule], rare_source: bool = True, off_hours: bool = True) -> DataFrame:
    """The events that some rule looks at, with ``hits``, written out: the one read of the event table.

    All branches of a detection run go on from this table. Most events match nothing and are not in it; being
    columnar, it is read for keys and times alone until evidence is needed. The original text stays only where the
    off-hours rule shows it.
    """
    plain = [i for i, r in enumerate(rules) if r.preceded_by is None]
    rows = timed(events).withColumn("hits", _hits(rules, plain) if plain else F.array().cast("array<int>"))
    wanted = F.size("hits") > 0
    for rule in rules:
        if rule.preceded_by is not None:
            wanted = wanted | predicate(rule) | equals_all(rule.preceded_by)
    if rare_source:
        wanted = wanted | _source_login()
    if off_hours:
        wanted = wanted | _off_hours_login()
    types = {d.get("event_type") for r in rules for d in (r.field_equals, r.preceded_by) if d is not None}
    if None not in types:
        rows = rows.where(F.col("event_type").isin(sorted(types | ({"ssh_login"} if rare_source or off_hours else set()))))
    tested = {name for r in rules for part in (r.field_equals, r.contains, r.regex, r.preceded_by or {}, r.group_by, [r.distinct_field])
              for name in part}
    if "raw_log" not in tested:
        rows = rows.withColumn("raw_log", F.when(_off_hours_login() if off_hours else F.lit(False), F.col("raw_log")))
    return stage(rows.where(wanted), "relevant-events")


def tag(events: DataFrame, rules: Sequence[Rule], chosen: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per event and matching rule, in one pass over the events."""
    if "hits" in events.columns:
        hits = F.filter("hits", lambda i: i.isin(list(chosen)))
    else:
        types = [rules[i].field_equals.get("event_type") for i in chosen]
        if all(types):
            events = events.where(F.col("event_type").isin(sorted(set(types))))
        hits = _hits(rules, chosen)
    columns = {f for i in chosen for f in rules[i].group_by} | {rules[i].distinct_field for i in chosen} - {None}
    wanted = list(dict.fromkeys([*keep, *sorted(columns)]))
    return (
        events.withColumn("rule", F.explode(hits)).withColumn("key", group_key(rules)).select("rule", "key", *wanted)
    )


CANDIDATE = ["rule", "key", "minute", "us", "seq", "id", *ENTITY]
ROW = ["us", "minute", "seq", "id", *ENTITY]


def distinct_value(rules: Sequence[Rule], chosen: Sequence[int]) -> tuple[Column, Column]:
    """Value to count per row, and whether the row counts at all."""
    value, counts = F.lit(None).cast("string"), F.lit(True)
    for i in chosen:
        if rules[i].distinct_field:
            own = present(rules[i].distinct_field)
            value = F.when(F.col("rule") == i, own).otherwise(value)
            counts = F.when(F.col("rule") == i, own.isNotNull()).otherwise(counts)
    return value, counts


def windowed_candidates(events: DataFrame, rules: Sequence[Rule], chosen: Sequence[int]) -> DataFrame:
    """Rows at which a count or distinct count over the look-back window reaches the threshold."""
    rows = tag(events, rules, chosen, ROW)
    value, counts = distinct_value(rules, chosen)
    rows = rows.select(*CANDIDATE, value.alias("value"), counts.alias("counts"))
    counted = sliding_count(rows, ["rule", "key"], rule_column(rules, "window_us"), F.col("value"), F.col("counts"))
    return counted.where(F.col("in_window") >= rule_column(rules, "threshold")).select(*CANDIDATE)


def _precursor_keys(rule: Rule) -> Column:
    """Keys under which earlier failures are looked up: the same, or with the last field unknown."""
    *head, last = [F.col(c) for c in rule.group_by]
    null = F.lit(None).cast("string")
    return F.array_compact(
        F.array(F.array(*head, last), F.when(last.isNotNull(), F.array(*head, null)))
    )


def preceded_candidates(events: DataFrame, rules: Sequence[Rule], i: int) -> DataFrame:
    """Successes with enough failures of the same key (or of unknown user) shortly before."""
    rule = rules[i]
    failures = events.where(equals_all(rule.preceded_by)).select(
        F.array(*rule.group_by).alias("look"), "us", "seq", "id", "minute", *ENTITY, F.lit(True).alias("counts")
    )
    successes = events.where(predicate(rule)).select(
        F.explode(_precursor_keys(rule)).alias("look"), "us", "seq", "id", "minute", *ENTITY,
        F.lit(False).alias("counts"),
    )
    counted = sliding_count(failures.unionByName(successes), ["look"], F.lit(rule.window_us), weigh=F.col("counts"))
    return (
        counted.where(~F.col("counts")).groupBy("us", "seq", "id", *ENTITY)
        .agg(F.sum("in_window").alias("n")).where(F.col("n") >= rule.threshold)
        .select(F.lit(i).alias("rule"), F.array(*ENTITY).alias("key"), F.lit(None).cast("bigint").alias("minute"),
                "us", "seq", "id", *ENTITY)
    )


def _off_hours_login() -> Column:
    return (F.col("event_type") == "ssh_login") & off_hours_privileged("us")


def off_hours_logins(events: DataFrame) -> DataFrame:
    return events.where(_off_hours_login())


def candidates(events: DataFrame, rules: Sequence[Rule], off_hours: bool = True) -> DataFrame:
    """All rows at which some rule's conditions hold, before once-a-minute and suppression."""
    single = [i for i, r in enumerate(rules) if not r.is_windowed and r.preceded_by is None]
    windowed = [i for i, r in enumerate(rules) if r.is_windowed]
    parts = []
    if single:
        parts.append(tag(events, rules, single, ROW).select(*CANDIDATE))
    if windowed:
        parts.append(windowed_candidates(events, rules, windowed))
    parts += [preceded_candidates(events, rules, i) for i, r in enumerate(rules) if r.preceded_by is not None]
    if off_hours:
        parts.append(
            off_hours_logins(events).withColumn("rule", F.lit(len(rules) + 1)).withColumn("key", F.array(*ENTITY))
            .withColumn("minute", F.lit(None).cast("bigint")).select(*CANDIDATE)
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MEMBER_FIELDS = ["us", "seq", "id", "utc_offset", "asset", "user", "src_ip"]


#: Rows of failures of unknown users are copied to so many parts of a source's keys.
LOOK_PARTS = 8


def _window_marks(events: DataFrame, triggers: DataFrame, rules: Sequence[Rule], chosen: Sequence[int], line: Column) -> DataFrame:
    """Rows and marks (``lookback.ROW``) of rules that look back over their own key."""
    rows = tag(events.withColumn("ev", line), rules, chosen, [*MEMBER_FIELDS, "ev"])
    own = triggers.where(F.col("rule").isin(list(chosen))).select(
        "rule", "key", F.col("t_us").alias("us"), F.col("t_seq").alias("seq"), F.col("t_id").alias("id"), F.lit(True).alias("mark"))
    both = rows.withColumn("mark", F.lit(False)).unionByName(own, allowMissingColumns=True)
    lane = F.to_json(F.struct("rule", "key"))
    return _as_rows(both, group=lane, lane=lane, times=F.lit(1), ends=F.lit(False))


def _as_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Complete rows for ``lookback``."""
    df = df.withColumns(columns)
    return df.select("group", *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in LOOK_ROW.items()])


def _preceded_marks(events: DataFrame, triggers: DataFrame, rules: Sequence[Rule], i: int, line: Column, history: DataFrame | None,
                    parts: int) -> DataFrame:
    """The failures a rule looks back for, and a mark for each emitted success, which ends its list.

    The lists are ordered by who failed first, from the beginning of ``history`` where ``events`` are only its last part. Users of
    a source are dealt to ``parts``; failures of unknown users are in all of them.
    """
    rule = rules[i]
    *head, last = rule.group_by
    part = F.pmod(F.xxhash64(last), F.lit(parts))
    group = F.to_json(F.struct(F.lit(i).alias("rule"), F.array(*head).alias("head"), "part"))
    look, unknown = F.to_json(F.array(*rule.group_by)), F.to_json(F.array(*head, F.lit(None).cast("string")))
    own = triggers.where(F.col("rule") == i).select("t_us", "t_seq", "t_id")
    success = events.where(predicate(rule)).withColumn("ev", line).join(
        own, (F.col("id") == F.col("t_id")) & (F.col("us") == F.col("t_us")) & (F.col("seq") == F.col("t_seq")))
    # Copies of an event make copies of what is before it.
    shown = ["asset", "user", "src_ip", "utc_offset", "ev"]
    marks = success.groupBy("us", "seq", "id", *[F.col(c).alias(f"_{c}") for c in rule.group_by]).agg(
        F.count("*").alias("times"), F.min(F.struct(*shown)).alias("_s"))
    marks = marks.select("us", "seq", "id", "times", *[F.col(f"_{c}").alias(c) for c in rule.group_by],
                         *[F.col(f"_s.{c}").alias(c) for c in shown if c not in rule.group_by])
    marks = marks.withColumns({"part": part, "lane": look, "lane2": F.when(F.col(last).isNotNull(), unknown)})
    failures = events.where(equals_all(rule.preceded_by)).withColumn("ev", line).withColumn("look", look)
    past = failures if history is None else history.where(equals_all(rule.preceded_by)).withColumn("look", look)
    wanted = marks.select(F.explode(F.array("lane", "lane2")).alias("look")).distinct()
    firsts = past.select("look", "us", "seq").join(wanted, "look", "left_semi").groupBy("look").agg(F.min(F.struct("us", "seq")).alias("g"))
    among = F.when(F.col(last).isNull(), F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).otherwise(F.array(part))
    rows = failures.join(firsts, "look").withColumn("part", F.explode(among)).withColumns({"lane": F.col("look"), "g1": F.col("g.us"), "g2": F.col("g.seq")})
    number = F.lit(i)
    return _as_rows(rows, group=group, mark=F.lit(False), rule=number).unionByName(
        _as_rows(marks, group=group, mark=F.lit(True), rule=number, ends=F.lit(True)))


def _marks(prepared: DataFrame, triggers: DataFrame, rules: Sequence[Rule], line: Column, history: DataFrame | None = None,
           look_parts: int = LOOK_PARTS) -> DataFrame:
    """The events of all rules and a mark for each trigger, as ``lookback`` takes them."""
    plain = [i for i, r in enumerate(rules) if r.preceded_by is None]
    parts = [_window_marks(prepared, triggers, rules, plain, line)] if plain else []
    parts += [_preceded_marks(prepared, triggers, rules, i, line, history, look_parts) for i, r in enumerate(rules) if r.preceded_by is not None]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _windows(rules: Sequence[Rule]) -> dict[int, int]:
    return {i: r.window_us for i, r in enumerate(rules)}


def build_alerts(prepared: DataFrame, triggers: DataFrame, rules: Sequence[Rule], history: DataFrame | None = None) -> DataFrame:
    """Alert rows of triggers: ids, last evidence lines, and the entity of the latest event."""
    marks = _marks(prepared, triggers, rules, evidence_text(), history)
    return _of_lists(window_lists(marks, rule_column(rules, "window_us"), _windows(rules), EVIDENCE_ROWS), rules)


def _of_lists(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alert rows of ``window_lists`` rows."""
    out = found.withColumn("rule_id", rule_column(rules, "rule_id")).withColumn("severity", rule_column(rules, "severity"))
    return out.select(
        stable_id("AL", "concat(array(rule_id), event_ids)").alias("alert_id"),
        "rule_id", rule_column(rules, "name").alias("title"), "severity",
        rule_column(rules, "confidence").alias("confidence"), rule_column(rules, "tactic").alias("tactic"),
        rule_column(rules, "technique").alias("technique"),
        F.timestamp_micros("t_us").alias("timestamp"), "utc_offset", "asset", "user", "src_ip", "event_ids", "evidence",
        action_text("severity").alias("recommended_action"),
        F.col("t_us").alias("emit_us"), F.col("t_seq").alias("emit_seq"), F.col("rule").alias("emit_rule"),
    )


def _single_event_alert(df: DataFrame, rule: Rule, number: int, id_parts: str, evidence: Column, action: str) -> DataFrame:
    return df.select(
        stable_id("AL", id_parts).alias("alert_id"), F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.name).alias("title"), F.lit(rule.severity).alias("severity"),
        F.lit(rule.confidence).cast("double").alias("confidence"), F.lit(rule.tactic).alias("tactic"),
        F.lit(rule.technique).alias("technique"), F.timestamp_micros("us").alias("timestamp"), "utc_offset",
        "asset", "user", "src_ip", F.array("id").alias("event_ids"), F.array(evidence).alias("evidence"),
        F.lit(action).alias("recommended_action"), F.col("us").alias("emit_us"), F.col("seq").alias("emit_seq"),
        F.lit(number).alias("emit_rule"),
    )


def _source_login() -> Column:
    return (F.col("event_type") == "ssh_login") & (F.col("status") == "success") & has_text("user") & has_text("src_ip")


def source_logins(events: DataFrame) -> DataFrame:
    return events.where(_source_login())


def rare_source_alerts(events: DataFrame, number: int, baseline: int = BASELINE_SOURCES) -> DataFrame:
    """First login of a user from a new external address once three others are known.

    A new address is a new entity, so suppression never applies.
    """
    # Read twice, and one row for each user and address only.
    firsts = stage(first_rows(source_logins(events), ["user", "src_ip"], ["asset", "utc_offset"]), "source-firsts")
    hits = first_external_source(firsts, is_external_ip("src_ip"), baseline)
    return rare_source_alert_rows(hits.join(known_before(hits, firsts), "user"), number)


def rare_source_alert_rows(hits: DataFrame, number: int) -> DataFrame:
    """Alert rows of logins with the addresses ``known`` before them."""
    evidence = F.concat(
        F.lit("user="), F.col("user"), F.lit("; src_ip="), F.col("src_ip"), F.lit("; known="), string_list("known")
    )
    return _single_event_alert(hits, RARE_SOURCE, number, RARE_SOURCE_ID, evidence, RARE_SOURCE_ACTION)


def off_hours_alerts(events: DataFrame, triggers: DataFrame, number: int) -> DataFrame:
    own = triggers.where(F.col("rule") == number).select("t_us", "t_seq", "t_id")
    rows = off_hours_logins(events).join(
        own, (F.col("id") == F.col("t_id")) & (F.col("us") == F.col("t_us")) & (F.col("seq") == F.col("t_seq"))
    )
    parts = f"array('{OFF_HOURS.rule_id}', id)"
    return _single_event_alert(rows, OFF_HOURS, number, parts, F.coalesce("raw_log", F.lit("")), OFF_HOURS_ACTION)


def crossing_scopes(rules: Sequence[Rule]) -> dict[int, list[str]]:
    found = {i: scope_fields(r.group_by) for i, r in enumerate(rules) if r.preceded_by is None}
    return {i: fields for i, fields in found.items() if fields is not None}


def triggers_of(events: DataFrame, rules: Sequence[Rule] = RULES, off_hours: bool = True) -> DataFrame:
    """Emitted ``(rule, key, t_us, t_seq, t_id)``, without evidence."""
    prepared = events if "hits" in events.columns else timed(events)
    out = emitted(candidates(prepared, rules, off_hours), offsets_in_use(events), crossing_scopes(rules))
    return out.select("rule", "key", F.col("us").alias("t_us"), F.col("seq").alias("t_seq"), F.col("id").alias("t_id"))


def alert_members(events: DataFrame, rules: Sequence[Rule] = RULES, timed: bool = True) -> DataFrame:
    """``rule_id, trigger_id, us, seq, event_id``: a row for each alert and event behind it, without gathering an alert's
    events anywhere. ``trigger_id`` is the event that raised the alert; ``us`` and ``seq`` only if ``timed``."""
    prepared = relevant_events(events, rules, rare_source=False, off_hours=False)
    triggers = stage(triggers_of(prepared, rules, False), "triggers")
    fields = ["us", "seq", "id"] if timed else ["id"]
    found = window_members(_marks(prepared, triggers, rules, F.lit(None).cast("string")), rule_column(rules, "window_us"), _windows(rules), fields)
    return found.select(
        rule_column(rules, "rule_id").alias("rule_id"), F.col("t_id").alias("trigger_id"), *fields[:-1], F.col("id").alias("event_id"))


def alert_ids(events: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``rule_id, trigger_id, alert_id, n_events``: the ids that ``run_detections`` gives, without making the lists of events."""
    prepared = relevant_events(events, rules, rare_source=False, off_hours=False)
    triggers = stage(triggers_of(prepared, rules, False), "triggers")
    found = window_digests(_marks(prepared, triggers, rules, F.lit(None).cast("string")), rule_column(rules, "window_us"), _windows(rules),
                           {i: r.rule_id for i, r in enumerate(rules)})
    return found.select(
        rule_column(rules, "rule_id").alias("rule_id"), F.col("t_id").alias("trigger_id"), short_id("AL", F.col("digest")).alias("alert_id"),
        F.col("n").alias("n_events"))


def run_detections(events: DataFrame, rules: Sequence[Rule] = RULES, rare_source: bool = True,
                   off_hours: bool = True) -> DataFrame:
    """Alerts of all rules over an event table, in no particular order (see ``sort_alerts``).

    The events are read once (``relevant_events``). The emitted triggers are written to the shared folder too;
    building evidence then joins that small table back to the relevant events.
    """
    prepared = relevant_events(events, rules, rare_source, off_hours)
    triggers = stage(triggers_of(prepared, rules, off_hours), "triggers")
    alerts = build_alerts(prepared, triggers, rules)
    if rare_source:
        alerts = alerts.unionByName(rare_source_alerts(prepared, len(rules)))
    if off_hours:
        alerts = alerts.unionByName(off_hours_alerts(prepared, triggers, len(rules) + 1))
    return alerts.select(*[F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA.fields])


def alert_events(alerts: DataFrame) -> DataFrame:
    """One row per alert and event of an alert table (``alert_members`` has them without making the lists)."""
    return alerts.select("alert_id", F.posexplode("event_ids").alias("position", "event_id"))


def alert_order() -> list[Column]:
    """Severity, confidence and time, highest first; then the order of emission."""
    return [
        severity_rank("severity").desc(), F.col("confidence").desc(), F.col("timestamp").desc(),
        F.col("emit_us").asc(), F.col("emit_seq").asc(), F.col("emit_rule").asc(),
    ]


def sort_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(*alert_order())


def sorted_detections(events: DataFrame, rules: Sequence[Rule] = RULES, rare_source: bool = True,
                      off_hours: bool = True) -> DataFrame:
    """``sort_alerts`` of ``run_detections``, without a list of events written or shuffled.

    Rule and time of an alert tell its place in the order. Events and triggers are brought to that place, and the lists are made
    there in their order: the partitions are spans of it. The alerts of a single event pass as triggers that nothing is before.
    """
    prepared = relevant_events(events, rules, rare_source, off_hours)
    triggers = stage(triggers_of(prepared, rules, off_hours), "triggers")
    number, every = len(rules), [*rules, RARE_SOURCE, OFF_HOURS]
    # A span holds the lanes of a rule together.
    rows = _marks(prepared, triggers, rules, evidence_text(), look_parts=1)
    if rare_source:
        rows = rows.unionByName(_own_marks(rare_source_alerts(prepared, number)))
    if off_hours:
        rows = rows.unionByName(_own_marks(off_hours_alerts(prepared, triggers, number + 1)))
    kinds = {i: (-SEVERITY_RANK.get(r.severity, 0), -r.confidence) for i, r in enumerate(every)}
    places = {kind: n for n, kind in enumerate(sorted(set(kinds.values())))}
    place = lookup("rule", {i: places[kind] for i, kind in kinds.items()}, None)
    longest = {n: max(r.window_us for i, r in enumerate(every) if places[kinds[i]] == n) for n in places.values()}
    span = lookup("rule", {i: max(longest[places[kind]] // SPANS, LEAST_SPAN_US) for i, kind in kinds.items()}, None)
    # Ranges are chosen by a look at the rows, which are read twice for it.
    rows = stage(with_latest(rows, span, EVIDENCE_ROWS), "marks")
    found = window_lists_in_spans(rows, place, span, rule_column(every, "window_us"), _windows(every), EVIDENCE_ROWS)
    out = _of_lists(found, every)
    rare = F.col("emit_rule") == number
    action = F.when(rare, F.lit(RARE_SOURCE_ACTION)).when(F.col("emit_rule") == number + 1, F.lit(OFF_HOURS_ACTION)).otherwise(F.col("recommended_action"))
    out = out.withColumn("alert_id", F.when(rare, stable_id("AL", RARE_SOURCE_ID)).otherwise(F.col("alert_id"))).withColumn("recommended_action", action)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA.fields])


def _own_marks(alerts: DataFrame) -> DataFrame:
    """Alerts of a single event as marks whose list is that event."""
    return _as_rows(
        alerts.select("asset", "user", "src_ip", "utc_offset", F.col("emit_us").alias("us"), F.col("emit_seq").alias("seq"),
                      F.element_at("event_ids", 1).alias("id"), F.col("emit_rule").alias("rule"), F.element_at("evidence", 1).alias("ev")),
        group=F.lit(""), mark=F.lit(True), times=F.lit(1), ends=F.lit(True))

"""Rules on a stream: the triggers a batch run over the same events would emit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from palisade.functions.net import is_external_ip
from palisade.functions.columns import has_text, off_hours_privileged, present
from palisade.operators.suppress import ENTITY, SUPPRESSION_US
from palisade.plans.anomaly import BASELINE_SOURCES, SUSPICIOUS_COMMANDS
from palisade.plans.detect import crossing_scopes, distinct_value, off_hours_logins, tag, timed
from palisade.rules import RULES, Rule, equals_all, predicate
from palisade.streaming.ordered import OrderedProcessor, body, in_order

DAY_MINUTES = 24 * 60
#: Clocks and minutes of a key from which those that have run out are looked for while its rows are worked through.
KEPT = 4096


class RuleProcessor(OrderedProcessor):
    """Look-back counts, once-a-minute limit and suppression of one rule and key, or of all keys that
    can share an entity (``scope_fields``).

    Kept per key: the last ``threshold`` times (or the last time per distinct value), the clocks
    of entities that emitted in the last 15 minutes, and minutes that later rows may still fall in.
    """

    def __init__(self, rules: Sequence[tuple]):
        self.rules = list(rules)

    def step(self, state, us, body):
        window, threshold, distinct, preceded, once_a_minute = self.rules[body["rule"]]
        times = state.setdefault("times", {}).setdefault(body["lane"], {})
        value = body["value"]
        if preceded:
            if body["before"]:
                times[value or ""] = [*times.get(value or "", []), us][-threshold:]
                return None
            looks = {value or "", ""} if body["known"] else {""}
            size = sum(us - t <= window for look in looks for t in times.get(look, []))
        elif distinct:
            # Values stand in the order of their last times, so the stale ones come first.
            if value is not None:
                times.pop(value, None)
                times[value] = [us]
            while times and us - times[oldest := next(iter(times))][-1] > window:
                del times[oldest]
            size = len(times)
        else:
            times[""] = [*times.get("", []), us][-threshold:]
            size = sum(us - t <= window for t in times[""])
        if size < threshold:
            return None
        minutes, clocks = state["minutes"], state["clocks"]
        marker = (body["minute"], body["lane"])
        if once_a_minute and marker in minutes:
            return None
        last = clocks.get(body["entity"])
        if last is not None and us - last < SUPPRESSION_US:
            return None
        clocks[body["entity"]] = us
        if once_a_minute:
            minutes.add(marker)
        if len(minutes) + len(clocks) > state["limit"]:
            self._forget(state, us)
            state["limit"] = max(KEPT, 2 * (len(minutes) + len(state["clocks"])))
        return {"rule": body["rule"]}

    def load(self, state):
        state["minutes"] = {tuple(m) for m in state.get("minutes", [])}
        state["times"] = {lane: dict(sorted(times.items(), key=lambda v: v[1][-1])) for lane, times in state.get("times", {}).items()}
        state.setdefault("clocks", {})
        state["limit"] = KEPT
        return state

    def dump(self, state):
        return {name: part for name, part in state.items() if name != "limit"} | {"minutes": sorted(state["minutes"])}

    def _forget(self, state, us):
        """What no row from ``us`` on can meet."""
        state["clocks"] = {e: t for e, t in state["clocks"].items() if us - t < SUPPRESSION_US}
        low = us // 60_000_000 - DAY_MINUTES
        state["minutes"].difference_update([m for m in state["minutes"] if m[0] < low])

    def prune(self, state, watermark_us):
        self._forget(state, watermark_us)
        longest = max(r[0] for r in self.rules)
        lanes = {lane: {v: t for v, t in times.items() if watermark_us - t[-1] <= longest} for lane, times in state.get("times", {}).items()}
        state["times"] = {lane: times for lane, times in lanes.items() if times}


def _settings(rules: Sequence[Rule]) -> list[tuple]:
    out = [(r.window_us, r.threshold, r.distinct_field is not None, r.preceded_by is not None, r.preceded_by is None)
           for r in rules]
    return out + [(1, 1, False, False, False)] * 2


def rule_triggers(events: DataFrame, rules: Sequence[Rule] = RULES, off_hours: bool = True) -> DataFrame:
    """``rule, us, seq, id`` of emitted alerts on a stream with a watermark on ``timestamp``."""
    source = timed(events)
    entity = F.to_json(F.struct(*ENTITY)).alias("entity")
    plain = [i for i, r in enumerate(rules) if r.preceded_by is None]
    base = ["timestamp", "us", "seq", "id"]
    parts = []
    if plain:
        rows = tag(source, rules, plain, [*base, "minute", *ENTITY])
        value, _ = distinct_value(rules, plain)
        no = F.lit(False)
        scope, lane = F.col("key"), F.lit("")
        for number, fields in crossing_scopes(rules).items():
            crosses = F.col("rule") == number
            scope = F.when(crosses, F.array(*[F.col(f) for f in fields]).cast("array<string>")).otherwise(scope)
            lane = F.when(crosses, F.to_json(F.struct("key"))).otherwise(lane)
        parts.append(rows.select(F.to_json(F.struct("rule", scope.alias("key"))).alias("group"), *base, body(
            "rule", "minute", entity, value.alias("value"), no.alias("before"), no.alias("known"), lane.alias("lane"))))
    for i, rule in enumerate(rules):
        if rule.preceded_by is None:
            continue
        *head, last = rule.group_by
        group = F.to_json(F.struct(F.lit(i).alias("rule"), F.array(*head).alias("key"))).alias("group")
        for test, before in ((equals_all(rule.preceded_by), True), (predicate(rule), False)):
            # Null and empty names are told apart by a prefix; the empty text stands for null.
            name = F.when(F.col(last).isNotNull(), F.concat(F.lit("="), F.col(last)))
            parts.append(source.where(test).select(group, *base, body(
                F.lit(i).alias("rule"), F.lit(None).cast("bigint").alias("minute"), entity, name.alias("value"),
                F.lit(before).alias("before"), F.col(last).isNotNull().alias("known"), F.lit("").alias("lane"))))
    if off_hours:
        number = F.lit(len(rules) + 1).alias("rule")
        parts.append(off_hours_logins(source).select(
            F.to_json(F.struct(number, F.array(*ENTITY).alias("key"))).alias("group"), *base,
            body(number, F.lit(None).cast("bigint").alias("minute"), entity, F.lit(None).cast("string").alias("value"),
                 F.lit(False).alias("before"), F.lit(False).alias("known"), F.lit("").alias("lane"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = in_order(rows, RuleProcessor(_settings(rules)))
    return found.select(F.from_json("result", "rule int").getField("rule").alias("rule"), "us", "seq", "id")


class NewSourceProcessor(OrderedProcessor):
    """Per user: the sources known so far, until one alert was raised."""

    def __init__(self, baseline: int = BASELINE_SOURCES):
        self.baseline = baseline

    def step(self, state, us, body):
        if state.get("done"):
            return None
        known = state.setdefault("known", [])
        if body["src_ip"] in known:
            return None
        if len(known) >= self.baseline and body["external"]:
            state["done"], state["known"] = True, []
            return {"src_ip": body["src_ip"], "known": sorted(known)}
        known.append(body["src_ip"])
        return None


def rare_sources(events: DataFrame, baseline: int = BASELINE_SOURCES, logins_only: bool = True) -> DataFrame:
    """``user, src_ip, known, us, seq, id``: first new external source per user."""
    used = timed(events).where(has_text("user") & has_text("src_ip") & (F.col("status") == "success"))
    if logins_only:
        used = used.where(F.col("event_type") == "ssh_login")
    rows = used.select(F.col("user").alias("group"), "timestamp", "us", "seq", "id",
                       body("src_ip", is_external_ip("src_ip").alias("external")))
    found = in_order(rows, NewSourceProcessor(baseline))
    r = F.from_json("result", "src_ip string, known array<string>")
    return found.select(F.col("group").alias("user"), r.getField("src_ip").alias("src_ip"),
                        r.getField("known").alias("known"), "us", "seq", "id")


class NewProcessProcessor(OrderedProcessor):
    """Per entity: the processes it has run."""

    def step(self, state, us, body):
        known = state.setdefault("known", [])
        if body["proc"] in known:
            return None
        known.append(body["proc"])
        if len(known) > 1 and body["suspicious"]:
            return {"proc": body["proc"]}
        return None


def new_processes(events: DataFrame) -> DataFrame:
    """``entity, proc, us, id``: first run of a process with a suspicious command."""
    entity = F.coalesce(present("user"), present("asset"), F.lit("unknown"))
    suspicious = F.lit(False)
    for text in SUSPICIOUS_COMMANDS:
        suspicious = suspicious | F.lower("command_line").contains(text)
    rows = timed(events).where(has_text("process_name") & has_text("command_line")).select(
        entity.alias("group"), "timestamp", "us", "seq", "id",
        body(F.lower("process_name").alias("proc"), suspicious.alias("suspicious")),
    )
    found = in_order(rows, NewProcessProcessor())
    return found.select(F.col("group").alias("entity"), F.from_json("result", "proc string").getField("proc").alias("proc"), "us", "id")


def off_hours_stream(events: DataFrame) -> DataFrame:
    """Privileged successes outside business hours; no state."""
    return timed(events).where(off_hours_privileged("us"))

"""Rows for the tests, and what the rules must raise, stated as conditions instead of a walk through the events."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from functools import cache

from palisade.rules import OFF_HOURS, RARE_SOURCE, RULES
from palisade.schema import ALERT_SCHEMA, EVENT_SCHEMA

BASE = datetime(2025, 9, 15, 12, 0, tzinfo=timezone.utc)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SECOND, MINUTE, QUARTER = 1_000_000, 60_000_000, 15 * 60_000_000


def us(at):
    return (at - EPOCH) // timedelta(microseconds=1)


def event(i, seconds=None, **over):
    at = over.pop("timestamp", BASE + timedelta(seconds=i if seconds is None else seconds))
    plain = {"id": f"e{i:05d}", "timestamp": at, "utc_offset": 0, "source": "linux_auth", "event_type": "ssh_login", "asset": "crane-2",
             "user": "nadia", "src_ip": "172.16.4.8", "status": "success", "message": "routine", "raw_log": f"line {i}", "seq": i,
             "event_date": at.date()}
    return {f.name: None for f in EVENT_SCHEMA.fields} | plain | over


def alert(i, minutes=None, **over):
    at = over.pop("timestamp", BASE + timedelta(minutes=i if minutes is None else minutes))
    plain = {"alert_id": f"A{i:04d}", "rule_id": "R-ANY", "title": f"alert number {i}", "severity": "high", "confidence": 0.5, "tactic": "Discovery",
             "technique": "T1000", "timestamp": at, "utc_offset": 0, "asset": "crane-2", "user": "nadia", "src_ip": "172.16.4.8",
             "event_ids": [f"e{i:05d}"], "evidence": [f"seen {i}"], "recommended_action": "Look at it.", "emit_us": us(at), "emit_seq": i,
             "emit_rule": 0}
    return plain | over


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[name] for name in schema.names) for r in rows], schema)


def event_frame(spark, rows):
    return frame(spark, rows, EVENT_SCHEMA)


def alert_frame(spark, rows):
    return frame(spark, rows, ALERT_SCHEMA)


def hashed(*parts):
    return "AL-" + hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:10].upper()


def local_minute(e):
    return (us(e["timestamp"]) + e["utc_offset"] * SECOND) // MINUTE


def place(e):
    return us(e["timestamp"]), e["seq"]


def entity(e):
    return e["src_ip"], e["user"], e["asset"]


def fits(rule, e):
    tests = [e[name] == wanted for name, wanted in rule.field_equals.items()]
    tests += [any(map((e[name] or "").lower().__contains__, texts)) for name, texts in rule.contains.items()]
    tests += [re.search("|".join(f"(?:{p})".replace("(?i)", "") for p in patterns), e[name] or "", re.IGNORECASE) for name, patterns in rule.regex.items()]
    return all(tests)


def public(address):
    try:
        found = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    return found.is_global and not found.is_multicast and not found.is_reserved


def candidates_of(events, rules):
    """``rule number, event, members in list order, key or None``: each event at which a rule's conditions hold. The key
    stands for the limit of one alert a minute."""
    for number, rule in enumerate(rules):
        width = rule.time_window_minutes * MINUTE
        hits = [e for e in events if fits(rule, e)]
        if rule.preceded_by:
            failures = defaultdict(list)
            for e in events:
                if rule.preceded_by.items() <= e.items():
                    failures[e["src_ip"], e["user"]].append(e)
            for e in hits:
                known = [g for g in failures if g in {(e["src_ip"], e["user"]), (e["src_ip"], None)}]
                before = [f for g in known for f in failures[g] if place(f) <= place(e) and us(f["timestamp"]) >= us(e["timestamp"]) - width]
                if len(before) >= rule.threshold:
                    yield number, e, [*before, e], None
            continue
        lanes = defaultdict(list)
        for e in hits:
            lanes[tuple(e[name] for name in rule.group_by)].append(e)
        for key, lane in lanes.items():
            starts = [us(e["timestamp"]) for e in lane]
            for n, e in enumerate(lane):
                window = lane[bisect_left(starts, starts[n] - width) : n + 1]
                count = len({w[rule.distinct_field] for w in window if w[rule.distinct_field]}) if rule.distinct_field else len(window)
                if count >= rule.threshold:
                    yield number, e, window, key
    for e in events:
        hour = (us(e["timestamp"]) + e["utc_offset"] * SECOND) // (60 * MINUTE) % 24
        if (e["event_type"], e["status"]) == ("ssh_login", "success") and e["user"] in {"root", "admin", "administrator"} and hour in {*range(7), *range(20, 24)}:
            yield len(rules) + 1, e, [e], None


def raised(events, rules=RULES):
    """``alert_id, rule_id, event_ids, evidence`` of all alerts.

    A candidate is raised if and only if no raised candidate of its rule before it shares its key and clock minute, or its
    entity less than 15 minutes ago.
    """
    events = sorted(events, key=place)
    found = sorted(candidates_of(events, rules), key=lambda c: (c[0], place(c[1])))
    rivals = defaultdict(list)
    for n, (number, e, _, key) in enumerate(found):
        rivals[number, "entity", entity(e)].append(n)
        if key is not None:
            rivals[number, "minute", key, local_minute(e)].append(n)

    @cache
    def stands(n):
        number, e, _, key = found[n]
        same_entity = (m for m in rivals[number, "entity", entity(e)] if m < n and us(e["timestamp"]) - us(found[m][1]["timestamp"]) < QUARTER)
        same_minute = (m for m in rivals[number, "minute", key, local_minute(e)] if m < n) if key is not None else ()
        return not any(stands(m) for group in (same_entity, same_minute) for m in group)

    shown = ("asset", "user", "src_ip", "dst_ip", "process_name", "command_line", "message")
    out = []
    for n, (number, e, members, _) in enumerate(found):
        if stands(n):
            if number > len(rules):
                out.append((hashed(OFF_HOURS.rule_id, e["id"]), OFF_HOURS.rule_id, [e["id"]], [e["raw_log"]]))
            else:
                ids = [m["id"] for m in members]
                texts = ["; ".join(f"{name}={m[name]}" for name in shown if m[name]) for m in members][-10:]
                out.append((hashed(rules[number].rule_id, *ids), rules[number].rule_id, ids, texts))
    return out + list(rare_logins(events))


def rare_logins(events):
    logins = [e for e in events if (e["event_type"], e["status"]) == ("ssh_login", "success") and e["user"] and e["src_ip"]]
    first = {}
    for e in logins:
        first.setdefault((e["user"], e["src_ip"]), e)
    for user in Counter(e["user"] for e in logins):
        ranked = sorted((e for (name, _), e in first.items() if name == user), key=place)
        rare = next((n for n, e in enumerate(ranked) if n >= 3 and public(e["src_ip"])), None)
        if rare is not None:
            e, known = ranked[rare], sorted(x["src_ip"] for x in ranked[:rare])
            text = f"user={user}; src_ip={e['src_ip']}; known={known}"
            yield hashed(RARE_SOURCE.rule_id, user, e["src_ip"]), RARE_SOURCE.rule_id, [e["id"]], [text]


def groups(alerts):
    """Sets of alert ids: the classes of the closure of "within half an hour and alike in something"."""
    def linked(a, b):
        alike = a["tactic"] == b["tactic"] or {(k, a[k]) for k in ("asset", "user", "src_ip") if a[k]} & {(k, b[k]) for k in ("asset", "user", "src_ip")}
        return bool(alike) and abs(us(a["timestamp"]) - us(b["timestamp"])) <= 2 * QUARTER

    root = list(range(len(alerts)))
    for i, a in enumerate(alerts):
        for j in range(i):
            if root[i] != root[j] and linked(a, alerts[j]):
                root = [root[i] if r == root[j] else r for r in root]
    classes = defaultdict(set)
    for a, r in zip(alerts, root):
        classes[r].add(a["alert_id"])
    return {frozenset(c) for c in classes.values()}

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.functions.timeparse import iso_text, with_iso
from palisade.sources.lines import read_json_items, read_log_lines, unwrap_payloads
from palisade.sources.normalize import normalize_logs, parse_lines, parser_stats
from palisade.streaming import ingest

def parse(spark, lines, **options):
    raw = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "raw string, seq bigint")
    events, bad = normalize_logs(raw, reference_year=2026, ingest_time=F.lit("2026-07-01").cast("timestamp"), **options)
    return events.orderBy("seq").collect(), bad.orderBy("seq").collect()


def test_formats(spark):
    cases = [
        ("Oct  2 06:07:08 quay-4 sshd[812]: Failed password for invalid user bo from 172.20.1.9 port 4022 ssh2",
         dict(source="linux_auth", event_type="ssh_login", asset="quay-4", user="bo", src_ip="172.20.1.9", status="failure", timestamp=datetime(2026, 10, 2, 6, 7, 8))),
        ("oct 12 23:59:59 quay-4 sshd[1]: Accepted keyboard-interactive for per from 192.0.2.77 port 1 ssh2",
         dict(user="per", src_ip="192.0.2.77", status="success", timestamp=datetime(2026, 10, 12, 23, 59, 59))),
        ("Dec 31 00:00:00 q sshd[77]: Received disconnect", dict(status="unknown", user=None, src_ip=None, timestamp=datetime(2026, 12, 31))),
        ('WinEvent Time=2026-05-06T07:08:09Z Host=till-1 EventID=1 User=per Process=PowerShell.EXE CommandLine="a b" Tail=1',
         dict(source="windows", event_type="powershell_execution", asset="till-1", process_name="PowerShell.EXE", command_line="a b", status="success")),
        ("WINEVENT time=2026-05-06T01:08:09-06:00 host=till-1 eventid=4732 user=per",
         dict(event_type="admin_account_change", process_name=None, command_line="", utc_offset=-21600, timestamp=datetime(2026, 5, 6, 7, 8, 9))),
        ("winevent Time=2026-05-06T07:08:09Z Host=till-1 EventID=5 User=per", dict(event_type="windows_event")),
        ('2026-05-06T07:08:09Z wall-2 FW action=Drop src=172.20.1.9 dst=172.20.2.2 dpt=53 proto=UDP msg="no names"',
         dict(source="firewall", event_type="network_connection", asset="wall-2", dst_ip="172.20.2.2", status="drop", message="no names dst_port=53 proto=UDP")),
        ('172.20.3.3 - per [06/May/2026:07:08:09 -0300] "PUT /cart HTTP/2" 503 0 "kiosk 7"',
         dict(source="waf", event_type="http_request", asset="web01", status="503", message="PUT /cart user_agent=kiosk 7", timestamp=datetime(2026, 5, 6, 7, 8, 9))),
        ('{"source":"badge","event_type":"door","asset":"gate","status":null,"raw_log":"beep"}',
         dict(source="badge", event_type="door", asset="gate", raw_log="beep", status=None, timestamp=datetime(2026, 7, 1))),
        ("tide table for today", dict(source="unknown", event_type="unknown", message="tide table for today")),
        ("y\u0001" + '172.20.3.3 - - [06/May/2026:07:08:09 +0000] "GET /m\u0001n HTTP/1.1" 200 5 "K"',
         dict(message="GET /m\u0001n user_agent=K", src_ip="y\u0001172.20.3.3")),
    ]
    events, bad = parse(spark, [line for line, _ in cases])
    assert not bad and len(events) == len(cases)
    for (line, want), got in zip(cases, events):
        assert {name: got[name] for name in want} == want, line


def test_web_offset_can_be_honoured(spark):
    line = '172.20.3.3 - - [06/May/2026:07:08:09 -0330] "GET / HTTP/1.1" 200 1 "K"'
    event = parse(spark, [line], honour_web_offset=True)[0][0]
    assert (event.timestamp, event.utc_offset) == (datetime(2026, 5, 6, 10, 38, 9), -12600)


def test_quarantine(spark):
    needs, time = "event requires source and event_type", "bad timestamp"
    cases = [
        ("\t ", "empty log line"), ('{"source": "badge"', "bad json"), ('{"event_type": "door"}', needs), ('{"source": "badge", "event_type": ""}', needs),
        ("Feb 29 01:02:03 q sshd[1]: Accepted none", time), ("Xyz  1 01:02:03 q sshd[1]: Accepted none", time),
        ('172.20.3.3 - - [31/Apr/2026:01:02:03 +0000] "GET / HTTP/1.1" 200 1 "K"', time), ("B" * 50_000, None),
    ]
    events, bad = parse(spark, [line for line, _ in cases])
    assert [b.reason for b in bad] == [reason for _, reason in cases if reason]
    assert [len(e.message) for e in events] == [50_000]
    _, bad = parse(spark, ["C" * 10_240, "C" * 10_241, "ü" * 5_121], max_raw_bytes=10_240)
    assert [b.reason for b in bad] == ["oversize", "oversize"]


def test_statistics(spark):
    raw = spark.createDataFrame([(f"odd {i} " + "z" * 300, i) for i in range(12)] + [("", 20), ('{"source":"a","event_type":"b"}', 21)], "raw string, seq bigint")
    row = parser_stats(parse_lines(raw)).first()
    assert (row.parsed_events, row.parsing_failed_events, row.unknown_events) == (1, 1, 12)
    assert len(row.unknown_samples) == 10 and all(len(s) == 200 for s in row.unknown_samples)
    assert row.unknown_samples[0].startswith("odd 0 ")


@pytest.mark.parametrize("text", [
    "2026-06-11T12:06:00Z", "2026-06-11T12:06:00.123456+02:00", "2026-06-11 12:06:00", "2026-06-11", "20260611T120600",
    "20260611T120600-0330", "2026-06-11T12", "2026-06-11T12:06", "2026-06-11T12:06+01:00", "2026-06-11T12:06:00,5Z",
    "12:00", "2026", "1718100000", "not a time", "2026-13-01T00:00:00Z", "2026-06-11T25:00:00", " 2026-06-11T12:06:00Z ", "",
])
def test_times_read_as_the_standard_library_reads_them(spark, text):
    df = spark.createDataFrame([(text,)], "x string")
    row = with_iso(df, "x", "at", "off").select("*", iso_text("unix_micros(at)", "off").alias("iso")).first()
    try:
        want = datetime.fromisoformat(text.strip())
    except ValueError:
        assert (row["at"], row["off"]) == (None, None)
        return
    offset = want.utcoffset()
    assert row["off"] == (offset.total_seconds() if offset else 0)
    assert row["at"] == (want - offset if offset else want).replace(tzinfo=None)
    assert row["iso"] == (want.isoformat() if offset is not None else want.isoformat() + "+00:00")


def test_ids_do_not_depend_on_how_files_are_read(spark, tmp_path):
    line = "Oct  2 06:07:08 quay sshd[9]: Failed password for per from 172.20.1.9 port 9 ssh2"
    (tmp_path / "a.log").write_text("\n".join([line, "", line, "  other  ", line]) + "\n")
    (tmp_path / "b.log").write_bytes(line.encode() + b"\n\xff\xfe bad bytes\n")
    once = normalize_logs(read_log_lines(spark, str(tmp_path)))[0].select("id").collect()
    again = normalize_logs(read_log_lines(spark, str(tmp_path)).repartition(3))[0].select("id").collect()
    assert len({r.id for r in once}) == 6 and {r.id for r in once} == {r.id for r in again}


def test_envelopes(spark):
    cases = [
        ('{"logs": ["r", {"n": 7}, null]}', ["r", '{"n":7}', None]), ('{"events": [{"m": "x"}]}', ['{"m":"x"}']), ('{"door": true}', ['{"door": true}']),
        ('["s", "t\\"u"]', ["s", 't"u']), ("[]", []), ('{"logs": []}', []), (" [ ] ", []),
    ]
    broken = {"{": "invalid json body", '["s"]]': "invalid json body", '{"a": 1} tail': "invalid json body", "17": "body must be a JSON object or list",
              '{"logs": null}': "body must be a JSON object or list", '{"events": {"m": 1}}': "body must be a JSON object or list"}
    bodies = [body for body, _ in cases] + list(broken)
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, payload string")
    rows = unwrap_payloads(df).orderBy("n", "item").collect()
    for n, (body, items) in enumerate(cases):
        assert [(r.item, r.raw, r.payload_error) for r in rows if r.n == n] == [(i, x, None) for i, x in enumerate(items)], body
    assert {r.raw: r.payload_error for r in rows if r.n >= len(cases)} == broken
    assert len(rows) == sum(len(items) for _, items in cases) + len(broken)


def test_json_files_lose_and_invent_nothing(spark, tmp_path):
    for name, text in {"a": '["one", {"source": "badge", "event_type": "door"}]', "b": "[", "c": "[]", "d": '{"events": []}', "e": '"text"', "f": "[null]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    events, bad = normalize_logs(read_json_items(spark, str(tmp_path)))
    assert sorted(e.raw_log for e in events.select("raw_log").collect()) == ["None", "one", '{"source":"badge","event_type":"door"}']
    assert sorted((b.raw, b.reason) for b in bad.collect()) == [('"text"', "body must be a JSON object or list"), ("[", "invalid json body")]


def test_arrival_numbers_of_micro_batches(spark):
    """Batches late in a stream's life, and with many read tasks, keep their order and do not overlap."""
    rows = spark.range(0, 1000, 1, 7).select(F.monotonically_increasing_id().alias("seq"), "id")
    late = [ingest.numbered(rows, n).select("seq", "id").orderBy("seq").collect() for n in (32_767, 32_768, 5_000_000)]
    for batch in late:
        assert [r.id for r in batch] == list(range(1000)) and batch[-1].seq - batch[0].seq == 999
    assert late[0][-1].seq < late[1][0].seq < late[1][-1].seq < late[2][0].seq

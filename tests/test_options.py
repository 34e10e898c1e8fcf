import json

import pytest

from tidemark.options import OptionError, Options, resolve
from tidemark.sources import status


def test_layers():
    assert resolve() == Options()
    assert resolve({"rate": "2s"}, {"rate": 500, "regex": True}).rate == 2000
    made = resolve(None, '[flags]\nretention = "20m"\ntemperature_type = "f"\n[filters.disk]\nlist = ["sd"]\nis_list_ignored = false\n')
    assert (made.retention, made.temperature_type, made.filters["disk"].items) == (1_200_000, "fahrenheit", ("sd",))
    assert made.zoomed(60_000, 1000) == 1_200_000 and made.zoomed(60_000, -1000) == 30_000


@pytest.mark.parametrize("bad", [{"rate": 249}, {"rate": "soon"}, {"default_time_value": 29_999}, {"default_time_value": 700_000}, {"time_delta": 1}, {"time_delta": 600_001}, {"temperature_type": "x"}, {"nothing": 1}, {"regex": "yes"}])
def test_rejected(bad):
    with pytest.raises(OptionError):
        resolve(bad)
    with pytest.raises(OptionError):
        resolve(None, "= broken")


def test_status_and_places(spark, tmp_path):
    for key, text in (("s1", json.dumps({"session_id": "s1", "transcript_path": "/t/one.jsonl", "rate_limits": {"five_hour": {"used_percentage": 5.0}}})), ("-home-x", json.dumps({"session_id": "s2"})), ("s3", "{oops")):
        (tmp_path / f"{key}.json").write_text(text)
    rows = spark.createDataFrame([(1, "s1", "/a", 5), (2, "s2", "/home/x", 9), (3, "s3", "/b", 7)], "pid int, sessionId string, cwd string, updatedAt long")
    made = status.with_status(rows, status.read_status(spark, str(tmp_path)))
    logs = spark.createDataFrame([("/p/-home-x/s2.jsonl",), ("/p/z/s2.jsonl",), ("/p/z/s3.jsonl",), ("/p/z/s3/subagents/agent-1.jsonl",)], "path string")
    got = {r.sessionId: (r.status and r.status.session_id, r.log_path) for r in status.locate_logs(made, logs).collect()}
    assert got == {"s1": ("s1", "/t/one.jsonl"), "s2": ("s2", "/p/-home-x/s2.jsonl"), "s3": (None, "/p/z/s3.jsonl")}
    assert status.rate_limits(made).first().rate_limits.five_hour.used_percentage == 5.0
    assert [tuple(r) for r in status.subagent_logs(logs).collect()] == [("s3", "/p/z/s3/subagents/agent-1.jsonl")]

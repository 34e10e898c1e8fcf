import pytest
from pyspark.sql import functions as F

from tidemark.functions import durations, parsers, texts, units


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def vectors():
    return [
        (durations.format_duration(F.lit(500)), "0.500s"), (durations.format_duration(F.lit(60_000)), "1m 0.00s"), (durations.format_duration(F.lit(3_661_000)), "1h 1m 1s"), (durations.format_duration(F.lit(86_400_000)), "1d 0h 0m"),
        (durations.iso_to_ms(F.lit("2026-08-24T20:26:13.919Z")), 1787603173919), (durations.iso_to_ms(F.lit("2026-08-24T20:26:13.9Z")), 1787603173900), (durations.iso_to_ms(F.lit("2026-08-24T20:26:13Z")), 1787603173000),
        (durations.iso_to_ms(F.lit("2026-08-24T20:26:13+02:00")), None), (durations.iso_to_ms(F.lit("2026-13-24T20:26:13Z")), None), (durations.iso_to_ms(F.lit("2026-08-24T25:26:13Z")), None), (durations.iso_to_ms(F.lit("1969-08-24T20:26:13Z")), None), (durations.iso_to_ms(F.lit("2026-08-24")), None), (durations.iso_to_ms(F.lit("")), None),
        (units.format_bytes(F.lit(1023), True), "1023B"), (units.format_bytes(F.lit(1024), True), "1KiB"), (units.format_bytes(F.lit(5 * 2**29), True), "2.5GiB"), (units.format_bytes(F.lit(int(10.34 * 2**40)), True), "10.3TiB"),
        (units.format_bytes(F.lit(999), suffix="/s"), "999B/s"), (units.format_bytes(F.lit(1000), suffix="/s"), "1KB/s"), (units.format_bytes(F.lit(10**9), suffix="/s"), "1.0GB/s"),
        (texts.binary_name(F.lit("/usr/bin/btm:")), "btm"), (texts.binary_name(F.lit("firefox -contentproc -x")), "firefox"),
        (units.temperature(F.lit(100.0), "kelvin"), 374), (units.temperature(F.lit(100.0), "fahrenheit"), 212),
        (units.temperature_ceiling(F.lit(40.0)), 100.0), (units.temperature_ceiling(F.lit(120.0)), 120.0), (units.temperature_ceiling(F.lit(150.0), limit=80), 80.0),
        (units.abbreviate(F.lit(999)), "999"), (units.abbreviate(F.lit(12345)), "12.3k"), (units.abbreviate(F.lit(51722228)), "51.7M"),
        (texts.last_part(F.lit("/Users/x/code/")), "code"), (texts.last_part(F.lit("/")), "/"), (texts.unescape_mount(F.lit("Samsung\\040980")), "Samsung 980"),
        (texts.slug(F.lit("/a.b/c_d")), "-a-b-c-d"), (texts.fold(F.lit("X-OPUS-4")), "Opus"), (texts.fold(F.lit("other")), "Other"), (texts.pane(F.lit("a:1.2")), "2"),
        (units.cpu_quota(F.lit("200000 100000")), 2.0), (units.cpu_quota(F.lit("max 100000")), None), (units.saturating_log2(F.lit(-1.0)), 0.0), (units.percent(F.lit(1), F.lit(0)), None),
        (texts.state_name(F.lit("Z")), "Zombie"), (texts.ellipsis(F.lit("abcdef"), 4), "abc…"), (texts.process_command(F.lit("x"), F.lit("")), "[x]"),
    ]


def test_vectors(spark):
    columns, expected = zip(*vectors())
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    for g, e in zip(got, expected):
        assert g == (pytest.approx(e) if isinstance(e, float) else e)


def test_parsers(spark):
    idle = one(spark, parsers.cpu_times(F.lit("100 0 100 100 20 30 40 50")))
    assert (idle["idle"], idle["non_idle"]) == (120, 320)
    assert one(spark, parsers.cpu_times(F.lit("cpu  100 0 100 100 20 30 40 50")))["non_idle"] == 320
    stat = "12 (a) b) S 1 0 0 0 0 2097152 0 0 0 0 7 8 0 0 20 5 1 0 99 1000 3 " + "0 " * 20
    got = one(spark, parsers.stat_fields(F.lit(stat)))
    assert (got["pid"], got["comm"], got["state"], got["ppid"], got["is_kernel"], got["utime"], got["stime"], got["priority"], got["nice"], got["start_time"], got["vsize"], got["rss"]) == (12, "a) b", "S", 1, True, 7, 8, 20, 5, 99, 1000, 3)
    assert one(spark, parsers.io_fields(F.lit("rchar: 1\nread_bytes: 5\nwrite_bytes: 6\n"))) == (5, 6)
    assert one(spark, parsers.disk_counters(F.lit("   8  0 sda 1 2 3 4 5 6 7 8"))) == ("sda", 1536, 3584)
    assert one(spark, parsers.mount_fields(F.lit("/dev/sda1 /mnt/a\\040b ext4 rw 0 0"))) == ("/dev/sda1", "/mnt/a b", "ext4")
    assert one(spark, parsers.partition_fields(F.lit(" 8 1 10 sda1"))) == ("sda1", 10240)
    assert one(spark, parsers.partition_fields(F.lit("major minor  #blocks  name")))["name"] is None
    assert one(spark, parsers.arc_size(F.lit("name type data\nc_min 4 5\nsize 4 77\nc_max 4 9\n"))) == (77, 9, 5)


def test_durations_of_text():
    assert durations.parse_duration_ms("1h") == 3_600_000 and durations.parse_duration_ms("5m 3s") == 303_000 and durations.option_ms("250") == 250
    for bad in ("", "abc", "5", "5 parsecs"):
        with pytest.raises(ValueError):
            durations.parse_duration_ms(bad)

"""Sort rules of every column, and the schema of the options."""

import json
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from tidemark import options_schema
from tidemark.operators import orders, views
from tidemark.options import OptionError, Options, resolve

ROWS = [
    dict(pid=3, name="bash", command="/b", user="root", state="Sleep", cpu_percent=1.5, mem_bytes=10, mem_percent=0.1, time=5, nice=0),
    dict(pid=1, name="Alpha", command="/C", user=None, state="Zombie", cpu_percent=1.5, mem_bytes=None, mem_percent=9.9, time=5, nice=-5),
    dict(pid=2, name="ALPHA", command="/a", user="adm", state="Running", cpu_percent=99.0, mem_bytes=30, mem_percent=0.3, time=1, nice=19),
    dict(pid=4, name="zsh", command="/d", user="Zed", state="Running", cpu_percent=None, mem_bytes=20, mem_percent=0.2, time=9, nice=0),
]
# fixed values: (column, direction or None for the first one, ids in order)
PROCESSES = [
    ("cpu_percent", None, [2, 1, 3, 4]), ("cpu_percent", False, [4, 1, 3, 2]), ("mem_bytes", None, [2, 4, 3, 1]), ("mem_percent", None, [2, 4, 3, 1]), ("pid", None, [1, 2, 3, 4]),
    ("pid", True, [4, 3, 2, 1]), ("name", None, [1, 2, 3, 4]), ("name", True, [4, 3, 1, 2]), ("command", None, [2, 3, 1, 4]), ("user", None, [1, 4, 2, 3]), ("user", True, [3, 2, 4, 1]),
    ("state", None, [2, 4, 3, 1]), ("time", None, [2, 1, 3, 4]), ("time", True, [4, 1, 3, 2]), ("nice", None, [1, 3, 4, 2]),
]


@pytest.fixture(scope="module")
def processes(spark):
    schema = "pid int, name string, command string, user string, state string, cpu_percent double, mem_bytes long, mem_percent double, time long, nice int"
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], schema).cache()


@pytest.mark.parametrize("column, descending, want", PROCESSES)
def test_processes(processes, column, descending, want):
    assert [r.pid for r in orders.PROCESSES.sorted(processes, column, descending).collect()] == want


def test_places(processes):
    got = {r.pid: r.position for r in orders.PROCESSES.numbered(processes, "name", True).collect()}
    assert got == {4: 1, 3: 2, 1: 3, 2: 4}
    with pytest.raises(ValueError, match="colour"):
        orders.PROCESSES.keys("colour")


def test_other_tables(spark):
    disks = spark.createDataFrame([("b", "/", 5, None), ("a", "/x", 5, 2.0), ("a", "/", None, 7.0)], "name string, mount_point string, used long, read_rate double")
    order = lambda o, df, c, d=None: [tuple(r)[:2] for r in o.sorted(df, c, d).collect()]
    assert order(orders.DISKS, disks, "used") == [("a", "/x"), ("b", "/"), ("a", "/")]
    assert order(orders.DISKS, disks, "name") == [("a", "/"), ("a", "/x"), ("b", "/")]
    assert order(orders.DISKS, disks, "read_rate") == [("a", "/"), ("a", "/x"), ("b", "/")]
    heat = spark.createDataFrame([("s1", None), ("s3", 40), ("s2", 40)], "name string, value int")
    assert order(orders.TEMPERATURES, heat, "value") == [("s2", 40), ("s3", 40), ("s1", None)]
    sessions = spark.createDataFrame([("n1", "s1", "Haiku", 5), ("n2", "s2", None, 9), ("n3", "s3", "Opus", 5)], "name string, session string, model string, tokens long")
    assert [r.session for r in orders.SESSIONS.sorted(sessions, "model").collect()] == ["s2", "s3", "s1"]
    assert [r.session for r in orders.SESSIONS.sorted(sessions, "tokens").collect()] == ["s2", "s1", "s3"]


def test_first_directions():
    sorting = views.Sorting(orders.PROCESSES.defaults(), "cpu_percent")
    assert sorting.descending and not sorting.choose("name").descending and not sorting.choose("cpu_percent").descending
    assert len(orders.PROCESSES.rules) == 20 and len(orders.DISKS.rules) == 9 and len(orders.SESSIONS.rules) == 8


def test_schema_describes_every_option():
    made = options_schema.schema()
    flags = made["properties"]["flags"]["properties"]
    assert set(flags) == {f.name for f in fields(Options)} - {"filters"}
    assert all(x["description"].endswith(".") and "default" in x for x in flags.values())
    assert json.loads(json.dumps(made)) == made
    assert options_schema.problems({"flags": {k: v["default"] for k, v in flags.items()}}) == []
    default = Options()
    assert all(flags[k]["default"] == getattr(default, k) for k in flags)


# fixed values: (configuration, what is wrong with it)
BAD = [
    ({"flags": {"rate": 100}}, ["flags.rate: must be at least 250 milliseconds"]),
    ({"flags": {"rate": "100ms"}}, ["flags.rate: must be at least 250 milliseconds"]),
    ({"flags": {"rate": True, "tree": "yes"}}, ["flags.rate: must be integer or string", "flags.tree: must be boolean"]),
    ({"flags": {"temperature_type": "rankine"}}, ["flags.temperature_type: must be one of celsius, kelvin, fahrenheit, c, k, f"]),
    ({"flags": {"speed": 1}, "colours": {}}, ["flags.speed: unknown", "colours: unknown"]),
    ({"filters": {"disk": {"list": ["a", 5], "regex": 1, "mode": 2}}}, ["filters.disk.list[1]: must be string", "filters.disk.regex: must be boolean", "filters.disk.mode: unknown"]),
    ({"flags": []}, ["flags: must be object"]),
]


@pytest.mark.parametrize("config, want", BAD)
def test_bad_configurations_are_named_by_path(config, want):
    assert options_schema.problems(config) == want


def test_good_configurations_resolve():
    text = '[flags]\nrate = "2s"\ntemperature_type = "K"\n[filters.disk]\nlist = ["loop"]\nregex = true\n'
    assert options_schema.problems(text) == []
    assert resolve(config=text).rate == 2000 and resolve(config=text).temperature_type == "kelvin"
    assert options_schema.problems("rate = ")[0].startswith("not TOML")
    for config, _ in BAD[:3]:
        with pytest.raises(OptionError):
            resolve(config=config["flags"])
    assert F is not None

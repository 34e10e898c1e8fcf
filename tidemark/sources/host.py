"""Samples of a host as tables: each takes tables of what its files held (ts and text or counters) and gives rows of one
schema. Where a live collector would look at one thing and else at another, these coalesce, tick by tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsers, texts, units
from ..operators import filters, joins, rates
from ..operators.rates import First, Rounding, milliseconds


def _by_host(df: DataFrame) -> DataFrame:
    """Samples of one host have no column of that name; its rows are those of localhost."""
    return df if "host" in df.columns else df.withColumn("host", F.lit("localhost"))


def _host(df: DataFrame) -> list[str]:
    return ["host"] if "host" in df.columns else []


def cpu_rows(stat: DataFrame, average: bool = True) -> DataFrame:
    """(ts, core, idle, non_idle) of tables (ts, text) of /proc/stat: a row a core, and core -1 for the line of all. With a column
    host, rows are of that host; so it is with the other functions on samples."""
    lines = stat.select(*_host(stat), "ts", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"^cpu\d*\s"))
    number = F.regexp_extract("line", r"^cpu(\d*)\s", 1)
    core = F.when(number == "", -1).otherwise(number.try_cast("int")).alias("core")
    made = lines.select(*_host(stat), "ts", core, parsers.cpu_times(F.col("line")).alias("t")).select(*_host(stat), "ts", "core", "t.*")
    return made if average else made.filter(F.col("core") >= 0)


def cpu_usage(rows: DataFrame) -> DataFrame:
    """Percent of time that wasn't idle since the tick before, a gap at a core's first."""
    w = Window.partitionBy(*_host(rows), "core").orderBy("ts")
    busy, idle = (F.col(c) - F.lag(c).over(w) for c in ("non_idle", "idle"))
    return rows.withColumn("usage", F.try_divide(busy, busy + idle) * 100)


def memory_rows(meminfo: DataFrame, cgroups: DataFrame | None = None, show_cache: bool = False) -> DataFrame:
    """(ts, kind, used, total, percent) for RAM, SWP and, if asked for, CACHE of tables (ts, text) of /proc/meminfo.

    cgroups (ts, ram_used, ram_limit, swap_used, swap_limit) go before the host's own figures where they are known; a
    limit is the host's total at most. Kinds without any total aren't there."""
    at = [*_host(meminfo), "ts"]
    m = meminfo.select(*at, parsers.memory_fields(F.col("text")).alias("m")).select(*at, "m.*")
    known = {"ram_used": "g_ram_used", "ram_limit": "g_ram_limit", "swap_used": "g_swap_used", "swap_limit": "g_swap_limit"}
    if cgroups is not None:
        m = m.join(cgroups.select(*at, *[F.col(k).alias(v) for k, v in known.items()]), at, "left")
    else:
        m = m.withColumns({v: F.lit(None).cast("long") for v in known.values()})
    row = lambda kind, used, total: F.struct(F.lit(kind).alias("kind"), used.alias("used"), total.alias("total"))
    within = lambda limit, total: F.least(F.coalesce(F.col(limit), F.col(total)), F.col(total))
    kinds = [row("RAM", F.coalesce("g_ram_used", "used"), within("g_ram_limit", "total")), row("SWP", F.coalesce("g_swap_used", "swap_used"), within("g_swap_limit", "swap_total"))]
    if show_cache:
        kinds.append(row("CACHE", F.col("cache"), F.col("total")))
    long = m.select(*at, F.explode(F.array(*kinds)).alias("k")).select(*at, "k.*")
    return long.filter(F.col("total") > 0).withColumn("percent", units.percent(F.col("used"), F.col("total")))


def cgroup_memory(files: DataFrame) -> DataFrame:
    """(ts, ram_used, ram_limit, swap_used, swap_limit) of files (ts, v1_*, v2_* and the host's totals), version 1 first.

    Columns: v1_usage, v1_limit, v1_inactive, v1_memsw_usage, v1_memsw_limit, v2_current, v2_max, v2_inactive,
    v2_swap_current, v2_swap_max (text, may be 'max'), total_memory, total_swap. Inactive file pages don't count as
    used if there are fewer than are used. Version 1 tells memory and swap together, so swap is the difference."""
    c = F.col
    less = lambda used, inactive: F.when(c(inactive) < c(used), c(used) - c(inactive)).otherwise(c(used))
    v1 = c("v1_usage").isNotNull()
    both = F.least("v1_memsw_limit", c("total_memory") + c("total_swap"))
    own = F.coalesce(F.least("v1_limit", "total_memory"), F.lit(0))
    own = F.when(c("v1_limit").isNull(), F.lit(0)).otherwise(own)
    swap_limit = F.when(c("v1_memsw_limit").isNotNull(), F.greatest(both - own, F.lit(0)))
    swap_used = F.when(c("v1_memsw_usage").isNotNull(), F.greatest(c("v1_memsw_usage") - c("v1_usage"), F.lit(0)))
    return files.select(
        *_host(files),
        "ts",
        F.when(v1, less("v1_usage", "v1_inactive")).otherwise(less("v2_current", "v2_inactive")).alias("ram_used"),
        F.when(v1, c("v1_limit")).otherwise(c("v2_max").try_cast("long")).alias("ram_limit"),
        F.when(v1, swap_used).otherwise(c("v2_swap_current")).alias("swap_used"),
        F.when(v1, F.when(c("v1_memsw_usage").isNotNull(), swap_limit)).otherwise(c("v2_swap_max").try_cast("long")).alias("swap_limit"),
    )


def cgroup_cpu(files: DataFrame) -> DataFrame:
    """(ts, quota, percent) of files (ts, v1_quota, v1_period, v1_usage_ns, v2_max, v2_usage_us): cores that may be used,
    and the share of them that was since the tick before, 0 to 100; no share without a quota or at the first tick."""
    c = F.col
    v1 = c("v1_quota").isNotNull()
    q1 = F.when((c("v1_quota") > 0) & (c("v1_period") > 0), F.try_divide(c("v1_quota").cast("double"), c("v1_period").cast("double")))
    used = F.when(v1, F.floor(c("v1_usage_ns") / 1000)).otherwise(c("v2_usage_us"))
    rows = _by_host(files).select("host", "ts", F.when(v1, q1).otherwise(units.cpu_quota(c("v2_max"))).alias("quota"), used.cast("long").alias("used"))
    w = Window.partitionBy("host").orderBy("ts")
    micros = (milliseconds(c("ts")) - milliseconds(F.lag("ts").over(w))) * 1000
    delta = F.greatest(c("used") - F.lag("used").over(w), F.lit(0))
    share = F.try_divide(delta.cast("double"), micros * c("quota")) * 100
    return rows.select(*_host(files), "ts", "quota", F.when((micros > 0) & (c("quota") > 0), F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))).alias("percent"))


def network_totals(interfaces: DataFrame, names: dict | None = None) -> DataFrame:
    """(ts, rx_bits, tx_bits, rx_packets, tx_packets): sums of interfaces (ts, name and counters) that a list of names
    keeps (arguments of filters.keep). A tick without any has zeros."""
    kept = filters.keep(F.col("name"), **names) if names else F.lit(True)
    total = lambda c, by: F.coalesce(F.sum(F.when(kept, F.col(c) * by)), F.lit(0)).cast("long")
    return interfaces.groupBy(*_host(interfaces), "ts").agg(
        total("rx_bytes", 8).alias("rx_bits"), total("tx_bytes", 8).alias("tx_bits"), total("rx_packets", 1).alias("rx_packets"), total("tx_packets", 1).alias("tx_packets")
    )


def network_rates(totals: DataFrame) -> DataFrame:
    """The totals with rx, tx and packets a second, whole numbers cut off; a host's first tick is counted from zero over
    the second before it."""
    totals = _by_host(totals)
    for counter, out in (("rx_bits", "rx"), ("tx_bits", "tx"), ("rx_packets", "rx_packet_rate"), ("tx_packets", "tx_packet_rate")):
        totals = rates.counter_to_rate(totals, ["host"], "ts", counter, first=First.TOTAL, rounding=Rounding.TRUNCATE, out=out)
        totals = totals.withColumn(out, F.col(out).cast("long"))
    return totals


def unmounted(partitions: DataFrame, mounted: DataFrame) -> DataFrame:
    """Block devices of partitions (name, bytes) that no row of mounted (name) has, virtual ones left out: named as in
    /dev, without mount point, used or free space."""
    rest = joins.without(partitions.filter(F.col("name").isNotNull() & F.col("bytes").isNotNull()), mounted.select("name").distinct(), ["name"])
    none = F.lit(None).cast("long")
    return rest.filter(~parsers.is_virtual_device(F.col("name"))).select(
        F.concat(F.lit("/dev/"), "name").alias("name"), F.lit("").alias("mount_point"), none.alias("used"), none.alias("free"), F.col("bytes").alias("total")
    )


def device_counters(disks: DataFrame, data_sets: DataFrame) -> DataFrame:
    """Counters (name, read_bytes, write_bytes) of disks and of ZFS data sets, whose kstat files (pool, text) are parsed."""
    z = data_sets.select(parsers.objset_counters(F.col("text")).alias("z")).select("z.*").filter(F.col("name").isNotNull())
    return disks.select("name", "read_bytes", "write_bytes").unionByName(z)


def temperatures(hwmon: DataFrame, coretemp: DataFrame, zones: DataFrame, either: tuple[dict | None, dict | None] = (None, None), unit: str = "celsius") -> DataFrame:
    """(name, value) of sensors: hwmon and coretemp directories (dir, ord, chip, label, fallback, celsius), and thermal
    zones (ord, type, celsius) only if there is no hwmon directory at all.

    Coretemp directories that hwmon has too count once. A sensor stays if one of two lists keeps its name, which are
    counted when they repeat."""
    cores = joins.without(coretemp, hwmon.select("dir").distinct(), ["dir"])
    chips = hwmon.withColumn("_first", F.lit(0)).unionByName(cores.withColumn("_first", F.lit(1)))
    named = chips.select("_first", "ord", texts.sensor_name(F.col("chip"), F.col("label"), F.col("fallback")).alias("name"), "celsius")
    count = hwmon.agg(F.count("*").alias("_n"))  # of one row
    zone = zones.crossJoin(F.broadcast(count)).filter("_n = 0").select(F.lit(2).alias("_first"), "ord", F.coalesce(F.nullif("type", F.lit("")), F.lit("Unknown")).alias("name"), "celsius")
    both = named.unionByName(zone).withColumn("_order", F.struct("_first", "ord"))
    kept = filters.numbered(both, "name", "_order").filter(filters.keep_either(F.col("label"), *either))
    return kept.select(F.col("label").alias("name"), units.temperature(F.col("celsius"), unit).alias("value"))


def gpu_clients(fdinfo: DataFrame) -> DataFrame:
    """(ts, device, pid, busy_ns, vram_bytes) of fdinfo files (ts, device, pid, fd, text): a client that several descriptors
    of a process name counts once, by the lowest; processes that use nothing aren't there."""
    f = fdinfo.withColumn("g", parsers.gpu_client(F.col("text"))).filter("g.client is not null")
    once = f.groupBy("ts", "device", "pid", "g.client").agg(F.min_by("g", "fd").alias("g"))
    by = once.groupBy("ts", "device", "pid").agg(F.sum("g.busy_ns").alias("busy_ns"), F.sum("g.vram_bytes").alias("vram_bytes"), F.sum("g.compute_ns").alias("_c"))
    return by.filter("busy_ns > 0 or vram_bytes > 0 or _c > 0").drop("_c")


def gpu_usage(clients: DataFrame) -> DataFrame:
    """(ts, pid, gpu_percent, gpu_bytes): busy time since the tick before as percent of it, summed over devices; a
    process's first tick on a device gives nothing."""
    w = Window.partitionBy("device", "pid").orderBy("ts")
    nanos = (milliseconds(F.col("ts")) - milliseconds(F.lag("ts").over(w))) * 1_000_000
    share = F.try_divide(F.greatest(F.col("busy_ns") - F.lag("busy_ns").over(w), F.lit(0)) * 100.0, nanos)
    seen = clients.withColumn("_share", F.floor(share)).filter(F.col("_share").isNotNull() & ((F.col("_share") > 0) | (F.col("vram_bytes") > 0)))
    return seen.groupBy("ts", "pid").agg(F.sum("_share").cast("long").alias("gpu_percent"), F.sum("vram_bytes").alias("gpu_bytes"))


def with_gpus(processes: DataFrame, parts: list[DataFrame], total_bytes: Column) -> DataFrame:
    """Processes with gpu_percent, gpu_bytes (sums over vendors, 0 where none has a row) and gpu_mem_percent."""
    for value in ("gpu_percent", "gpu_bytes"):
        processes = joins.summed_dimension(processes, parts, "pid", value)
    return processes.withColumn("gpu_mem_percent", F.coalesce(units.percent(F.col("gpu_bytes"), total_bytes), F.lit(0.0)))


def device_names(devices: DataFrame, names: DataFrame, default: str) -> DataFrame:
    """devices (device, revision) with their marketing names; a table that the user brings (device, revision, name)."""
    met = joins.with_dimension(devices, names.groupBy("device", "revision").agg(F.min("name").alias("name")), ["device", "revision"])
    return met.withColumn("name", F.coalesce("name", F.lit(default)))


def slow_changing(samples: DataFrame, scans: DataFrame, key: str, ts: str, every_ms: int = 60_000) -> DataFrame:
    """Samples of keys that the latest scan before them had listed: lists (ts, key) that are made anew every so often, such as
    of batteries."""
    turn = lambda c: F.floor(milliseconds(c) / every_ms)
    listed = scans.select(turn(F.col(ts)).alias("_turn"), key).distinct()
    return samples.withColumn("_turn", turn(F.col(ts))).join(listed, ["_turn", key], "left_semi").drop("_turn")


def processes(stats: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """Rows of processes from (ts, stat, cmdline, uid): what fails to parse is left out. Threads, if asked for, come as rows of
    the same kind, and all are in the order of their pid."""
    def read(df: DataFrame, is_thread: bool) -> DataFrame:
        s = df.withColumn("s", parsers.stat_fields(F.col("stat"))).filter("s.pid is not null and s.ppid is not null")
        kind = F.when(F.lit(is_thread), "Thread").when(F.col("s.is_kernel"), "Kernel").otherwise("Regular")
        name, command = (f(F.col("s.comm"), F.col("cmdline")) for f in (texts.process_name, texts.process_command))
        return s.select("ts", "s.*", "uid", name.alias("name"), command.alias("command"), kind.alias("process_type"))

    rows = read(stats, False)
    return (rows.unionByName(read(threads, True)) if threads is not None else rows).orderBy("ts", "pid")


def all_disks(mounted: DataFrame, partitions: DataFrame) -> DataFrame:
    """(name, mount_point, used, free, total): mounted disks with their usage, and behind them the block devices of partitions (name,
    bytes) that none of them is; a mounted disk's device is the last part of its name."""
    rows = mounted.select("name", "mount_point", "used", "free", "total")
    known = mounted.select(texts.last_part(F.col("name")).alias("name"))
    return rows.unionByName(unmounted(partitions, known))


# States of batteries as the kernel names them, and as they are shown; others are unknown.
BATTERY_STATES = {"Charging": "Charging", "Discharging": "Discharging", "Full": "Full", "Not charging": "Full", "Empty": "Empty"}


def battery_rows(uevents: DataFrame) -> DataFrame:
    """The other columns of uevents (text) of power supplies, and (charge_percent, watts, health_percent, state, seconds) of each that is
    a battery: how full it is, what it takes or gives, what is left of the capacity it was made for, and the time until it is
    full or empty, null where no rate tells it. Energy is in µWh and µW; where only charge is known, voltage makes energy of it."""
    entries = F.transform(F.split("text", "\n"), lambda line: F.split(line, "=", 2))
    kept = [c for c in uevents.columns if c != "text"]
    # a key that comes twice would be an error in a map: the first one counts
    once = F.array_distinct(F.transform(entries, lambda e: F.get(e, F.lit(0))))
    first = F.map_from_arrays(once, F.transform(once, lambda k: F.get(F.get(F.filter(entries, lambda e: F.get(e, F.lit(0)) == k), F.lit(0)), F.lit(1))))
    rows = uevents.select(*kept, first.alias("_m"))
    field = lambda name: F.try_element_at("_m", F.lit(f"POWER_SUPPLY_{name}"))
    number = lambda name: field(name).try_cast("double")
    volts = number("VOLTAGE_NOW") / 1e6
    amount = lambda part: F.coalesce(number(f"ENERGY_{part}"), number(f"CHARGE_{part}") * volts)
    rate = F.abs(F.coalesce(number("POWER_NOW"), number("CURRENT_NOW") * volts))
    state = F.coalesce(F.create_map(*[F.lit(x) for kv in BATTERY_STATES.items() for x in kv])[field("STATUS")], F.lit("Unknown"))
    made = rows.filter(field("TYPE").isNull() | (field("TYPE") == "Battery")).select(
        *kept, amount("NOW").alias("_now"), amount("FULL").alias("_full"), amount("FULL_DESIGN").alias("_design"), rate.alias("_rate"), number("CAPACITY").alias("_capacity"), state.alias("state")
    )
    left = F.when(F.col("state") == "Charging", F.greatest(F.col("_full") - F.col("_now"), F.lit(0.0))).when(F.col("state") == "Discharging", F.col("_now"))
    seconds = F.when(F.col("_rate") > 0, F.floor(left / F.col("_rate") * 3600)).cast("int")
    charge = F.coalesce(units.percent(F.col("_now"), F.col("_full")), F.col("_capacity"))
    return made.select(*kept, charge.alias("charge_percent"), (F.col("_rate") / 1e6).alias("watts"), units.percent(F.col("_full"), F.col("_design")).alias("health_percent"), "state", seconds.alias("seconds"))

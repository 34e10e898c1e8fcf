"""The process and disk tables as a user sees them: one projection each, and the texts of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import durations, texts, units
from ..options import Options
from . import filters, joins, rates, views
from .rates import First, Rounding


def process_rows(samples: DataFrame, options: Options, users: DataFrame | None = None) -> DataFrame:
    """A row for each process of a tick, as the options ask for.

    samples: (ts, pid, ppid, name, command, uid, state, process_type, cpu_percent, mem_bytes, mem_total, read_bytes,
    write_bytes, start_ticks, uptime), and what more there is. Rates are by whole seconds, 0 at a process's first tick. A
    uid that `users` lacks has no user; a process that isn't sampled any more is no row and costs no state. Kernel threads
    go if asked for; `shown` is name or command, `mem` bytes or percent; grouped rows are summed by what is shown."""
    made = samples
    for counter, out in (("read_bytes", "read_rate"), ("write_bytes", "write_rate")):
        made = rates.counter_to_rate(made, ["pid"], "ts", counter, first=First.ZERO, rounding=Rounding.TRUNCATE, whole_seconds=True, out=out)
        made = made.withColumn(out, F.col(out).cast("long"))
    if users is not None:
        made = joins.with_dimension(made, users.select("uid", F.col("name").alias("user")), ["uid"])
    if options.hide_kernel_threads:
        made = made.filter(~F.col("process_type").eqNullSafe(F.lit("Kernel")))
    made = (
        made.withColumn("shown", F.col("command" if options.process_command else "name"))
        .withColumn("mem_percent", F.coalesce(units.percent(F.col("mem_bytes"), F.col("mem_total")), F.lit(0.0)))
        .withColumn("mem", F.col("mem_bytes").cast("double") if options.mem_as_value else F.col("mem_percent"))
        .withColumn("state_name", texts.state_name(F.col("state")))
        .withColumn("seconds", durations.running_seconds(F.col("uptime"), F.col("start_ticks")))
    )
    if options.grouped:
        sums = ["cpu_percent", "mem", "read_rate", "write_rate", "read_bytes", "write_bytes"]
        keyed = made.withColumn("_key", F.struct("ts", "shown"))
        return views.group_rows(keyed, "_key", "pid", sums, ["seconds"], ["state_name"]).select("_key.*", "*").drop("_key")
    return made.withColumn("num_similar", F.lit(1))


def process_cells(rows: DataFrame, options: Options, width: int = 8) -> DataFrame:
    """The texts of the rows of process_rows, a column each."""
    state = F.col("state_name") if width >= 8 else F.col("state")
    mem = units.format_bytes(F.col("mem"), True) if options.mem_as_value else F.format_string("%.1f%%", "mem")
    user = F.coalesce("user", F.lit("N/A")) if "user" in rows.columns else F.lit("N/A")
    rate = lambda c: units.format_bytes(F.col(c), suffix="/s")
    return rows.select(
        F.col("pid").cast("string").alias("pid"), F.col("num_similar").cast("string").alias("count"), F.col("shown").alias("name"),
        F.format_string("%.1f%%", F.col("cpu_percent").cast("double")).alias("cpu"), mem.alias("mem"), rate("read_rate").alias("read"), rate("write_rate").alias("write"),
        units.format_bytes(F.col("read_bytes")).alias("total_read"), units.format_bytes(F.col("write_bytes")).alias("total_write"),
        state.alias("state"), user.alias("user"), durations.format_duration(F.col("seconds") * 1000).alias("time"),
    )


def process_order(options: Options, explicit: str | None = None) -> str:
    """The column that a process table is sorted by at first: one that is asked for, else by the kind of table."""
    return explicit or ("pid" if options.tree else "cpu_percent")


def disk_rows(disks: DataFrame, counters: DataFrame, options: Options) -> DataFrame:
    """A row a tick and disk: disks (ts, name, mount_point, used, free, total) with the rates of counters (ts, device,
    read_bytes, write_bytes) of the device that the last part of its name tells. Shares are of used + free, null unless
    both are known and not 0; rates are rounded, 0 at first sight of a mount and device, null for a device without
    counters. Disks without a mount point go unless they are asked for."""
    listed = disks if options.include_unmounted else disks.filter(F.col("mount_point") != "")
    named = listed.withColumn("device", texts.last_part(F.col("name")))
    met = joins.with_dimension(named, counters, ["ts", "device"])
    for counter, out in (("read_bytes", "read_rate"), ("write_bytes", "write_rate")):
        met = rates.counter_to_rate(met, ["mount_point", "device"], "ts", counter, first=First.ZERO, rounding=Rounding.HALF_UP, out=out)
        met = met.withColumn(out, F.when(F.col(counter).isNotNull(), F.col(out)).cast("long"))
    both = F.col("used") + F.col("free")
    return met.withColumn("summed_total", both).withColumn("used_percent", units.percent(F.col("used"), both)).withColumn("free_percent", units.percent(F.col("free"), both))


def disk_cells(rows: DataFrame) -> DataFrame:
    """The texts of the rows of disk_rows; 'N/A' for what isn't known."""
    known = lambda c: F.coalesce(c, F.lit("N/A"))
    size = lambda c: known(units.format_bytes(F.col(c)))
    share = lambda c: known(F.when(F.col(c).isNotNull(), F.format_string("%.1f%%", c)))
    rate = lambda c: known(units.format_bytes(F.col(c), suffix="/s"))
    return rows.select(
        F.col("name").alias("disk"), F.col("mount_point").alias("mount"), size("used").alias("used"), size("free").alias("free"), size("summed_total").alias("total"),
        share("used_percent").alias("used_share"), share("free_percent").alias("free_share"), rate("read_rate").alias("read"), rate("write_rate").alias("write"),
    )


def kept_by(rows: DataFrame, options: Options, which: str, column: str) -> DataFrame:
    """Rows that a list of the options keeps by a column, if there is such a list."""
    chosen = options.filters.get(which)
    if chosen is None:
        return rows
    how = {"regex": chosen.regex, "case_sensitive": chosen.case_sensitive, "whole_word": chosen.whole_word}
    return rows.filter(filters.keep(F.col(column), list(chosen.items), chosen.is_list_ignored, **how))


def visible(rows: DataFrame, ts: str, options: Options, now: Column, window_ms: int | None = None) -> DataFrame:
    """What is kept of a history, and of that the window shown before its newest row."""
    return filters.recent(filters.retained(rows, ts, now, options.retention // 1000), ts, window_ms or options.default_time_value)


def shown_temperatures(sensors: DataFrame, celsius: str, options: Options) -> DataFrame:
    return sensors.withColumn("value", units.temperature(F.col(celsius), options.temperature_type))


def shown_network(rate_rows: DataFrame, bits: str, options: Options) -> DataFrame:
    """A rate of bits in the unit that is asked for, and where it stands on the axis."""
    value = units.bits_to_bytes(F.col(bits)) if options.network_use_bytes else F.col(bits)
    unit = "B" if options.network_use_bytes else "b"
    log = units.saturating_log2 if options.network_use_binary_prefix else units.saturating_log10
    at = log(value.cast("double")) if options.network_use_log else value.cast("double")
    scaled = units.scale(value, options.network_use_binary_prefix, unit)
    return rate_rows.withColumn("height", at).withColumn("scaled", scaled["value"]).withColumn("unit", scaled["unit"])

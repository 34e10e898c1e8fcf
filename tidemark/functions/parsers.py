"""Parsers of the kernel's text files as column expressions: one row holds one line or one file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, i: int, kind: str = "long") -> Column:
    return F.get(c, F.lit(i)).try_cast(kind)


def stat_fields(text: Column) -> Column:
    """/proc/<pid>/stat: the name may hold blanks and parentheses, so what follows the last ') ' is split.

    struct(pid, comm, state, ppid, is_kernel, utime, stime, priority, nice, start_time, vsize, rss)."""
    rest = F.split(F.regexp_extract(text, r"(?s)^.*\) (.*)$", 1), r"\s+")
    return F.struct(
        F.regexp_extract(text, r"^(\d+)", 1).try_cast("int").alias("pid"),
        F.regexp_extract(text, r"(?s)\((.*)\) ", 1).alias("comm"),
        F.get(rest, F.lit(0)).alias("state"),
        _part(rest, 1, "int").alias("ppid"),
        (_part(rest, 6).bitwiseAND(0x200000) != 0).alias("is_kernel"),
        _part(rest, 11).alias("utime"),
        _part(rest, 12).alias("stime"),
        _part(rest, 15, "int").alias("priority"),
        _part(rest, 16, "int").alias("nice"),
        _part(rest, 19).alias("start_time"),
        _part(rest, 20).alias("vsize"),
        _part(rest, 21).alias("rss"),
    )


def keyed_value(text: Column, key: str, separator: str = r":?\s+") -> Column:
    """The number after key at the start of a line of text."""
    return F.regexp_extract(text, rf"(?m)^{key}{separator}(\d+)", 1).try_cast("long")


def io_fields(text: Column) -> Column:
    return F.struct(keyed_value(text, "read_bytes").alias("read_bytes"), keyed_value(text, "write_bytes").alias("write_bytes"))


def cpu_times(text: Column) -> Column:
    """The fields of /proc/stat's cpu line, without its label, to struct(idle, non_idle); guest times are in user times already."""
    v = F.split(F.regexp_replace(F.trim(text), r"^cpu\d*\s+", ""), r"\s+")
    n = lambda i: F.coalesce(_part(v, i, "double"), F.lit(0.0))
    return F.struct((n(3) + n(4)).alias("idle"), (n(0) + n(1) + n(2) + n(5) + n(6) + n(7)).alias("non_idle"))


def disk_counters(line: Column) -> Column:
    """A line of /proc/diskstats to struct(name, read_bytes, write_bytes); sectors have 512 bytes."""
    v = F.split(F.trim(line), r"\s+")
    return F.struct(F.get(v, F.lit(2)).alias("name"), (_part(v, 5) * 512).alias("read_bytes"), (_part(v, 9) * 512).alias("write_bytes"))


def mount_fields(line: Column) -> Column:
    from .texts import unescape_mount

    v = F.split(F.trim(line), r"\s+")
    return F.struct(unescape_mount(F.get(v, F.lit(0))).alias("device"), unescape_mount(F.get(v, F.lit(1))).alias("mount_point"), F.get(v, F.lit(2)).alias("fs_type"))


def partition_fields(line: Column) -> Column:
    """A line of /proc/partitions to struct(name, bytes), blocks having 1024 bytes; nulls for its heading."""
    v = F.split(F.trim(line), r"\s+")
    return F.struct(F.when(_part(v, 2).isNotNull(), F.get(v, F.lit(3))).alias("name"), (_part(v, 2) * 1024).alias("bytes"))


#: Filesystems that live on a device.
PHYSICAL = ("ext2", "ext3", "ext4", "msdos", "vfat", "exfat", "ntfs", "ntfs3", "fuseblk", "hfs", "hfsplus", "jfs", "reiserfs", "reiser4", "xfs", "btrfs", "bcachefs", "f2fs", "minix", "nilfs", "nilfs2", "zfs", "apfs")
VIRTUAL_PREFIXES = ("loop", "ram", "zram")


def is_physical(fs_type: Column) -> Column:
    return F.lower(fs_type).isin(*PHYSICAL)


def is_virtual_device(name: Column) -> Column:
    out = F.lit(False)
    for p in VIRTUAL_PREFIXES:
        out = out | name.startswith(p)
    return out


def load_average(text: Column) -> Column:
    return F.transform(F.slice(F.split(F.trim(text), r"\s+"), 1, 3), lambda x: x.try_cast("float"))


def memory_fields(text: Column) -> Column:
    """/proc/meminfo to struct(total, used, swap_total, swap_used, cache) in bytes: what isn't available is used, and what
    is available without being free is cache. Without an estimate of what is available, free and page caches count as that."""
    kib = lambda k: keyed_value(text, k) * 1024
    total, free = kib("MemTotal"), kib("MemFree")
    known = lambda k: F.coalesce(kib(k), F.lit(0))
    guess = free + known("Buffers") + known("Cached") + known("SReclaimable") - known("Shmem")
    available = F.least(F.coalesce(kib("MemAvailable"), guess), total)
    less = lambda a, b: F.greatest(a - b, F.lit(0))
    return F.struct(
        total.alias("total"), less(total, available).alias("used"), kib("SwapTotal").alias("swap_total"),
        less(kib("SwapTotal"), kib("SwapFree")).alias("swap_used"), less(available, free).alias("cache"),
    )


def interface_counters(line: Column) -> Column:
    """A line of /proc/net/dev to struct(name, rx_bytes, rx_packets, tx_bytes, tx_packets); nulls for its headings."""
    v = F.split(F.trim(F.regexp_extract(line, r":(.*)$", 1)), r"\s+")
    name = F.nullif(F.regexp_extract(line, r"^\s*([^:|\s]+):", 1), F.lit(""))
    n = lambda i: F.when(name.isNotNull(), _part(v, i))
    return F.struct(name.alias("name"), n(0).alias("rx_bytes"), n(1).alias("rx_packets"), n(8).alias("tx_bytes"), n(9).alias("tx_packets"))


def objset_counters(text: Column) -> Column:
    """A ZFS data set's kstat file to struct(name, read_bytes, write_bytes)."""
    value = lambda k: F.regexp_extract(text, rf"(?m)^{k}\s+\d+\s+(\S.*?)\s*$", 1)
    return F.struct(F.nullif(value("dataset_name"), F.lit("")).alias("name"), value("nread").try_cast("long").alias("read_bytes"), value("nwritten").try_cast("long").alias("write_bytes"))


#: Engines of a GPU client whose busy times count as use; compute is counted apart.
ENGINES = ("gfx", "dma", "dec", "enc", "enc_1", "jpeg", "vpe")


def gpu_client(text: Column) -> Column:
    """An fdinfo file to struct(client, busy_ns, compute_ns, vram_bytes); a null client if it is no GPU's. Only what
    stands below the client's id counts."""
    client = F.regexp_extract(text, r"(?m)^drm-client-id:\t(\d+)$", 1).try_cast("long")
    below = F.regexp_extract(text, r"(?ms)^drm-client-id[^\n]*\n(.*)\z", 1)
    value = lambda k: F.coalesce(F.regexp_extract(below, rf"(?m)^{k}:\s*(\d+)", 1).try_cast("long"), F.lit(0))
    busy = sum((value(f"drm-engine-{e}") for e in ENGINES), F.lit(0).cast("long"))
    return F.struct(client.alias("client"), busy.alias("busy_ns"), value("drm-engine-compute").alias("compute_ns"), (value("drm-memory-vram") * 1024).alias("vram_bytes"))


def arc_size(text: Column) -> Column:
    """ZFS arcstats to struct(size, c_max, c_min)."""
    value = lambda k: F.regexp_extract(text, rf"(?m)^{k}\s+\d+\s+(\d+)", 1).try_cast("long")
    return F.struct(value("size").alias("size"), value("c_max").alias("c_max"), value("c_min").alias("c_min"))

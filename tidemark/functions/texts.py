"""Names, paths, labels and fixed maps of text."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import widths


def equal_ignoring_case(a: Column, b: Column) -> Column:
    """Only A to Z have two cases here."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(a) == low(b)


def ellipsis(text: Column, width: int) -> Column:
    """The text cut to so many columns of a terminal, with an ellipsis at its end if something went."""
    return widths.cut(text, width)


def slug(path: Column) -> Column:
    return F.translate(path, "/._", "---")


def last_part(path: Column) -> Column:
    """Last part of a path, slashes at the end cut; '/' stays."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", F.when(path == "", F.lit("")).otherwise(F.lit("/"))).otherwise(F.element_at(F.split(bare, "/"), -1))


def pane(target: Column) -> Column:
    return F.substring_index(target, ".", -1)


#: Families in their order, by what a lower-case model id contains; others are 'Other'.
FAMILIES = ("opus", "sonnet", "haiku", "fable")
OTHER = "Other"


def fold(text: Column, families=FAMILIES, other: str = OTHER) -> Column:
    """The first of families that text contains, ignoring case, with a capital."""
    low = F.lower(text)
    return functools.reduce(lambda w, f: F.when(low.contains(f), f.capitalize()).otherwise(w), reversed(families), F.lit(other))


def ordinal(family: Column, families=FAMILIES) -> Column:
    names = [f.capitalize() for f in families]
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), family), F.lit(0)), F.lit(len(names) + 1)).cast("int")


def binary_name(cmdline: Column) -> Column:
    """The program's name of a command line: of what stands before the first NUL or ':' the part after the last '/',
    and of that what stands before ' -'."""
    head = F.split(cmdline, "[\x00:]", 2).getItem(0)
    return F.split(F.element_at(F.split(head, "/"), -1), " -", 2).getItem(0)


def process_name(comm: Column, cmdline: Column) -> Column:
    """comm, but for one of 15 bytes or more (the kernel cuts those) the name on the command line."""
    long = (F.octet_length(comm) >= 15) & cmdline.isNotNull() & (cmdline != "")
    return F.when(long, binary_name(cmdline)).otherwise(comm)


def process_command(comm: Column, cmdline: Column) -> Column:
    spaced = F.rtrim(F.translate(cmdline, "\x00", " "))
    return F.when(cmdline.isNull(), comm).when(cmdline == "", F.concat(F.lit("["), comm, F.lit("]"))).otherwise(spaced)


def unescape_mount(text: Column) -> Column:
    """Octal escapes of mount tables, the backslash's own first."""
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("\\134", "\\"), ("\\040", " "), ("\\011", "\t"), ("\\012", "\n")), text)


#: Letters of process states.
STATES = {"R": "Runnable", "S": "Sleeping", "D": "UninterruptibleDiskSleep", "Z": "Zombie", "T": "Stopped", "t": "Tracing", "X": "Dead", "I": "Idle", "W": "Waking", "K": "Wakekill", "P": "Parked"}


def state_name(letter: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), letter), F.lit("Unknown"))


def sensor_name(chip: Column, label: Column, fallback: Column | None = None) -> Column:
    """'chip: Label', the label with a capital. An absent chip gives way to `fallback`; an empty one does so only beside
    a label. 'Unknown' if nothing is left. Repeated names are counted by filters.numbered."""
    chip_name = F.nullif(chip, F.lit(""))
    other = F.nullif(fallback if fallback is not None else F.lit(None).cast("string"), F.lit(""))
    first = F.substring(label, 1, 1)
    big = F.concat(F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first), F.substring(label, 2, 2**30))
    prefix = F.coalesce(chip_name, other)
    labelled = F.coalesce(F.concat(prefix, F.lit(": "), big), big)
    bare = F.when(chip.isNotNull(), F.coalesce(chip_name, F.lit("Unknown"))).otherwise(F.coalesce(other, F.lit("Unknown")))
    return F.when(label.isNotNull() & (label != ""), labelled).otherwise(bare)


def disk_number(name: Column) -> Column:
    """The 'disk<number>' in a device's name, or null."""
    return F.nullif(F.regexp_extract(name, r"disk\d+", 0), F.lit(""))


def padded_share(label: str, percent: Column, used: Column, total: Column) -> Column:
    """'RAM:  51%   1.0GiB/2.0GiB': a legend's label with its share and its amounts."""
    from .units import format_bytes

    share = F.lpad(F.concat(F.bround(percent, 0).cast("long").cast("string"), F.lit("%")), 4, " ")
    return F.concat(F.lit(label + ":"), share, F.lit("   "), format_bytes(used, True), F.lit("/"), format_bytes(total, True))


def padded(text: Column, width: int, right: bool = False) -> Column:
    """text with blanks up to a width; a longer text stays whole."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(blanks, text) if right else F.concat(text, blanks)

"""Fill-in-the-middle: a text in three parts, its middle told after what surrounds it.

Units (words, lines, characters) are what lies between boundaries. A grammar of units is a regex of the places
between two characters: zero-width, a look behind at the class of the one and a look ahead at the class of the
other. Spark's split at those places keeps every piece, so the pieces joined again are the text; the empty text, of
which split makes one empty piece, is handled by itself.

Split makes an object of each piece. Texts are therefore split in segments of SEGMENT characters: their pieces are
counted segment by segment, and only the segments in which a cut lies are split into pieces that are held. Long or
short, a text goes the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def runs_of(*classes: str) -> str:
    """Boundaries of units that are longest runs within one of the classes, and single characters outside of them all.
    A class is the inside of a bracket expression; classes have no character in common."""
    ends = [f"(?<=[{c}])(?=[^{c}])" for c in classes]
    return "|".join([*ends, rf"(?<=[^{''.join(classes)}])(?=[\s\S])" if classes else r"(?<=[\s\S])(?=[\s\S])"])


def ended_by(mark: str) -> str:
    """Boundaries of units that end with a character of the class `mark`, or with the text."""
    return rf"(?<=[{mark}])(?=[\s\S])"


LETTERS = runs_of("A-Za-z")
CHARACTERS = runs_of()
LINES = ended_by(r"\n")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_middle(docs: DataFrame, boundary: str = LETTERS, seed: int = 1, plain_pct: int = 10, spm_pct: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for every row of docs (doc_id, text).

    n: units of the text. Two places between units, drawn by a hash of seed and doc_id, part it in three. output is the
    text (form plain), prefix mark, prefix, suffix mark, suffix, middle mark, middle (psm), or suffix mark, suffix,
    prefix mark, prefix, middle mark, middle (spm). Empty texts and those that hold a mark are plain; so are plain_pct of a
    hundred; of the others spm_pct of a hundred are spm. The parts of plain ones are null. A null text is empty, a null id
    is drawn for as an empty one; repeated rows come out alike; further columns aren't looked at; an empty table gives an
    empty one. boundary: a regex of zero width that looks at one character on either side.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    units = lambda s: F.split(s, boundary, -1)
    last = F.floor((F.length("t") - 1) / SEGMENT).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("t"), i * SEGMENT + 1, F.lit(SEGMENT)))
    rows = docs.select("doc_id", text.alias("t"), *draws).withColumn("segments", F.when(F.col("t") != "", cut).otherwise(F.array().cast("array<string>")))

    # whether the first unit of a segment goes on from the segment before it
    segments = F.col("segments")
    goes_on = F.transform(segments, lambda s, i: F.when(i == 0, 0).otherwise(2 - F.size(units(F.concat(F.right(F.get(segments, i - 1), F.lit(1)), F.left(s, F.lit(1)))))))
    rows = rows.withColumn("goes_on", goes_on)
    own = F.transform(segments, lambda s, i: F.size(units(s)).cast("long") - F.get(F.col("goes_on"), i))
    # units that begin before each segment, and at last all of them
    before = F.aggregate(own, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("before", before).withColumn("n", F.element_at("before", -1))
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.greatest(*[F.col("t").contains(m) for m in (PREFIX, SUFFIX, MIDDLE)])
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= 100 - plain_pct), "plain").when(F.col("h4") % 100 < spm_pct, "spm").otherwise("psm")
    rows = rows.withColumns({"a": F.least(a, b), "b": F.greatest(a, b), "form": form})

    # the segment in which a unit begins; the end of the text counts as in none
    segment_of = lambda m: F.when(F.col(m) < F.col("n"), F.size(F.filter(F.slice("before", 1, F.size(segments)), lambda x: x <= F.col(m))) - 1)
    rows = rows.withColumns({"at_a": segment_of("a"), "at_b": segment_of("b")})
    held = F.transform(F.array_distinct(F.array_compact(F.array("at_a", "at_b"))), lambda i: F.struct(i.alias("i"), units(F.get(segments, i)).alias("pieces")))
    rows = rows.withColumn("held", F.when(F.col("form") != "plain", held))

    def place(m: str, at: str) -> Column:
        """Characters before unit m."""
        inside = lambda x: F.length(F.array_join(F.slice(x["pieces"], F.lit(1), (F.col(m) - F.get("before", at) + F.get("goes_on", at)).cast("int")), ""))
        found = _let(F.element_at(F.filter("held", lambda x: x["i"] == F.col(at)), 1), inside)
        return F.when(F.col(at).isNull(), F.length("t")).otherwise(F.col(at) * SEGMENT + found)

    rows = rows.select("doc_id", "t", "n", "form", F.when(F.col("form") != "plain", place("a", "at_a")).alias("x"), F.when(F.col("form") != "plain", place("b", "at_b")).alias("y"))
    parts = {"prefix": F.substring("t", F.lit(1), F.col("x")), "middle": F.substring("t", F.col("x") + 1, F.col("y") - F.col("x")), "suffix": F.substring("t", F.col("y") + 1, F.length("t"))}
    rows = rows.withColumns(parts)
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No part holds a mark, so marks tell the parts."""
    rest = lambda first: F.substring(output, F.lit(len(first) + 1), F.length(output))
    psm = F.split(rest(PREFIX), f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(rest(SUFFIX), f"{PREFIX}|{MIDDLE}", -1)
    back = lambda parts, *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])
    return F.when(form == "plain", output).when(form == "psm", _let(psm, lambda p: back(p, 0, 2, 1))).otherwise(_let(spm, lambda p: back(p, 1, 2, 0)))

"""Fill-in-the-middle transformation over lines, cut by an indexable skip list. Spark expressions only; no shuffle.

The lines of a text are the links of lane 0, each one unit wide and as many code points wide as the line has. A link
of an express lane spans ``FAN`` links of the lane below and carries their sums: its unit width and its code-point
width. A cut rank is found from the top lane: links are taken while their accumulated units do not exceed the rank,
then the search goes one lane down; the accumulated code points are the place of the cut. Lanes below the top take at
most ``FAN`` links a search; the top lane is walked whole, so a text may have any number of lines.

Defined cases: null text -> empty -> plain; texts with a control string -> plain; ranks may be equal, so parts may be
empty; a null doc_id counts as the empty string in the digest; repeated rows are transformed each; an empty table gives
no rows; other columns stay in ``fill_in_middle`` (its own output columns replace those of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FAN = 16
LANES = 5
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers for each key: the first digit groups of a SHA-256 digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def line_links(parts: str) -> Column:
    """Lane 0: one link (units, chars) for each line, its line end included; column ``parts`` holds the text split at line ends."""
    links = F.transform(parts, lambda x, i: F.struct(F.lit(1).cast("long").alias("units"), (F.length(x) + F.when(i + 1 < F.size(parts), 1).otherwise(0)).cast("long").alias("chars")))
    return F.filter(links, lambda x: x["chars"] > 0)


def express_lane(below: str) -> Column:
    """The next lane: one link for each ``FAN`` links of the lane in column ``below``, with their summed widths."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(below), F.lit(1)), F.lit(FAN))
    width = lambda s, f: F.aggregate(F.slice(F.col(below), s, FAN), F.lit(0).cast("long"), lambda a, x: a + x[f])
    return F.transform(starts, lambda s: F.struct(width(s, "units").alias("units"), width(s, "chars").alias("chars")))


def descend(lanes: list[str], rank: Column) -> Column:
    """Code points before unit ``rank``; ``lanes`` are columns, the top one first."""
    zero = F.lit(0).cast("long")
    start = F.struct(rank.alias("rank"), zero.alias("units"), zero.alias("chars"), zero.alias("taken"), F.lit(True).alias("on"))

    def take(state, link):
        fits = state["on"] & (state["units"] + link["units"] <= state["rank"])
        step = lambda f: state[f] + F.when(fits, link[f]).otherwise(0)
        return F.struct(state["rank"].alias("rank"), step("units").alias("units"), step("chars").alias("chars"), (state["taken"] + fits.cast("long")).alias("taken"), fits.alias("on"))

    def lower(state):
        return F.struct(state["rank"].alias("rank"), state["units"].alias("units"), state["chars"].alias("chars"), (state["taken"] * FAN).alias("taken"), F.lit(True).alias("on"))

    # an array of one state is transformed lane by lane, so that each lane refers to the state above it once
    at = F.array(F.aggregate(F.col(lanes[0]), start, take))
    for lane in map(F.col, lanes[1:]):
        at = F.transform(at, lambda s: F.aggregate(F.slice(lane, (s["taken"] * FAN + 1).cast("int"), FAN), lower(s), take))  # noqa: B023
    return at[0]["chars"]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars, output.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of those suffix first.
    """
    h = draws(F.col("doc_id"), seed)
    kept = [c for c in docs.columns if c not in OUTPUTS]
    lanes = [f"_lane{i}" for i in range(LANES)]
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_parts", F.split("_text", "\n", -1)).select(*kept, "_text", line_links("_parts").alias(lanes[0]))
    for below, lane in zip(lanes, lanes[1:]):
        rows = rows.withColumn(lane, express_lane(below))
    n = F.size(lanes[0]).cast("long")
    rank = lambda pick: pick(h[0] % (n + 1), h[1] % (n + 1))
    cut = lambda pick: descend(lanes[::-1], rank(pick))
    text = F.col("_text")
    plain = (text == "") | (h[2] % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(mark)
    rows = rows.select(*kept, "_text", n.alias("n"), F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form"), cut(F.least).alias("_a"), cut(F.greatest).alias("_b"))
    a, b = F.col("_a").cast("int"), F.col("_b").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    is_plain = F.col("form") == "plain"
    output = F.when(is_plain, text).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return rows.select(*kept, "n", "form", F.when(~is_plain, F.col("_a")).alias("prefix_chars"), F.when(~is_plain, F.col("_b") - F.col("_a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``fill_in_middle`` made ``output``."""

    def between(first, second):
        at = F.instr(output, second)
        return F.substring(output, F.lit(len(first) + 1), at - len(first) - 1), F.substring(output, at + len(second), F.instr(output, MIDDLE) - at - len(second))

    middle = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    suffix_first, prefix_second = between(SUFFIX, PREFIX)
    prefix_first, suffix_second = between(PREFIX, SUFFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(F.concat(prefix_first, middle, suffix_second))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

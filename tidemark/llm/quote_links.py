"""Chat formatting by quotation linking.

A line's quote level is the number of `>` in its leading run of `>` and blanks; consecutive
lines of one level are a passage. Passages are normalised (markers off, lower case, white space
runs to one blank), hashed (SHA-256) and joined to the units of original messages: whole
bodies, paragraphs and lines, each without their own quotes. A passage that isn't found whole
is looked up by paragraphs, then by lines; parts of under LEAST_UNIT characters come last, and are
looked up in their own conversation only, as in others they would link by chance. Within a conversation the latest earlier message that has the unit
is meant; else the first message of all that has it. So a hash has one row on the original
side, and a unit that very many messages share emits no pairs.

A message replies to what its lowest and first found passage quotes, else to the message
before it. One that replies to an older message of its conversation opens a branch there.
Reply order is depth first, the older reply first: `order_key` sorts a conversation so that
each message comes after what it replies to, together with the branch it belongs to. Quotes
and attribution lines above them are taken out of the bodies.

Long conversations are cut into ranges of `RANGE` turns: no window holds more than that, and
only one row a range goes on to the window across ranges. Branch paths are found by pointer
doubling, in log2 of the nesting rounds.

Defined cases: null text has an empty body and no quotes; a row without conv_id or turn is kept
with what can be said of it, in no order; repeated (conv_id, turn) rows are kept each and share
their place; a quote of nothing known is removed and counted; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

RANGE = 4096
#: Shorter paragraphs and lines link within their conversation only: elsewhere they would by chance.
LEAST_UNIT = 12
# Attribution lines in mail and forum quoting.
ATTRIBUTION = r"(?i)^\s*(on .{1,200} wrote|le .{1,200} a écrit|am .{1,200} schrieb.{0,100}|el .{1,200} escribió)\s*:\s*$"
_MARKS = r"^[ \t]*>[> \t]*"
MOST_DOUBLINGS = 40


def level(line: Column) -> Column:
    """Quote level of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, f"({_MARKS})", 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def key(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def passages(text: Column) -> Column:
    """array<struct<level, text>> of the quoted passages, in order."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.struct(
        level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))
    start = F.expr("CAST(array() AS array<struct<level:int,text:string>>)")

    def add(found, line):
        last = F.element_at(found, -1)
        longer = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(
            last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), line["text"]).alias("text"))))
        joins = (F.size(found) > 0) & (F.get(found, F.size(found) - 1)["level"] == line["level"])
        return F.when(joins, longer).otherwise(F.concat(found, F.array(line)))

    return F.filter(F.aggregate(lines, start, add), lambda p: p["level"] > 0)


def body(text: Column) -> Column:
    """The text without quoted lines and the attribution lines before them."""
    own = F.filter(F.split(text, "\r?\n"), lambda x: (level(x) == 0) & ~x.rlike(ATTRIBUTION))
    return F.trim(F.array_join(own, "\n"))


def _keyed(parts: Column, whole: Column) -> Column:
    """array<struct<k, wide>> of the parts that aren't blank; wide ones may link to other conversations."""
    said = F.filter(parts, lambda x: F.length(normalised(x)) > 0)
    return F.transform(said, lambda x: F.struct(key(x).alias("k"), ((F.length(normalised(x)) >= LEAST_UNIT) | (x == whole)).alias("wide")))


def units(text: Column) -> Column:
    """Distinct keys of a body: the whole, its paragraphs, its lines."""
    return F.array_distinct(_keyed(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")), text))


def parts(text: Column) -> Column:
    """Distinct keys of a passage in the order they are looked up: the whole, long paragraphs, long lines, short ones."""
    found = _keyed(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")), text)
    return F.array_distinct(F.concat(F.filter(found, lambda x: x["wide"]), F.filter(found, lambda x: ~x["wide"])))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, tie, body, quotes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    quoted = text.rlike(r"(?m)^[ \t]*>")
    none = F.expr("CAST(array() AS array<struct<level:int,text:string>>)")
    return messages.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("tie"),
                           F.when(quoted, body(text)).otherwise(F.trim(text)).alias("body"),
                           F.when(quoted, passages(text)).otherwise(none).alias("quotes"))


def _links(parsed: DataFrame) -> DataFrame:
    """tie, at (passage number), level, to_conv, to_turn: the message each found passage quotes."""
    asked = parsed.where(F.size("quotes") > 0).select("tie", "conv_id", "turn", F.posexplode("quotes").alias("at", "p"))
    asked = asked.select("tie", "conv_id", "turn", "at", "p.level", F.posexplode(parts(F.col("p.text"))).alias("part", "x"))
    asked = asked.select("tie", "conv_id", "turn", "at", "level", "part", "x.k", "x.wide")
    asked = stored(asked, "quotes-asked")
    have = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(units(F.col("body"))).alias("x")).select("conv_id", "turn", "x.k", "x.wide")
    have = have.join(asked.select("k").distinct(), "k", "left_semi")
    have = stored(have.distinct(), "quotes-have")
    # In the conversation: the latest earlier turn, by one sorted pass over (conv_id, k).
    both = asked.select("conv_id", "k", "turn", "tie", "at", "level", "part", "wide").unionByName(
        have.select("conv_id", "k", "turn"), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "k").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("tie").isNull(), F.col("turn"))).over(before)).where("tie IS NOT NULL")
    first = have.where("wide").groupBy("k").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = near.join(first, "k", "left").select(
        "tie", "at", "level", "part",
        F.when(F.col("near").isNotNull(), F.struct("conv_id", F.col("near").alias("turn"))).when(
            F.col("wide") & ~F.coalesce((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") >= F.col("turn")), F.lit(False)),
            F.col("first")).alias("to"))
    # The whole passage before its parts.
    best = found.where("to IS NOT NULL").groupBy("tie", "at", "level").agg(F.min_by("to", "part").alias("to"))
    return best.select("tie", "at", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"))


def _carried(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` (conv_id, turn) with the greatest `value` of earlier turns of the conversation, as `name`."""
    df = df.withColumn("_value", value).withColumn("_range", F.floor(F.col("turn") / RANGE))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "_range").agg(F.max("_value").alias("_m"))
    ranges = ranges.withColumn("_m", F.max("_m").over(across))
    found = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.max("_value").over(inside))
    return df.withColumn(name, found).join(ranges, ["conv_id", "_range"], "left").withColumn(
        name, F.coalesce(name, "_m")).drop("_value", "_range", "_m")


def link(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, n_linked, reply_conv, reply_turn,
    branch (first turn of its branch), order_key. Sort by conv_id, order_key for reply order."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = stored(parse(messages), "quotes-parsed")
    linked = _links(parsed).groupBy("tie").agg(
        F.count("*").alias("n_linked"), F.min_by(F.struct("to_conv", "to_turn"), F.struct("level", "at")).alias("to"))
    rows = parsed.select("conv_id", "turn", "role", "tie", "body", F.size("quotes").cast("long").alias("n_quotes")).join(linked, "tie", "left")
    rows = _carried(rows, F.col("turn"), "previous")
    own = F.col("to.to_conv").eqNullSafe(F.col("conv_id"))
    rows = rows.withColumn("reply_conv", F.coalesce("to.to_conv", F.when(F.col("previous").isNotNull(), F.col("conv_id"))))
    rows = rows.withColumn("reply_turn", F.coalesce("to.to_turn", "previous"))
    # Rows of one turn share its place: the turn branches where any of them quotes an older message.
    opens = F.when(own & (F.col("to.to_turn") < F.col("previous")), F.col("to.to_turn"))
    rows = stored(rows.withColumn("opens", opens).drop("to"), "quotes-rows")
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("opens").alias("opens"))
    turns = _carried(turns, F.when(F.col("opens").isNotNull(), F.col("turn")), "inside")
    turns = turns.withColumn("branch", F.when(F.col("opens").isNotNull(), F.col("turn")).otherwise(F.col("inside")))
    turns = stored(turns.select("conv_id", "turn", "opens", "branch"), "quotes-turns")
    paths = _paths(turns)
    placed = turns.join(paths, ["conv_id", "branch"], "left").select("conv_id", "turn", "branch", F.concat(
        F.coalesce("path", F.expr("CAST(array() AS array<bigint>)")),
        F.array(F.lit(-(2**63)), F.col("turn"))).alias("order_key"))
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv", "reply_turn", "branch", "order_key")


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, branch, path: (-turn branched from, first turn) of the branches from the trunk down to it."""
    mine = turns.where("opens IS NOT NULL").select("conv_id", F.col("turn").alias("branch"), F.col("opens").alias("from"))
    above = turns.select("conv_id", F.col("turn").alias("from"), F.col("branch").alias("up"))
    paths = stored(mine.join(above, ["conv_id", "from"], "left").select(
        "conv_id", "branch", "up", F.array(-F.col("from"), F.col("branch")).alias("path")), "quotes-paths")
    for _ in range(MOST_DOUBLINGS):
        if not paths.where("up IS NOT NULL").limit(1).count():
            return paths.select("conv_id", "branch", "path")
        higher = paths.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        paths = stored(paths.join(higher, ["conv_id", "up"], "left").select(
            "conv_id", "branch", F.col("up2").alias("up"),
            F.concat(F.coalesce("path2", F.expr("CAST(array() AS array<bigint>)")), "path").alias("path")), "quotes-paths")
    raise RuntimeError(f"branches nest deeper than 2**{MOST_DOUBLINGS}")

"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ">" are quotes, by the number of markers. Stretches of
equal level are normalised and hashed, as a whole and line by line, and joined
with the hashes of the messages' own text, paragraphs and lines. A message
replies to the message that most of its first-level quotes come from: one
before it in the same conversation, else one of another conversation; deeper
levels count where the first finds none. Quotes
and the lines that introduce them are taken out, and a conversation's messages
are put in the order of their threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

MARKERS = r"^(?:[ \t]?>)+"
#: A line that only introduces a quote, such as "On ... wrote:".
INTRODUCES = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: Characters of a normalised passage below which it is too common to tell its origin in another conversation.
LEAST = 8
#: Owners up to which a passage is joined with each of them; beyond that owners with the same common passages are one class.
RARE = 16


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), "[^>]", ""))


def body(line: Column) -> Column:
    return F.regexp_replace(line, MARKERS + r"[ \t]?", "")


def normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def own_text(text: Column) -> Column:
    """A text without quoted lines, the lines that introduce them, and blank lines at its ends. Null gives ""."""
    text = F.coalesce(text, F.lit(""))
    lines = _lines(text)

    def stays(line: Column, i: Column) -> Column:
        follows = F.coalesce(level(F.get(lines, i + 1)) > 0, F.lit(False))
        return (level(line) == 0) & ~(line.rlike(INTRODUCES) & follows)

    cut = F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"^\s*\n|\s+$", "")
    return F.when(text.rlike("(?m)" + MARKERS), cut).otherwise(text)


def _sources(messages: DataFrame) -> DataFrame:
    """(message, conv_id, turn, passage): hashes of each message's own text, its paragraphs and its lines."""
    own = F.col("own")
    parts = F.flatten(F.array(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n")))
    parts = F.filter(F.transform(parts, normal), lambda p: p != "")
    return messages.select("message", "conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, lambda p: F.md5(p)))).alias("passage"))


def passages(messages: DataFrame) -> DataFrame:
    """(message, conv_id, turn, level, passage, weight): hashes of quoted stretches and of their lines, with their lengths."""
    quoting = messages.where(F.col("text").rlike("(?m)" + MARKERS))
    rows = quoting.select("message", "conv_id", "turn", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    rows = rows.select("message", "conv_id", "turn", "at", level(F.col("line")).alias("level"), body(F.col("line")).alias("line"))
    inside = Window.partitionBy("message").orderBy("at")  # one text's lines
    rows = rows.withColumn("starts", F.coalesce((F.col("level") != F.lag("level").over(inside)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("starts").over(inside)).where("level > 0")
    runs = rows.groupBy("message", "conv_id", "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    whole = F.array_join("lines.line", "\n")
    parts = F.array_distinct(F.transform(F.flatten(F.array(F.array(whole), F.split(whole, r"\n[ \t]*\n"), F.col("lines.line"))), normal))
    parts = runs.select("message", "conv_id", "turn", "level", F.explode(F.filter(parts, lambda p: p != "")).alias("part"))
    return parts.select("message", "conv_id", "turn", "level", F.md5("part").alias("passage"), F.length("part").alias("weight"))


def _owners_by_class(owners: DataFrame, place: Column) -> tuple[DataFrame, DataFrame]:
    """Owners that have the same common keys are one class: (owner, class, place), and (class, key) of the keys of each class."""
    sets = owners.groupBy("owner").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.first(place).alias("place"))  # one message's passages
    sets = common.written(sets.withColumn("class", F.md5(F.array_join("keys", ","))), "classes")
    return sets.select("owner", "class", "place"), sets.select("class", "keys").distinct().select("class", F.explode("keys").alias("key"))


def _latest(wanted: DataFrame, classed: DataFrame) -> DataFrame:
    """(class, turn, place): for each (class, turn) wanted the latest place of the class before that turn, if there is one.

    Running maxima over a sort of all rows, carried from partition to partition, so no class is gathered in one task.
    """
    none = F.lit(None).cast(classed.schema["place"].dataType)
    rows = classed.groupBy("class", F.col("place.turn").alias("turn")).agg(F.max("place").alias("place")).withColumn("probe", F.lit(1))
    rows = wanted.distinct().select("class", "turn", none.alias("place"), F.lit(0).alias("probe")).unionByName(rows)  # a probe precedes the places of its own turn
    order = ["class", "turn", "probe"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    rows = common.written(rows.withColumn("part", F.shiftright("_n", 33)), "sorted-places")
    inside = Window.partitionBy("class", "part").orderBy("turn", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a class reaches
    carried = rows.groupBy("class", "part").agg(F.max("place").alias("place")).select("class", "part", F.max("place").over(before).alias("carried"))
    found = rows.withColumn("place", F.max("place").over(inside)).where("probe = 0").join(carried, ["class", "part"])
    return found.select("class", "turn", F.coalesce("place", "carried").alias("place")).where("place is not null")


def _first_two(classed: DataFrame) -> DataFrame:
    """(class, first, second): the smallest place of a class, and the smallest in another conversation than that."""
    each = classed.groupBy("class", F.col("place.conv_id").alias("conv_id")).agg(F.min("place").alias("place"))
    each = common.written(each, "places")
    firsts = each.groupBy("class").agg(F.min("place").alias("first"))
    rest = each.join(common.small(firsts), "class").where(~F.col("place.conv_id").eqNullSafe(F.col("first.conv_id")))
    return firsts.join(rest.groupBy("class").agg(F.min("place").alias("second")), "class", "left")


def _best(units: DataFrame, owners: DataFrame, *, near: bool) -> DataFrame:
    """(message, level, parent, weight): the owner that shares most with each unit, by the lengths of all passages in both.

    units: message, level, conv_id, turn, key, weight. owners: owner, conv_id,
    turn, key. near: keys are of one conversation, owners must be of an earlier
    turn, and the latest wins a tie; else owners must be of another
    conversation, and the smallest (conv_id, turn, message) wins.

    Keys with at most RARE owners are joined as they are. Owners that meet a
    unit only in other keys differ in nothing but their place if they have the
    same ones, so of each such class one owner is scored: the one that would
    win. So every owner takes part, and a common key costs a row for each class.
    """
    unit = ["message", "level"]
    owners = common.written(owners.join(units.select("key").distinct(), "key", "left_semi"), "owners")
    often = common.written(owners.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("key"), "common-keys")
    often = common.small(often)
    place = F.struct("turn", "owner") if near else F.struct("conv_id", "turn", "owner")
    classed, keys = _owners_by_class(owners.join(often, "key", "left_semi"), place)
    shared = units.join(common.small(common.written(keys, "class-keys")), "key").groupBy(*unit, "conv_id", "turn", "class").agg(F.sum("weight").alias("weight"))
    shared = common.written(shared, "shared")

    if near:
        by_class = shared.join(_latest(shared.select("class", "turn"), classed), ["class", "turn"])
    else:
        ends = shared.join(_first_two(classed), "class")
        by_class = ends.withColumn("place", F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))).where("place is not null")
    by_class = by_class.select(*unit, "weight", "place")

    rare = owners.join(often, "key", "left_anti").select("key", "owner", place.alias("place"))
    pairs = units.join(rare, "key")
    pairs = pairs.where(F.col("place.turn") < F.col("turn")) if near else pairs.where(~F.col("place.conv_id").eqNullSafe(F.col("conv_id")))
    pairs = common.written(pairs.groupBy(*unit, "place").agg(F.sum("weight").alias("own")), "rare-pairs")
    pairs = pairs.withColumn("owner", F.col("place.owner")).join(classed.select("owner", "class"), "owner", "left")
    pairs = pairs.join(shared.select(*unit, "class", F.col("weight").alias("more")), [*unit, "class"], "left")
    pairs = pairs.select(*unit, (F.col("own") + F.coalesce("more", F.lit(0))).alias("weight"), "place")

    scores = by_class.unionByName(pairs).groupBy(*unit)
    best = F.max(F.struct("weight", "place")) if near else F.min(F.struct((-F.col("weight")).alias("minus"), "place"))
    best = scores.agg(best.alias("best"), F.max("weight").alias("weight"))
    return common.written(best.select(*unit, F.col("best.place.owner").alias("parent"), "weight"), "best")


def links(messages: DataFrame) -> DataFrame:
    """(message, parent, n_quotes): the quoting messages, and the message they reply to, null if it isn't found.

    That is the message that shares most with the first-level quotes, by the
    lengths of all passages in both: of those before it in its conversation, on
    ties the latest, and where none of them shares LEAST characters, of those
    in other conversations, on ties the smallest by conv_id and turn. Passages
    of less than LEAST characters count inside the conversation only. Where a
    level finds no message, the next deeper one counts.
    """
    quoted = common.written(passages(messages), "quotes")
    if quoted.isEmpty():
        return quoted.select("message", F.col("message").alias("parent"), F.lit(0).cast("long").alias("n_quotes"))
    sources = _sources(messages).withColumnRenamed("message", "owner")
    sources = common.written(sources.join(quoted.select("passage").distinct(), "passage", "left_semi"), "sources")
    units = quoted.groupBy("message", "level", "conv_id", "turn", "passage").agg(F.sum("weight").alias("weight"), F.max("weight").alias("length"))
    units = common.written(units, "units")
    own_key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")), F.lit("\0"), F.col("passage")))
    near = _best(units.withColumn("key", own_key), sources.where("turn is not null").withColumn("key", own_key), near=True)
    left = units.where(F.col("length") >= LEAST).join(near.where(F.col("weight") >= LEAST), ["message", "level"], "left_anti")
    far = _best(common.written(left.withColumnRenamed("passage", "key"), "far-units"), sources.withColumnRenamed("passage", "key"), near=False)
    both = near.withColumn("sure", F.col("weight") >= LEAST).unionByName(far.withColumn("sure", F.lit(True)))
    best = both.groupBy("message").agg(F.min_by("parent", F.struct("level", ~F.col("sure"))).alias("parent"))
    n = quoted.groupBy("message").agg(F.count("*").alias("n_quotes"))
    return n.join(best, "message", "left").select("message", "parent", "n_quotes")


def _roots(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """(message, root): the first message of the thread of each reply within its conversation, by pointer jumping."""
    at = messages.select("message", "conv_id")
    up = at.select(F.col("message").alias("parent"), F.col("conv_id").alias("_conv"))
    inner = linked.where("parent is not null").join(at, "message").join(up, "parent")
    jumps = common.written(inner.where(F.col("conv_id").eqNullSafe(F.col("_conv"))).select("message", F.col("parent").alias("root")), "threads")
    while True:
        above = jumps.select(F.col("message").alias("_m"), F.col("root").alias("_r"))
        if jumps.join(above, F.col("root") == F.col("_m"), "left_semi").isEmpty():
            return jumps
        jumps = common.written(jumps.join(above, F.col("root") == F.col("_m"), "left").select("message", F.coalesce("_r", "root").alias("root")), "threads")


def conversations(turns: DataFrame) -> DataFrame:
    """Messages without quotes in reply order: a row each.

    conv_id, position (from 0, in the conversation), turn, role, thread (turn
    of its first message), parent_conv and parent_turn (null if it quotes
    nothing that was found), n_quotes (quoted passages and lines), text.

    Threads come in the order of their first turns, messages of a thread by
    turn, so a parent comes before its replies. Null texts become ""; null
    conv_ids are one conversation, null turns come first; repeated rows are
    kept, in order of role and text. Extra columns are ignored; an empty table
    gives an empty result. No conversation is gathered in one task: positions
    come from a sort over all rows.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    messages = turns.withColumn("message", F.monotonically_increasing_id()).withColumn("own", own_text(F.col("text")))
    messages = common.written(messages, "messages")  # which fixes the numbers
    linked = common.written(links(messages), "replies")
    plain = messages.select("message", "conv_id", "turn")
    if linked.isEmpty():
        rows = messages.withColumn("thread", F.col("turn")).withColumn("parent_conv", F.lit(None).cast(turns.schema["conv_id"].dataType))
        rows = rows.withColumn("parent_turn", F.lit(None).cast(turns.schema["turn"].dataType)).withColumn("n_quotes", F.lit(0).cast("long"))
    else:
        roots = _roots(messages, linked).join(plain.select(F.col("message").alias("root"), F.col("turn").alias("thread")), "root").select("message", "thread", F.lit(True).alias("replies"))
        parents = linked.join(plain.select(F.col("message").alias("parent"), F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn")), "parent", "left").drop("parent")
        rows = messages.join(roots, "message", "left").join(parents, "message", "left")
        rows = rows.withColumn("thread", F.when(F.col("replies"), F.col("thread")).otherwise(F.col("turn"))).withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0).cast("long")))
    order = ["conv_id", "thread", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    rows = common.written(rows, "ordered")
    part = F.shiftright("_n", 33).alias("part")
    ranges = rows.groupBy("conv_id", part).agg(F.min("_n").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a conversation reaches
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "first", "before")
    same = rows["conv_id"].eqNullSafe(ranges["_conv"]) & (F.shiftright(rows["_n"], 33) == ranges["_part"])
    out = rows.join(ranges, same)
    return out.select("conv_id", (F.col("_n") - F.col("first") + F.col("before")).alias("position"), "turn", "role", "thread", "parent_conv", "parent_turn", "n_quotes", F.col("own").alias("text"))

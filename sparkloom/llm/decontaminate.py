"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after
numbers turn into typed placeholders, the other words are lower-cased, signs go. Windows of five
template words are hashed and joined with those of the benchmark items, so that a question with
other numbers or names still matches. For the pairs that match, the values in the placeholders are
held against each other: one value of the item must always stand for one value of the document,
within one occurrence of the item: windows on one alignment (place less spot), or windows in the
item's order with up to `DRIFT` words put in or left out, or else all windows of the document. A document
is contaminated by an item if in one occurrence at least `RUN` of the item's windows or half of them
occur (for all windows of the document together: half) and the placeholders are consistent. An item
without any usable window is one window as a whole, and matches with its own values only.

Edge cases: null or empty texts are clean; items with fewer than five template words match
nothing; windows with fewer than three plain words don't count; rows are judged each by its own text, also where a
doc_id is null or repeats with another text, and so are items, repeated ones once; null item_ids contaminate but
aren't listed; empty tables give no rows, or no contaminated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import inner, stored

WIDTH, PLAIN, SHARE = 5, 3, 0.5
#: Words by which the alignment may shift from one matching window to the next of the same occurrence.
DRIFT = 20
#: Matching windows in one occurrence that suffice however long the item is: thirteen words in a row.
RUN = 9
#: Benchmark windows up to which they are broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 500_000
# Units of measure and money that may follow a number.
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f mph kmh".split()
_UNITS = "(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r"|%|€|\$|£|°)(?![\p{L}\p{N}])"
# A number ends at a sign or space, or where a unit is glued to it.
_NUMBER = r"(?<![\p{L}\p{N}#=])(\d+(?:[.,:/]\d+)*)(?:(?![\p{L}\p{N}])|(?=" + _UNITS + "))"
_NAME = r"(?<=[^.!?:\s]\s)(\p{Lu}\p{Ll}+)(?!\p{L})"
_UNIT = r"(#num\S*)\s*(" + _UNITS + ")"


def _words(text: Column, valued: bool) -> Column:
    """Template words of a text; placeholders keep their value behind an `=` if valued."""
    text = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[#=]", " ")
    text = F.regexp_replace(text, _NAME, F.lit("#name=$1" if valued else "#name"))
    # Signs inside a number would cut its value in two.
    text = F.regexp_replace(text, _NUMBER, F.lit(" #num=$1 " if valued else " #num "))
    # In both forms, so that their words stay in step.
    text = F.regexp_replace(text, r"(?<=\d)[.,:/](?=\d)", "_")
    text = F.regexp_replace(text, _UNIT, F.lit("$1 #unit=$2 " if valued else "$1 #unit "))
    text = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}#=_%€$£°]+", " "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def _hash(window: Column) -> Column:
    return F.xxhash64(window)


def _windows(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all windows of width words, in order.

    The words are bound to a variable by an outer transform: named twice as an expression, they
    would be made anew for each window.
    """

    def hashes(w: Column) -> Column:
        last = F.size(w) - width
        spots = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: _hash(F.slice(w, i, width)))

    return F.flatten(F.transform(F.array(words), hashes))


def _template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith("#"), F.substring_index(w, "=", 1)).otherwise(w))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, spot, hash, valued window and whole (whether the window is the whole item, for want of others) of every benchmark item."""
    items = benchmark.select("item_id", _words(F.col("text"), True).alias("valued")).where(F.size("valued") >= WIDTH)
    items = items.withColumn("words", _template(F.col("valued")))
    own = items.select("item_id", "valued", F.posexplode(_windows(F.col("words"))).alias("spot", "hash"))
    own = own.withColumn("window", F.slice("valued", F.col("spot") + 1, WIDTH)).drop("valued")
    own = own.where(F.size(F.filter("window", lambda w: ~w.startswith("#"))) >= PLAIN)
    rest = items.join(own.select("item_id").distinct(), "item_id", "left_anti")
    whole = rest.select("item_id", F.lit(0).alias("spot"), _hash(F.col("words")).alias("hash"), F.col("valued").alias("window"), F.lit(True).alias("whole"))
    return own.withColumn("whole", F.lit(False)).unionByName(whole)


_PAIR = ["doc_id", "copy", "item_id"]


def _occurrences(hits: DataFrame) -> DataFrame:
    """The hits in each occurrence they belong to, named by kind and nr: alignments, runs in the item's order, and all hits of a text."""
    kind = lambda name, df, nr: df.select(*_PAIR, "spot", "at", F.lit(name).alias("kind"), nr.cast("long").alias("nr"))
    diagonal = F.col("at") - F.col("spot")
    # A window that the item has at several spots counts, in runs, for the spot of its most frequent alignment.
    voted = hits.withColumn("votes", F.count("*").over(Window.partitionBy(*_PAIR, diagonal)))
    best = voted.withColumn("n", F.row_number().over(Window.partitionBy(*_PAIR, "at").orderBy(F.desc("votes"), "spot"))).where("n = 1")
    order = Window.partitionBy(*_PAIR).orderBy("at")
    shift = F.abs(diagonal - F.lag(diagonal).over(order))
    starts = best.withColumn("starts", F.coalesce((F.col("spot") <= F.lag("spot").over(order)) | (shift > DRIFT), F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("starts").over(order))
    return kind("alignment", hits, diagonal).unionByName(kind("run", runs, F.col("run"))).unionByName(kind("all", hits, F.lit(0)))


def _row(prefix: str = "") -> list[Column]:
    """doc_id (a number for null) and copy, which name a row's text."""
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col("text").cast("string"))]
    return [c.alias(prefix + n) for c, n in zip(own, ("doc_id", "copy"), strict=True)]


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), item_id, coverage and consistent of every text and item that share windows to the share asked."""
    # Each item_id and text is an item of its own; stored, so that its number stays the same.
    items = stored(benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    windows = stored(benchmark_windows(items.select(F.col("item").alias("item_id"), "text")), "benchmark-windows")
    size = windows.count()
    totals = windows.groupBy("item_id").agg(F.count("*").alias("total"))
    keys = windows.select("hash", "item_id", "spot")
    if size <= BROADCAST_WINDOWS:
        keys, totals = F.broadcast(keys), F.broadcast(totals)
    docs = documents.select(*_row(), F.col("text").cast("string").alias("text"))
    own = docs.select("doc_id", "copy", F.posexplode(_windows(_words(F.col("text"), False))).alias("at", "hash"))
    for n in sorted(r["n"] for r in windows.where("whole").select(F.size("window").alias("n")).distinct().collect() if r["n"] != WIDTH):
        own = own.unionByName(docs.select("doc_id", "copy", F.posexplode(_windows(_words(F.col("text"), False), n)).alias("at", "hash")))
    hits = stored(own.join(keys, "hash").select(*_PAIR, "spot", "at").distinct(), "benchmark-hits")
    one = [*_PAIR, "kind", "nr"]
    placed = stored(_occurrences(hits), "benchmark-occurrences")
    enough = placed.groupBy(*one).agg(F.count_distinct("spot").alias("found")).join(totals, "item_id").where((F.col("found") >= SHARE * F.col("total")) | ((F.col("kind") != "all") & (F.col("found") >= RUN)))
    enough = stored(enough.select(*one, (F.col("found") / F.col("total")).alias("coverage")), "benchmark-pairs")
    # Placeholder values, of the matching occurrences only and of windows that have placeholders.
    slots = windows.where(F.exists("window", lambda w: w.startswith("#")))
    asked = placed.join(enough.select(*one), one, "left_semi").join(slots.select("item_id", "spot", "window", "whole"), ["item_id", "spot"])
    ids = enough.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    valued = docs.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("copy") == F.col("_copy")), "left_semi").select("doc_id", "copy", _words(F.col("text"), True).alias("valued"))
    both = asked.join(valued, ["doc_id", "copy"]).select(*one, F.explode(F.arrays_zip(F.col("window").alias("mine"), F.slice("valued", F.col("at") + 1, F.size("window")).alias("theirs"))).alias("x"), "whole")
    pairs = both.select(*one, F.col("x.mine").alias("mine"), F.col("x.theirs").alias("theirs"), "whole").where(F.col("mine").startswith("#"))
    values = pairs.groupBy(*one, "mine").agg(F.min("theirs").alias("lo"), F.max("theirs").alias("hi"), F.max(F.col("mine") == F.col("theirs")).alias("same"), F.max("whole").alias("whole"))
    # An item whose own values stand in the document is contained as it is, whatever else matches.
    judged = values.groupBy(*one).agg((F.bool_and((F.col("lo") == F.col("hi")) & ~F.col("whole")) | F.bool_and("same")).alias("ok"))
    found = enough.join(judged, one, "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    named = found.withColumnRenamed("item_id", "item").join(items.select("item", "item_id"), "item")
    best = named.groupBy(*_PAIR).agg(F.max(F.when(F.col("ok"), F.col("coverage"))).alias("held"), F.max("coverage").alias("most"), F.bool_or("ok").alias("consistent"))
    return best.select(*_PAIR, F.coalesce("held", "most").alias("coverage"), "consistent")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (sorted item_ids), coverage (the highest) of every document."""
    found = matches(documents, benchmark).where("consistent")
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.sort_array(F.collect_set("item_id")).alias("_items"), F.max("coverage").alias("_coverage"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_row("_row_"))
    joined = own.join(per, (F.col("_row_doc_id") == F.col("_id")) & (F.col("_row_copy") == F.col("_copy")), "left")
    return joined.select("doc_id", F.col("_id").isNotNull().alias("contaminated"), F.coalesce("_items", F.array().cast(per.schema["_items"].dataType)).alias("items"), F.coalesce("_coverage", F.lit(0.0)).alias("coverage"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, with the columns given."""
    doc, copy = inner("doc"), inner("copy")
    bad = matches(documents, benchmark).where("consistent").select(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).distinct()
    row = _row()
    return documents.join(bad, (row[0] == F.col(doc)) & (row[1] == F.col(copy)), "left_anti")

"""Benchmark decontamination by a distributed positional inverted index. DataFrame and SQL functions only.

The index holds a posting (term, row, pos) for every training word that is a term of the test items; postings of other terms would never be read, so
they aren't stored. A phrase is looked up from its rarest term: its postings give alignments, and the offset-adjusted postings of the other
terms are intersected with them. Proximity looks up pairs of terms within a distance. A row is known by a 64-bit key of its id and text, so that
equal rows share postings and rows with one id and different texts don't.

The test side's terms and the candidate rows are broadcast only after their number was counted and found to be at most BROADCAST_ROWS; beyond that
the joins shuffle. The index is a table in the shared folder.

Cases: null text has no words and no hits; empty benchmark, or items without words, hit nothing; items of fewer words than a window are one window;
items of equal text count each; an item with a null id hits, but is in no list of ids and not counted in n_items; rows with a null id keep it; repeated rows get
equal results; an empty table gives an empty result. Other columns of both tables are not read, whatever their names. A text is split in one task, by Spark's own
functions: it needs some ten times its size there. Rows are known by 64-bit keys: among 10^9 different rows 0.03 pairs are expected to share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.shared import row_key, stage_table

#: Everything but digits, a-z and what lies beyond ASCII, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
HIT_SHARE = 20
BROADCAST_ROWS = 1_000_000
#: A term that no word can be; its posting in each row carries the row's number of words.
END = "\x00"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed. Where a text is all ASCII, lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words; an empty string may stand first and last, where the text begins or ends with what lies between words."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN)


def words(text: Column) -> Column:
    return F.array_remove(split_words(text), "")


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, ipos, term, size): the words of each distinct item, as strings, from position 0; size is the item's number of words."""
    listed = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    # an id with several texts is several items here
    keyed = listed.withColumn("key", F.xxhash64("item", "w"))
    return keyed.select("key", "item", F.size("w").alias("size"), F.posexplode("w").alias("ipos", "term"))


def positional_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, row, pos, id): the postings of the terms, and for each document one of END, whose pos is its number of words and id its id.

    Positions count from 0 or 1, the same way within a row.
    """
    found = split_words(F.col(text))
    n = F.size("w") - F.when(F.element_at("w", 1) == "", 1).otherwise(0) - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    split = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row"), found.alias("w")).withColumn("n", n)
    exploded = split.select("id", "row", "n", F.posexplode(F.array_append("w", F.lit(END))).alias("pos", "term"))
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([(END,)], "term string"))
    joined = exploded.join(checked_broadcast(wanted, terms.select("term").distinct().count()), "term")
    last = F.col("term") == END
    return stage_table(joined.select("term", "row", F.when(last, F.col("n")).otherwise(F.col("pos")).cast("int").alias("pos"), F.when(last, F.col("id")).alias("id")), "postings")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, key, item, start, length): runs of a row's words that equal consecutive words of an item, as long as a window or longer.

    Every window of an item is anchored at its rarest term. A posting of an anchor gives an alignment of row and item; the other terms' postings,
    adjusted by their offsets, are intersected over all positions that windows with this anchor cover. Runs of met positions hold all occurrences.
    """
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    known = items.join(counts, "term", "left").select("key", "ipos", "size", "term", F.coalesce("n", F.lit(0)).alias("n"))
    # the windows that cover a position start up to window - 1 before it, and end within the item
    reach = F.sequence(F.greatest(F.col("ipos") - window + 1, F.lit(0)), F.least(F.col("ipos"), F.greatest(F.col("size") - window, F.lit(0))))
    covered = known.select("key", "size", "term", "n", "ipos", F.explode(reach).alias("first"))
    rarest = covered.groupBy("key", "first").agg(F.min_by(F.struct("term", "ipos"), F.struct("n", "ipos")).alias("a"), F.min("n").alias("n")).where("n > 0")
    anchors = stage_table(rarest.select("key", F.col("a.term").alias("term"), F.col("a.ipos").alias("apos")).distinct(), "anchors")
    postings = index.where(F.col("term") != END).select("term", "row", "pos")
    aligned = postings.join(checked_broadcast(anchors, anchors.count()), "term").select("row", "key", "apos", (F.col("pos") - F.col("apos")).alias("shift"))
    aligned = stage_table(aligned.distinct(), "alignments")
    rows = aligned.select("row").distinct()
    near = postings.join(checked_broadcast(rows, rows.count()), "row", "left_semi")
    around = F.sequence(F.greatest(F.col("apos") - window + 1, F.lit(0)), F.col("apos") + window - 1)
    asked = aligned.select("row", "key", "shift", F.explode(around).alias("ipos")).distinct()
    wanted = asked.join(items.select("key", "ipos", "term", "size", "item"), ["key", "ipos"]).withColumn("pos", F.col("shift") + F.col("ipos"))
    met = wanted.join(near, ["row", "pos", "term"], "left_semi")
    order = Window.partitionBy("row", "key", "shift").orderBy("ipos")
    runs = met.withColumn("run", F.col("ipos") - F.row_number().over(order)).groupBy("row", "key", "item", "size", "shift", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= F.least(F.col("size"), F.lit(window))).select("row", "key", "item", "start", F.col("length").cast("int").alias("length"))


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(pair, row, pos_a, pos_b) where terms a and b of (pair, a, b) stand at most `distance` words apart, in either order."""
    postings = index.where(F.col("term") != END).select("term", "row", "pos").distinct()
    width = distance + 1
    left = postings.withColumnsRenamed({"term": "a", "pos": "pos_a"}).join(pairs, "a").withColumn("cell", F.explode(F.sequence(F.floor((F.col("pos_a") - distance) / width), F.floor((F.col("pos_a") + distance) / width))))
    right = postings.withColumnsRenamed({"term": "b", "pos": "pos_b"}).withColumn("cell", F.floor(F.col("pos_b") / width))
    return left.join(right, ["b", "row", "cell"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= distance) & (F.col("pos_a") != F.col("pos_b"))).select("pair", "row", "pos_a", "pos_b").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    items = stage_table(item_words(benchmark), "items")
    index = positional_index(docs, items, doc_id, text)
    found = stage_table(phrase_matches(index, items), "matches")
    spans = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = spans.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.where(F.col("term") == END).select(F.col("id").alias(doc_id), "row", F.col("pos").cast("long").alias("n_words")).join(hits.join(named, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        doc_id, "row", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )

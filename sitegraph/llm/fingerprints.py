"""Document fingerprints from closed syncmers.

A k-mer is five words in a row, its inner substrings are the pairs of neighbouring words in it. It
is chosen if the smallest of its pair hashes (leftmost of equal ones) lies at its left or right edge.
That depends on the five words only, so a passage gives the same anchors wherever it stands. Each
anchor is written with its distance from the one before, and two fingerprints match where anchor and
distance agree. Only DataFrame functions.

To set each document beside the next one in descending doc_id, rows are dealt out by ranges of ids and
looked through in order there; the first row of each range is also sent, once, to the range before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.operators.running import number_rows, range_buckets
from sitegraph.session import cut

# Fixed values of the method: words in a k-mer, words in an inner substring.
K, S = 5, 2
PAIRS = K - S + 1

#: log2 of the ids a range spans; a range of distinct ids holds no more rows than that.
RANGE_BITS = 9
#: Ranges whose first rows are broadcast (some 40 bytes each); beyond that their join shuffles the texts once more.
BROADCAST_RANGES = 100_000


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the anchors of a text column, in order, as numbers below 2^32.

    A text without a chosen k-mer (few words) has one anchor, of all its words; one without words
    has none.
    """
    words, pairs, at = (f"_{out}_{name}" for name in ("words", "pairs", "at"))
    split = df.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\s+"), ""))
    starts = F.slice(words, 1, F.greatest(F.size(words) - (S - 1), F.lit(0)))
    hashed = split.withColumn(pairs, F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1))))

    def chosen(m: Column, i: Column) -> Column:
        first, last = [F.get(pairs, i + j) for j in range(1, PAIRS - 1)], F.get(pairs, i + PAIRS - 1)
        return F.when((m <= F.least(*first, last)) | (last < F.least(m, *first)), i)

    kmers = F.slice(pairs, 1, F.greatest(F.size(pairs) - (PAIRS - 1), F.lit(0)))
    placed = hashed.withColumn(at, F.array_compact(F.transform(kmers, chosen)))

    def anchor(i: Column, j: Column) -> Column:
        gap = F.when(j > 0, i - F.get(at, j - 1)).otherwise(F.lit(0))
        # pairs 0, 2 and 3 of the k-mer hold its five words
        return F.shiftrightunsigned(F.xxhash64(F.get(pairs, i), F.get(pairs, i + 2), F.get(pairs, i + 3), gap), 32)

    whole = F.when(F.size(words) > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(words, " ")), 32)))
    none = F.array().cast("array<bigint>")
    anchors = F.when(F.size(at) > 0, F.transform(at, anchor)).otherwise(F.coalesce(whole, none))
    return placed.withColumn(out, anchors).drop(words, pairs, at)


def as_fingerprint(anchors: str) -> Column:
    return F.array_join(F.col(anchors).cast("array<string>"), " ")


def likeness(a: str, b: str) -> Column:
    """Twice the distinct anchors in both, over the distinct anchors of each; 1 for two texts without words."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def beside_next(docs: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """doc_id, text, and next_text: the text of the next document in descending doc_id (the first after the last).

    Rows of equal id follow each other by a hash of their text; a NULL id comes last. Texts cross the
    network once: their place is a function of their own id, and the few rows that begin a range are
    known from a narrow pass before. Many rows of one id would share a task, which streams them.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    bucket = F.coalesce(F.shiftright(F.col("doc_id"), range_bits), F.lit(-(1 << 60)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": tie, "_range": bucket})
    firsts = rows.groupBy("_range").agg(
        F.min(F.struct(F.bitwise_not("doc_id").alias("down"), F.col("_tie").alias("tie"))).alias("first")
    )
    ranged = range_buckets(firsts, [], ["_range"])
    ranked = cut(number_rows(ranged, [], F.col("range_bucket"), [F.col("_range")], "rank"))
    n = ranked.count()
    before = ranked.select((F.col("rank") - 1).alias("rank"), F.col("_range").alias("_target"))
    before = before.withColumn("rank", F.when(F.col("rank") == 0, F.lit(n)).otherwise(F.col("rank")))
    heads = cut(
        ranked.join(before, "rank").select(
            F.bitwise_not("first.down").alias("_head_id"), F.col("first.tie").alias("_head_tie"), "_target"
        )
    )
    if n <= BROADCAST_RANGES:
        heads = F.broadcast(heads)
    told = rows.join(
        heads, rows["doc_id"].eqNullSafe(heads["_head_id"]) & (rows["_tie"] == heads["_head_tie"]), "left"
    ).select("doc_id", "text", "_tie", "_range", "_target")
    own = F.struct(F.col("_range").alias("bucket"), F.lit(0).alias("copy"))
    sent = F.struct(F.col("_target").alias("bucket"), F.lit(1).alias("copy"))
    places = F.when(F.col("_target").isNull(), F.array(own)).otherwise(F.array(own, sent))
    placed = told.select("doc_id", "text", "_tie", F.inline(places))
    return placed.withColumn("next_text", F.lead("text").over(_in_order()))


def _in_order():
    return Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "_tie")


def fingerprinted(docs: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending doc_id. A NULL text is empty. Repeated rows give a row
    each. Columns other than doc_id and text are not read. An empty table gives an empty result; a
    single document is its own next one.
    """
    paired = with_anchors(beside_next(docs, range_bits), "text", "anchors")
    ahead = paired.withColumn("next_anchors", F.lead("anchors").over(_in_order())).where("copy = 0")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    changed = with_anchors(ahead.withColumn("edited", edited), "edited", "edited_anchors")
    return changed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_fingerprint("anchors").alias("fingerprint"),
        as_fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )

"""Document fingerprints by I-Match, in DataFrame operations only.

Terms in a band of inverse document frequency make the lexicon. A document's fingerprint is the hash of its sorted distinct
lexicon terms, and the hashes of what it holds of randomised subsets of the lexicon: a change of some terms leaves the subsets alone that hold none of them.
A subset's share of the lexicon goes down by steps of four with the document's length, so that a subset
holds about one of its terms however long it is; a document states two neighbouring steps, and lengths up to four times apart share one.

Document frequencies are counted over all documents, in 2**21 buckets of term hashes. Which buckets are in the band goes to
the tasks as a bit table of 256 KB, whatever the number of terms; a bucket's chance load of rare terms is some 10**-5 of
the documents or less, at any size, far below the band's upper end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import NULL_ID, cut, fresh, numbered, partitions, restore_id, table

#: Terms are runs of letters and digits of any script, in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: log2 of the buckets of document frequency.
BUCKET_BITS = 21
#: The band: ln((documents + 1 / e**-low) / documents with the term) lies within these, so terms of at most 1 % of the documents (and 1) and at least one in 100,000.
LOW_IDF, HIGH_IDF = math.log(100), math.log(100_000)
#: Subsets of the lexicon at each of a document's two steps.
SUBSETS = 32
#: Terms a subset may hold on average, before the next step is taken.
LOAD = 1.5
_FIRST = SUBSETS.bit_length() - 1
#: What ``xxhash64`` gives for an empty array.
_NOTHING = 42


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct terms (null and termless texts: none)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """One row (bits array<long>): which buckets of term hashes have a document frequency within the band. Every row of docs is a document."""
    spark = docs.sparkSession
    n = docs.count()
    most, least = (n + math.exp(low)) * math.exp(-low), n * math.exp(-high)
    bucket = F.explode(F.array_distinct(F.transform(term_hashes(F.col(text_col)), lambda t: t.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int"))))
    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(least, most))
    words = counts.groupBy(F.shiftright("bucket", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, bucket & 63))").alias("word"))
    dense = spark.range(1 << (BUCKET_BITS - 6)).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("w"))
    return cut(dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("bits")), "lexicon")


def with_fingerprint(df: DataFrame, text_col: str, lexicon: DataFrame, name: str) -> DataFrame:
    """df and a column ``name`` of struct(full long, step int, near array<int>, far array<int>).

    ``full`` is the hash of the sorted distinct lexicon terms; ``near`` and ``far`` hold a hash from 1 to 2**24 - 1 for each subset of the document's step and the
    one after it, 0 where the document has none of a subset's terms. Equal texts have equal fingerprints. A text without lexicon terms (null: empty)
    has the hash of the whole text and empty subsets, so that it resembles its equals only.
    """
    band, bits, step = fresh(df, "_band", "_bits", "_step")
    inside = lambda t: F.getbit(F.get(F.col(bits), F.shiftright(t, 6).bitwiseAND(F.lit((1 << (BUCKET_BITS - 6)) - 1)).cast("int")), t.bitwiseAND(F.lit(63)).cast("int")) == 1
    out = df.withColumn(bits, lexicon.scalar()).withColumn(band, F.array_sort(F.filter(term_hashes(F.col(text_col)), inside))).drop(bits)
    size = F.size(band)
    steps = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size, F.lit(1)) / F.lit(LOAD * SUBSETS)) / F.lit(math.log(4)))).cast("int")
    out = out.withColumn(step, F.lit(_FIRST) + 2 * steps)

    def subsets(more: int) -> Column:
        mask = F.expr(f"shiftleft(1L, {step} + {more}) - 1")
        place = lambda t: F.shiftrightunsigned(t, BUCKET_BITS).bitwiseAND(mask)
        # terms that are in any subset, about one a subset, with the subset's number above the hash
        taken = F.transform(F.filter(F.col(band), lambda t: place(t) < SUBSETS), lambda t: (place(t) * F.lit(1 << 58)).bitwiseOR(F.shiftrightunsigned(t, 6)))
        groups, eight = F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS // 8 - 1).cast("long")), lambda g: F.sequence(g * 8, g * 8 + 7)
        within = lambda some, g: F.transform(eight(g), lambda k: F.xxhash64(F.filter(some, lambda p: F.shiftright(p, 58) == k)))
        # eight subsets a group, so that each term is compared some 12 times and not with all subsets; an array of one binds a name to what it holds
        each = F.transform(F.array(taken), lambda all_: F.flatten(F.transform(groups, lambda g: F.get(F.transform(F.array(F.filter(all_, lambda p: F.shiftright(p, 61) == g)), lambda some: within(some, g)), 0))))
        return F.transform(F.get(each, 0), lambda h: F.when(h == _NOTHING, 0).otherwise(F.pmod(h, F.lit((1 << 24) - 1)) + 1).cast("int"))

    full = F.when(size > 0, F.xxhash64(band)).otherwise(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit("text")))
    return out.withColumn(name, F.struct(full.alias("full"), F.col(step).alias("step"), subsets(0).alias("near"), subsets(2).alias("far"))).drop(band, step)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal hashes among the subsets of their common steps that either document has terms of; equal ``full`` hashes: 1; no common step: 0."""

    def tally(x: Column, y: Column) -> Column:
        """Subsets with terms, and 2**16 for each of them that is equal."""
        each = F.zip_with(x, y, lambda p, q: F.when((p == 0) & (q == 0), 0).when(p == q, (1 << 16) + 1).otherwise(1))
        return F.aggregate(each, F.lit(0), lambda s, v: s + v)

    gap = b["step"] - a["step"]
    sums = F.when(gap == 0, tally(F.concat(a["near"], a["far"]), F.concat(b["near"], b["far"]))).when(gap == 2, tally(a["far"], b["near"])).when(gap == -2, tally(a["near"], b["far"])).otherwise(0)
    share = F.transform(F.array(sums), lambda s: F.when(s == 0, F.lit(0.0)).otherwise(F.shiftright(s, 16) / s.bitwiseAND(F.lit(0xFFFF)).cast("double")))
    return F.when(a["full"] == b["full"], F.lit(1.0)).otherwise(F.get(share, 0))


def as_text(fp: Column) -> Column:
    """The fingerprint as text: 16 hex digits of all terms, the step, and 6 hex digits for each subset."""
    return F.concat(
        F.lpad(F.lower(F.hex(fp["full"])), 16, "0"), F.lit(":"), fp["step"].cast("string"), F.lit(":"),
        F.array_join(F.transform(F.concat(fp["near"], fp["far"]), lambda h: F.lpad(F.lower(F.hex(h)), 6, "0")), ""),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (text) of each row; the lexicon is that of docs. Rows are judged each by itself, whatever their ids; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_fingerprint(rows, "text", lexicon(rows), "fp").select("doc_id", as_text(F.col("fp")).alias("fingerprint"))


def with_next(rows: DataFrame, id_col: str, row: str, carry: list[str]) -> DataFrame:
    """Rows with ``next_<c>`` for each c of carry: the values of the row that follows in descending order of id (null last), for the last row those of the first.
    Rows that share an id follow each other by a hash of ``row``, a number of each row's own (``numbered``).

    Sampled quantiles of the id cut the order into buckets; an id that spans several is cut by that hash. Each bucket gets
    a copy of the first row of the bucket after it, so a window over a bucket sees every row's successor, and all rows travel once.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_h": F.xxhash64(row)})
    wanted = 8 * partitions(spark)
    found = rows.agg(F.percentile_approx("_id", [i / wanted for i in range(1, wanted)], 16 * wanted).alias("at")).first()["at"] or [0]
    # two steps of a search for the number of cuts below the id, and not above it
    every = max(1, math.isqrt(len(found)))
    cuts, coarse = F.array(*[F.lit(x) for x in found]), F.array(*[F.lit(x) for x in found[every - 1 :: every]])

    def below(test) -> Column:
        skipped = F.size(F.filter(coarse, test)) * every
        return skipped + F.size(F.filter(F.slice(cuts, skipped + 1, F.lit(every)), test))

    rows = rows.withColumns({"_low": below(lambda c: c < F.col("_id")), "_high": below(lambda c: c <= F.col("_id"))})
    part = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * (F.col("_high") - F.col("_low") + 1)).cast("int")
    rows = rows.withColumn("_bucket", F.col("_low") + F.least(part, F.col("_high") - F.col("_low"))).drop("_low", "_high")
    # at most ``wanted`` buckets, so their first rows are a list of bounded size
    order = ["_id", "_h", row]
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct(*order)).alias("top")).orderBy(F.col("_bucket").desc()).collect()
    if not firsts:
        return rows.select(*[c for c in rows.columns if c not in ("_id", "_h", "_bucket")], *[F.col(c).alias(f"next_{c}") for c in carry])
    heads = spark.createDataFrame([(*r.top, firsts[i - 1]._bucket) for i, r in enumerate(firsts)], f"_id long, _h long, `{row}` long, _before int")
    dealt = rows.join(F.broadcast(heads), order, "left").withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array("_bucket")).otherwise(F.array("_bucket", F.col("_before") - wanted - 1))))
    # a copy for another bucket comes with a number below zero
    dealt = dealt.withColumns({"_copy": F.col("_at") < 0, "_bucket": F.when(F.col("_at") < 0, F.col("_at") + wanted + 1).otherwise(F.col("_at"))})
    follow = Window.partitionBy("_bucket").orderBy(F.col("_copy"), *[F.col(c).desc() for c in order])
    out = dealt.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in carry]).where("not _copy")
    return out.drop("_id", "_h", "_bucket", "_before", "_at", "_copy")


def imatch_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the row's own with its last half replaced by as much of the beginning of the next row's, in descending order of id
    (``with_next``). Null text counts as empty: nothing is replaced, and its likeness to itself is 1. A null id comes last and back as null;
    repeated ids and rows are rows of their own. A single row follows itself. Extra columns are pruned; an empty table gives an empty result.
    """
    rows, row = numbered(docs)
    rows = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(row).alias("row"))
    words = lexicon(rows)
    linked = with_next(with_fingerprint(rows, "text", words, "fp"), "doc_id", "row", ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    linked = linked.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = with_fingerprint(linked, "edited", words, "edited_fp")
    return out.select(
        restore_id("doc_id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_edits(table(spark, sf_dir, "documents"))

"""SimHash fingerprints of documents in DataFrame functions alone, and all fingerprints within a Hamming radius.

Terms are the distinct words of a text; the md5 of a term gives 128 signed bits, and each bit of a text's fingerprint is the sign of
its terms' votes. A term votes with the bit length of its length: long words say more, but no blob outvotes a text. Words are
exploded and summed again in the task that holds their document, two bits to a long, so votes are never shuffled.

Documents meet the next one (descending doc_id) in buckets of the id, cut at quantiles: a range of ids is a window, and the first
document of each bucket is copied to the end of the bucket before it. So texts are shuffled once, and no window holds the table.

Fingerprints within a radius are found by permuted block tables: of BLOCKS blocks of a fingerprint, at most `radius` can differ,
so two fingerprints in reach agree in some BLOCKS - radius blocks. Each such choice of blocks is a table that is joined on these;
a pair counts in the first table that it agrees in. Keys that many fingerprints share are split by salts. Equal fingerprints are
one before that, with their number, so copies cost nothing; the pairs that are emitted are those of different fingerprints in reach.

Null counts as an empty text, which has no votes: its fingerprint is zero. Null ids come last. Rows with one id are ordered by
xxhash64 of the text, then text; repeated rows each give their row, and follow each other. A single row's next document is itself.
Extra columns are ignored, whatever their names are. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import handed_on, scratch, text_or_empty, written

BITS, BLOCKS, RADIUS = 128, 8, 6
_WIDE = BITS // BLOCKS
SPACE = r"[\x20\x09-\x0D]+"
#: Documents in a bucket of ids, unless that makes more buckets than the driver shall hold bounds of.
BUCKET, MOST_BUCKETS = 4096, 1 << 16
#: Fingerprints with one key that meet in one task.
SHARED = 4096


def fingerprints(rows: DataFrame, keys: list[str], *texts: Column) -> DataFrame:
    """keys, which tell rows apart, kind (the number of the text in texts), hi and lo: the halves of its fingerprint."""
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), t.alias("t")) for i, t in enumerate(texts)))).alias("x"))
    words = each.select(*keys, "x.kind", F.explode(F.array_distinct(F.split("x.t", SPACE))).alias("word"))
    half = lambda at: F.conv(F.substring("md5", at, 16), 16, -10).cast("long")
    voted = words.select(*keys, "kind", F.md5("word").alias("md5"), F.when(F.col("word") == "", 0).otherwise(F.length(F.bin(F.length("word")))).cast("long").alias("weight"))
    voted = voted.select(*keys, "kind", "weight", half(1).alias("hi"), half(17).alias("lo"))
    # two bits of a half, 32 apart, to a sum
    sums = [F.expr(f"sum((shiftrightunsigned({half}, {j}) & 4294967297L) * weight)").alias(f"{half}{j}") for half in ("hi", "lo") for j in range(32)]
    summed = voted.groupBy(*keys, "kind").agg(F.sum("weight").alias("total"), *sums)

    def signs(half: str) -> Column:
        votes = {j: f"{half}{j} & 4294967295L" for j in range(32)} | {32 + j: f"shiftrightunsigned({half}{j}, 32)" for j in range(32)}
        return F.expr(" + ".join(f"if(2 * ({v}) > total, {_power(j)}, 0L)" for j, v in votes.items())).alias(half)

    return summed.select(*keys, "kind", signs("hi"), signs("lo"))


def _power(j: int) -> str:
    return f"{1 << j}L" if j < 63 else "shiftleft(1L, 63)"


def _bucketed(rows: DataFrame, count: int) -> DataFrame:
    """rows (at, doc_id, text) with their bucket (cut, sub), whose order is that of (at, xxhash64 of the text)."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_BUCKETS, max(4 * most, count // BUCKET))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    times = sorted(Counter(cuts).items())
    if not times:
        return rows.withColumns({"cut": F.lit(0), "sub": F.lit(0)})
    # the number of cuts at or below the id, by halving
    values, counts = (F.split(F.lit(",".join(str(x[i]) for x in times)), ",").cast(kind) for i, kind in ((0, "array<bigint>"), (1, "array<int>")))
    steps = F.array(*(F.lit(1 << p) for p in reversed(range(len(times).bit_length()))))
    at = lambda values, i: F.get(values, F.least(F.greatest(i, F.lit(1)), F.lit(len(times))) - 1)
    found = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(times)) & (at(values, a + s) <= F.col("at")), a + s).otherwise(a))
    rows = rows.withColumn("cut", found)
    if times and max(t for _, t in times) == 1:
        return rows.withColumn("sub", F.lit(0))
    # an id at which several quantiles meet has as many shares of its own, by hash; what follows it comes after these
    share = F.col("xx") / F.lit(2.0**64) + 0.5
    hot = F.least(F.floor(share * at(counts, F.col("cut"))).cast("int"), at(counts, F.col("cut")) - 1)
    own = (F.col("cut") > 0) & (at(values, F.col("cut")) == F.col("at"))
    return rows.withColumn("sub", F.when(own, hot).when(F.col("cut") > 0, at(counts, F.col("cut"))).otherwise(0))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and next, the text of the next document by descending doc_id (after the last: the first); (cut, sub, nth) tell
    rows apart in that order. Each bucket (cut, sub) ends with the first row of the following one, marked as ghost."""
    spark = docs.sparkSession
    # ~x falls as x rises, and never overflows
    at = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), at.alias("at")).withColumn("xx", F.xxhash64("text"))
    rows = _bucketed(rows, docs.count())
    firsts = sorted((r.cut, r.sub, r.first) for r in rows.groupBy("cut", "sub").agg(F.min("at").alias("first")).collect())  # MOST_BUCKETS at most, and shares of hot ids
    linked = [(*b, *firsts[i - 1][:2]) for i, b in enumerate(firsts)]
    ends = F.broadcast(spark.createDataFrame(linked, "cut int, sub int, at long, to_cut int, to_sub int"))
    ghosts = rows.join(ends, ["cut", "sub", "at"]).groupBy("to_cut", "to_sub").agg(F.min(F.struct("xx", "text")).alias("least"))
    ghosts = ghosts.select(F.col("to_cut").alias("cut"), F.col("to_sub").alias("sub"), F.lit(None).cast("long").alias("doc_id"), "least.text", F.lit(0).cast("long").alias("at"), "least.xx", F.lit(True).alias("ghost"))
    every = rows.select("cut", "sub", "doc_id", "text", "at", "xx", F.lit(False).alias("ghost")).union(ghosts)
    order = W.partitionBy("cut", "sub").orderBy("ghost", "at", "xx", "text")
    return every.select("cut", "sub", "doc_id", "text", "ghost", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, and fingerprints as halves: hi, lo of the text, edited_hi, edited_lo of
    the text whose last half is replaced by the start of the next document, next_hi, next_lo of that."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = in_order(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("changed", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("changed").cast("binary"), 256))
    keys = ["cut", "sub", "nth", "ghost", "doc_id", "n_chars", "edited_sha256"]
    made = fingerprints(rows, keys, F.col("text"), F.col("changed"))
    kind = lambda i, name: F.max(F.when(F.col("kind") == i, F.col(name)))
    made = made.groupBy(*keys).agg(kind(0, "hi").alias("hi"), kind(0, "lo").alias("lo"), kind(1, "hi").alias("edited_hi"), kind(1, "lo").alias("edited_lo"))
    follow = W.partitionBy("cut", "sub").orderBy("nth")
    made = made.withColumns({"next_hi": F.lead("hi").over(follow), "next_lo": F.lead("lo").over(follow)})
    return made.where(~F.col("ghost")).drop("cut", "sub", "nth", "ghost")


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return functools.reduce(operator.add, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def _block(k: int, hi: Column, lo: Column) -> Column:
    """Block k of a fingerprint, counted from its first bits."""
    per = 64 // _WIDE
    return F.shiftrightunsigned((hi, lo)[k // per], 64 - _WIDE * (k % per + 1)).bitwiseAND((1 << _WIDE) - 1)


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of different fingerprints in reach of each other, each pair once: hi, lo, n, least and other_hi, other_lo, other_n,
    other_least. prints: distinct hi, lo, with n and least, which are handed through."""
    agree = BLOCKS - radius
    if not 0 < agree <= 64 // _WIDE:
        raise ValueError(f"a radius of {radius} needs keys of 1 to {64 // _WIDE} blocks of {BLOCKS}")
    hi, lo = F.col("hi"), F.col("lo")
    cut = prints.select("hi", "lo", "n", "least", *(_block(k, hi, lo).alias(f"b{k}") for k in range(BLOCKS)))
    joined = lambda ks: " | ".join(f"shiftleft(b{k}, {_WIDE * i})" for i, k in enumerate(ks))
    tables = ", ".join(f"struct({sum(1 << k for k in ks)} AS t, {joined(ks)} AS key)" for ks in itertools.combinations(range(BLOCKS), agree))
    keyed = cut.select("hi", "lo", "n", "least", F.explode(F.expr(f"array({tables})")).alias("x")).select("x.t", "x.key", "hi", "lo", "n", "least")
    shared = keyed.groupBy("t", "key").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("salts"), F.count("*").alias("held")).where("held > 1").drop("held")
    keyed = written(keyed.join(shared, ["t", "key"]), "shared")
    mine = keyed.withColumn("salt", F.pmod(F.xxhash64("hi", "lo"), F.col("salts")).cast("int")).withColumn("upto", F.expr("shiftleft(1, length(bin(t))) - 1"))
    other = keyed.select("t", "key", *(F.col(c).alias(f"other_{c}") for c in ("hi", "lo", "n", "least")), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    xor = [hi.bitwiseXOR(F.col("other_hi")), lo.bitwiseXOR(F.col("other_lo"))]
    equal = functools.reduce(operator.add, (F.when(_block(k, *xor) == 0, 1 << k).otherwise(0) for k in range(BLOCKS)))
    # the first table that a pair agrees in: no other block up to the table's last one is equal
    first = equal.bitwiseAND(F.col("upto")) == F.col("m.t")
    ordered = (hi < F.col("other_hi")) | ((hi == F.col("other_hi")) & (lo < F.col("other_lo")))
    near = distance(("hi", "lo"), ("other_hi", "other_lo")) <= radius
    joined = mine.alias("m").join(other.alias("o"), (F.col("m.t") == F.col("o.t")) & (F.col("m.key") == F.col("o.key")) & (F.col("m.salt") == F.col("o.salt")) & ordered & near & first)
    return joined.select("hi", "lo", "n", "least", "other_hi", "other_lo", "other_n", "other_least")


def neighbours(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (hi, lo, and doc_id, a row for each document) by fingerprint: hi, lo, n_near: the documents in reach of one of them, without
    itself, and near_id: the least id of these and of its own."""
    own = written(prints.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "prints")
    pairs = written(within(own, radius), "pairs")
    turned = pairs.select(F.col("other_hi").alias("hi"), F.col("other_lo").alias("lo"), F.col("n").alias("other_n"), F.col("least").alias("other_least"))
    links = pairs.select("hi", "lo", "other_n", "other_least").union(turned).groupBy("hi", "lo").agg(F.sum("other_n").alias("more"), F.min("other_least").alias("lower"))
    return own.join(links, ["hi", "lo"], "left").select("hi", "lo", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), F.least("least", "lower").alias("near_id"))


def _said(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (hi, lo))))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, near_id."""
    own = ("hi", "lo")
    with scratch():
        made = written(edited(docs), "fingerprints")
        # as a table, so that a fingerprint of many documents is a skewed join that Spark can split
        found = made.join(written(neighbours(made, radius), "near"), list(own))
        return handed_on(
            found.select(
                "doc_id",
                "n_chars",
                "edited_sha256",
                _said(*own).alias("fingerprint"),
                _said("edited_hi", "edited_lo").alias("edited_fingerprint"),
                likeness(own, ("edited_hi", "edited_lo")).alias("near_edited"),
                likeness(own, ("next_hi", "next_lo")).alias("near_next"),
                "n_near",
                "near_id",
            ),
            "simhash",
        )

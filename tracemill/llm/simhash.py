"""SimHash document fingerprints and a Hamming-radius search, with DataFrame functions alone.

Fingerprints: a text's terms are its words and its pairs of adjacent words. Each term's hash votes on every bit, for or
against, with the term's weight: long terms are rare and weigh more. Votes for two bits travel in one long, so that one
aggregation of ``BITS / 2`` sums counts them all; a bit is set if more than half of the weight voted for it.

Search: permuted block tables. A fingerprint is cut into ``RADIUS + 1`` blocks and stands in one table per block with
that block in front. Fingerprints within the radius agree in some block, so an equality join on the front block meets
every one of them; the join's condition compares all bits, and takes a match only in the first table that shows it.

Defined results: a null or empty text has fingerprint zero; null ids come first in the order; rows with equal ids, null
ones too, are ordered by a hash of their text and by text, then in any order (they are equal); repeated rows are returned each; a bit that half of the weight voted
for is 0; other columns are ignored, whatever their names; an empty table gives an empty result. A text is split into its
terms whole, in one row's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common

BITS, RADIUS = 128, 3
#: Bytes of text in one stretch of the document order, most stretches (beyond, they grow), and ids that cut it coarsely.
STRETCH, STRETCHES, CUTS = 2 << 20, 1 << 16, 256
LANE = (1 << 32) - 1


def terms(text: Column) -> Column:
    """Words (runs between white space) and pairs of adjacent words; repeats count."""
    words = F.filter(F.split(text, "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    return F.concat(words, pairs)


def weight(term: Column) -> Column:
    """1 to 8: a quarter of the term's bytes, about."""
    return F.least(F.lit(8), F.lit(1) + F.shiftright(F.octet_length(term), 2)).cast("long")


def votes(df: DataFrame, keys: list[str], text: str, bits: int = BITS) -> DataFrame:
    """keys, fp: an array of longs, 64 bits each. Rows of one key must be in one partition, or a shuffle brings them there."""
    hashed = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("term"))
    hashed = hashed.select(*keys, F.when(F.col("term").isNull(), F.lit(0).cast("long")).otherwise(weight(F.col("term"))).alias("w"), *(F.xxhash64(F.col("term"), F.lit(k)).alias(f"h{k}") for k in range(bits // 64)))
    lanes = [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(1 | 1 << 32)) * F.col("w")).alias(f"v{k}_{i}") for k in range(bits // 64) for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("all"), *lanes)

    def bit(k: int, i: int) -> Column:
        lane = F.col(f"v{k}_{i % 32}")
        count = F.shiftrightunsigned(lane, 32) if i >= 32 else lane.bitwiseAND(F.lit(LANE))
        return F.when(count * 2 > F.col("all"), F.lit(1 << i if i < 63 else -1 << 63)).otherwise(F.lit(0)).cast("long")

    words = [sum_bits([bit(k, i) for i in range(64)]) for k in range(bits // 64)]
    return summed.select(*keys, F.array(*words).alias("fp"))


def sum_bits(parts: list[Column]) -> Column:
    """Their OR, as a balanced tree."""
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return parts[0]


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, bits // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    return F.lit(1.0) - distance(a, b, bits) / F.lit(float(bits))


def hexed(fp: Column, bits: int = BITS) -> Column:
    return F.concat(*(_common.hex64(F.get(fp, k)) for k in range(bits // 64)))


def with_next(docs: DataFrame, chars: int = STRETCH) -> DataFrame:
    """stretch, rank, doc_id, text, next_text, own: the documents in the order of their ids, each with the text after it.

    A stretch also holds, with own false, the row that begins the next one, so that no order over all rows is needed;
    the last stretch ends with the first row of all. Stretches are bounded in text and are dealt out by hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = rows.withColumn("stretch", _stretch(rows, chars))
    # one small row per stretch: its first id, and the stretch before it
    firsts = placed.groupBy("stretch").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first"))
    heads = [(r.stretch, r.first.doc_id, r.first.h) for r in firsts.orderBy("stretch").collect()]  # at most 3 * STRETCHES rows
    if not heads:
        return _ranked(placed.withColumns({"own": F.lit(True), "late": F.lit(0)}))
    before = [(i, h, heads[k - 1][0], int(k == 0), s) for k, (s, i, h) in enumerate(heads)]
    small = docs.sparkSession.createDataFrame(before, "first_id long, first_h long, to long, late int, at long")
    guests = placed.join(F.broadcast(small), (F.col("stretch") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    guests = guests.select("doc_id", "text", "h", F.col("to").alias("stretch"), F.lit(False).alias("own"), "late")
    everyone = placed.select("doc_id", "text", "h", "stretch", F.lit(True).alias("own"), F.lit(0).alias("late")).unionByName(guests)
    return _ranked(everyone)


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("stretch").orderBy("late", F.expr("NOT own AND late = 0"), F.col("doc_id").asc_nulls_first(), "h", "text")
    return rows.select("stretch", "own", "doc_id", "text", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("next_text"))


def _stretch(rows: DataFrame, chars: int) -> Column:
    """The stretch of each id: a tree of comparisons with at most CUTS quantiles, each part then cut evenly by value. Rows
    without an id are cut evenly by the hash of their text, below all others."""
    facts = rows.agg(F.sum(F.octet_length("text")).alias("total"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("unknown"), F.percentile_approx("doc_id", [k / CUTS for k in range(CUTS + 1)], 20 * CUTS).alias("cuts")).first()
    wanted = min(STRETCHES, max(1, -(-(facts.total or 0) // chars)))
    cuts = sorted({*(facts.cuts or [0])[:: max(1, CUTS // wanted)], *(facts.cuts or [0])[-1:]})
    steps = -(-wanted // max(1, len(cuts) - 1))

    def pick(low: int, high: int) -> Column:
        if high - low <= 1:
            start = cuts[low]
            wide = max(1, cuts[min(high, len(cuts) - 1)] - start + 1)
            step = F.floor((F.col("doc_id") - F.lit(start)).cast("double") / F.lit(float(wide)) * steps)
            return F.lit(low * steps) + F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1))
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < F.lit(cuts[middle]), pick(low, middle)).otherwise(pick(middle, high))

    below = min(STRETCHES, max(1, -(-(facts.unknown or 0) // chars)))
    part = F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * below)
    return F.when(F.col("doc_id").isNull(), F.least(part, F.lit(below - 1)) - below).otherwise(pick(0, max(1, len(cuts) - 1)).cast("long"))


def edited(text: Column, after: Column) -> Column:
    """The last half of the code points replaced by the first as many of another text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, bits: int = BITS, chars: int = STRETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for each row: one shuffle of the texts, by stretch."""
    rows = with_next(docs, chars).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    facts = F.when(F.col("which") == 0, F.struct("doc_id", "own", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")))
    both = rows.withColumn("which", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("facts", facts)
    both = both.select("stretch", "rank", "which", "facts", F.when(F.col("which") == 0, F.col("text")).otherwise(F.col("edited")).alias("body"))
    hashed = both.select("stretch", "rank", "which", "facts.*", "body")
    keys = ["stretch", "rank", "which", "doc_id", "own", "n_chars", "edited_sha256"]
    voted = votes(hashed, keys, "body", bits)
    paired = W.partitionBy("stretch", "rank").orderBy("which")
    along = W.partitionBy("stretch").orderBy("rank", "which")
    out = voted.withColumn("edited_fp", F.lead("fp").over(paired)).withColumn("next_fp", F.lead("fp", 2).over(along))
    return out.where("which = 0 AND own").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, bits: int = BITS, id_col: str = "id") -> DataFrame:
    """(query, match): every fps row whose fp is within radius of a query's fp. Both tables have id_col and fp."""
    blocks = radius + 1
    width = bits // blocks
    if width * blocks != bits or width > 64 or 64 % width:
        raise ValueError("blocks must divide the fingerprint's longs")

    def block(fp: Column, k: int) -> Column:
        at = k * width
        return F.shiftrightunsigned(F.get(fp, at // 64), at % 64).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def tables(df: DataFrame, name: str) -> DataFrame:
        fronts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), block(F.col("fp"), k).alias("front")) for k in range(blocks)))).alias("t")
        return df.select(F.col(id_col).alias(name), F.col("fp").alias(f"{name}_fp"), fronts).select(name, f"{name}_fp", "t.k", "t.front")

    left, right = tables(queries, "query"), tables(fps, "match")
    a, b = F.col("query_fp"), F.col("match_fp")
    first = F.lit(True)
    for k in range(blocks - 1):
        first = first & ~((F.col("l.k") > k) & (block(a, k) == block(b, k)))
    found = left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.front") == F.col("r.front")) & (distance(a, b, bits) <= radius) & first)
    return found.select("query", "match")


def op4_simhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edits; for ids divisible by 100 also the number of rows within the radius."""
    tables = _common.Tables(spark, "fingerprints")
    found = tables.keep(fingerprint_documents(_common.documents(spark, sf_dir)))
    distinct = found.groupBy("fp").agg(F.count("*").alias("n")).withColumn("id", F.col("fp"))
    asked = found.where("doc_id % 100 = 0").select("fp").distinct().withColumn("id", F.col("fp"))
    sizes = distinct.select("fp", "n").withColumnRenamed("fp", "match")
    near = within_radius(distinct, asked).join(sizes, "match").groupBy("query").agg(F.sum("n").alias("n_within"))
    near = near.select(F.col("query").alias("fp"), "n_within")
    out = found.join(near, "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(F.col("doc_id") % 100 == 0, F.col("n_within")).alias("n_within"))

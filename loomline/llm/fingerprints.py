"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector: ``2 * 60`` lanes of one bit each (the bits of two 64-bit hashes) and two
wide checks of 59 bits. A fingerprint is the sum of its paragraphs' vectors, three lanes of 20 bits packed in a number,
each number modulo 2^60. So it doesn't depend on the order of paragraphs, equal texts have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector (``combine``), without the text.

The lanes also show likeness: with n paragraphs, 2 * lane - n is a random projection of the paragraph counts, and the
cosine of two such vectors estimates the cosine of the counts (its error is about 1 / sqrt(120)).

Paragraphs here are lines, cut further after a full stop, exclamation or question mark, so that texts of one
line compare too. Null and empty texts have no paragraph and the fingerprint of zeros; the likeness of equal
fingerprints is 1, and of none with some 0. Other columns are ignored by ``near_neighbours`` and kept by ``with_fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.columns import bound
from loomline.session import shuffle_width

LANES = 120
_PACKED = LANES // 3
_MODULUS = 1 << 60
_NUMBERS = _PACKED + 3  # lanes, two checks, number of paragraphs
_DIGITS = 15


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?]) "), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint as an array of numbers below 2^60."""
    unit = 1 | 1 << 20 | 1 << 40
    last = _MODULUS - 1

    def total(hashes: Column, term) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + term(h)).bitwiseAND(F.lit(last)))

    def of(hashes: Column) -> Column:
        def lanes(part: str) -> Column:
            shifted = lambda j: lambda h: F.call_function("shiftrightunsigned", h[part], j).bitwiseAND(F.lit(unit))
            return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: total(hashes, shifted(j)))

        check = lambda part: F.array(total(hashes, lambda h: h[part].bitwiseAND(F.lit(_MODULUS // 2 - 1))))
        return F.concat(lanes("a"), lanes("b"), check("c"), check("d"), F.array(F.size(hashes).cast("long")))

    hashed = F.transform(paragraphs(text), lambda p: F.struct(
        F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b"), F.xxhash64(F.lit(2), p).alias("c"), F.xxhash64(F.lit(3), p).alias("d")))
    return bound(hashed, of)


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both (``sign`` 1), or of the left without the right's (-1)."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + F.lit(sign) * b, F.lit(_MODULUS)))


def text_form(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.lower(F.lpad(F.hex(n), _DIGITS, "0"))), "")


def _signed(numbers: Column) -> Column:
    low = (1 << 20) - 1
    lane = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(low))
    lanes = F.flatten(F.transform(F.slice(numbers, 1, _PACKED), lambda x: F.array(lane(x, 0), lane(x, 20), lane(x, 40))))
    count = F.element_at(numbers, _NUMBERS)
    return F.transform(lanes, lambda c: (2 * c - count).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: estimated cosine of the two multisets of paragraphs; 1 for equal fingerprints."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        scale = F.sqrt(dot(a, a) * dot(b, b))
        return F.when(scale > 0, F.least(F.greatest(dot(a, b) / scale, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    return F.when(left == right, 1.0).otherwise(bound(F.struct(_signed(left).alias("a"), _signed(right).alias("b")), of))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    return docs.withColumn(name, text_form(vector(F.col(text_col).cast("string"))))


def near_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets_per_partition: int = 4) -> DataFrame:
    """Each text, its successor by id, and its edited form, with their fingerprints.

    Rows are dealt to runs of ids with nearly equally many rows, by quantiles of the ids. The first document of a run
    also goes to the run before it, as the successor of that run's last; so texts are shuffled once and no
    task holds more than one run. Null ids come first; rows of one id follow by text.
    """
    spark = docs.sparkSession
    smallest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(smallest)))
    runs = shuffle_width(spark) * buckets_per_partition
    found = rows.agg(F.percentile_approx("_key", [i / runs for i in range(1, runs)], max(10_000, 8 * runs)).alias("q"), F.min("_key").alias("least")).first()
    borders = sorted({b for b in found.q or [] if b > found.least})
    least = found.least if found.least is not None else 0

    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    limits = F.array(*[F.lit(b).cast("long") for b in borders]) if borders else F.array().cast("array<bigint>")
    run = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        (at + s <= len(borders)) & (F.get(limits, at + s - 1) <= F.col("_key")), at + s).otherwise(at)) if borders else F.lit(0)
    placed = rows.withColumn("_run", run)
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("after"), F.lit(True).alias("own"))
    border = F.struct((F.col("_run") - 1).alias("run"), F.lit(0).alias("after"), F.lit(False).alias("own"))
    round_ = F.struct(F.lit(len(borders)).alias("run"), F.lit(1).alias("after"), F.lit(False).alias("own"))
    guests = F.array(own, F.when((F.col("_run") > 0) & (F.get(limits, F.col("_run") - 1) == F.col("_key")), border),
                     F.when(F.col("_key") == F.lit(least), round_))
    dealt = placed.select("doc_id", "_key", "text", F.explode(F.array_compact(guests)).alias("_at"))
    dealt = dealt.select("doc_id", "_key", "text", F.col("_at.run").alias("_run"), F.col("_at.after").alias("_after"), F.col("_at.own").alias("_own"))
    dealt = dealt.repartition(shuffle_width(spark), "_run").withColumn("_print", vector(F.col("text")))
    order = Window.partitionBy("_run").orderBy("_after", "_key", "text")
    paired = dealt.withColumn("_next", F.lead(F.struct("text", "_print")).over(order)).filter("_own")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half))
    # one projection for each step: a column used several times is computed once
    return (paired.select("doc_id", "text", n.cast("long").alias("n_chars"), "_print", F.col("_next._print").alias("_next_print"), edited.alias("edited"))
            .withColumn("_edited_print", vector(F.col("edited"))))


def digests(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_form(F.col("_print")).alias("fingerprint"),
        text_form(F.col("_edited_print")).alias("edited_fingerprint"), likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_next_print")).alias("near_next"))

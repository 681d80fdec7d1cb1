"""Document fingerprints by winnowing, in DataFrame operations only (operator 5).

Words are hashed, k of them in a row give a rolling polynomial hash, and the smallest hash of every window of w hashes is
kept with its position, the rightmost of equal ones. Any run of k + w - 1 words that two texts share leaves a shared
hash in both. A word beyond LONG code points counts as its code points, one by one, so a text without blanks is no single word.
Words are too sparse for short texts, so by length in code points these have further hashes, of runs of code points (SHORT): an edited
text, which is never longer than its own, has at least the same kinds. A text of no words has an empty fingerprint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import parallelism

PRIME, BASE = 2147483629, 1000003
POSITIONS = 2**31
LONG = 24
#: Below so many code points: runs of so many code points, the smallest of so many of them.
SHORT = [(400, 5, 4), (24, 2, 1)]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def winnow(text: Column, k: int = 3, w: int = 6) -> Column:
    """array<long> of hash * 2^31 + (2^31 - 1 - position), by position; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda x: x != "")
    parts = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > LONG, F.split(x, "")).otherwise(F.array(x))))
    words = F.when(text.rlike(f"[^ \t-\r]{{{LONG + 1}}}"), F.filter(parts, lambda x: x != "")).otherwise(words)
    hashes = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))

    def gram(h: Column, i: Column) -> Column:
        acc = h[i]
        for j in range(1, k):
            acc = (acc * BASE + h[i + j]) % PRIME
        return acc * POSITIONS + (POSITIONS - 1 - i)

    def short(h: Column) -> Column:
        return F.array(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: (acc * BASE + x + 1) % PRIME) * POSITIONS + (POSITIONS - 1))

    def grams(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: gram(h, i))
        return F.when(F.size(h) >= k, many).when(F.size(h) > 0, short(h)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(hashes, lambda h: let(grams(h), lambda g: F.when(F.size(g) > 0, minima(g, w)).otherwise(g)))


def minima(g: Column, w: int) -> Column:
    """The smallest of every w neighbours, each once, in order: of equal hashes the rightmost, as its number is smaller."""
    least = F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[g[i + j] for j in range(w)]) if w > 1 else g[i])
    return F.when(F.size(g) < w, F.array(F.array_min(g))).otherwise(F.array_distinct(least))


def short_winnow(text: Column) -> Column:
    """array<long> as of :func:`winnow`, of runs of code points: for texts of words below the lengths of SHORT, else empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.expr("cast(array() as array<bigint>)")

    def runs(least: int, k: int, w: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(text) - k, F.lit(0)))
        hashes = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(k), F.substring(text, i + 1, F.lit(k))), F.lit(PRIME)) * POSITIONS + (POSITIONS - 1 - i))
        return F.when(F.length(text) < least, let(hashes, lambda g: minima(g, w))).otherwise(none)

    return F.when((F.length(text) < SHORT[0][0]) & text.rlike("[^ \t-\r]"), F.concat(*[runs(*x) for x in SHORT])).otherwise(none)


def hashes_of(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 31)))


def as_text(selected: Column, mark: str = "@") -> Column:
    """``hash@position`` of each selected hash, in hexadecimal and decimal."""
    return F.concat_ws(" ", F.transform(selected, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(mark), (POSITIONS - 1 - F.pmod(x, F.lit(POSITIONS))).cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def in_ranges(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """(doc_id, text, tie, part, guest, slot): rows dealt to ranges in descending order of (doc_id, tie), tie a hash of the text.

    Ranges of ids, from quantiles of all ids, are the unit; an id that fills several ranges (or rows without an id) is cut further by
    tie. The first row of each range is a guest of the range before it, so that there every row has its next one: no window holds all
    rows and texts are shuffled once. Bounds: a few for each partition.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    n = per_partition * parallelism(spark)
    shares = "array(" + ", ".join(f"{k / n:.9f}D" for k in range(1, n)) + ")"
    cuts, absent, rows = own.agg(F.expr(f"percentile_approx(doc_id, {shares}, 100000)"), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    many = Counter(cuts or [])
    many[None] = round(n * absent / max(rows, 1))
    least, width = -(2**63), 2**64
    bounds = [(c, least + width * j // (k + 1)) for c, k in many.items() for j in range(0 if c is not None else 1, k + 1)]
    struct = lambda c, t: F.struct(F.lit(c).cast("long").alias("doc_id"), F.lit(t).cast("long").alias("tie"))
    key = F.struct("doc_id", "tie")
    listed = F.array(*[struct(*b) for b in sorted(bounds, key=lambda b: (b[0] is not None, b))]) if bounds else F.expr("cast(array() as array<struct<doc_id: bigint, tie: bigint>>)")
    own = own.withColumn("part", F.size(F.filter(listed, lambda c: c <= key)))
    heads = sorted((r[0], r[1]["doc_id"], r[1]["tie"]) for r in own.groupBy("part").agg(F.max(key)).collect())  # a row for each range
    if not heads:
        return own.withColumn("guest", F.lit(False)).withColumn("slot", F.lit(0))
    after = {p: heads[k - 1][0] for k, (p, *_) in enumerate(heads)}  # descending order: the range below comes next
    host = {nxt: p for p, nxt in after.items()}  # a range's head is a guest of the range above
    pairs = [x for p, *top in heads for x in (F.lit(p), F.struct(struct(*top).alias("top"), F.lit(host[p]).alias("host")))]
    home = F.element_at(F.create_map(*pairs), F.col("part"))
    stays = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))
    visits = F.array(F.struct(home["host"].alias("part"), F.lit(True).alias("guest")))
    dealt = own.withColumn("at", F.explode(F.when(key.eqNullSafe(home["top"]), F.concat(stays, visits)).otherwise(stays)))
    slots = parallelism(spark)
    dealt = dealt.select("doc_id", "text", "tie", "at.part", "at.guest").withColumn("slot", F.pmod("part", F.lit(slots)).cast("int"))
    return dealt.repartitionById(slots, "slot")  # as many ranges to each task


def fingerprints(docs: DataFrame, k: int = 3, w: int = 6) -> DataFrame:
    """Fingerprint of every text, of its edited text and their likenesses.

    The edited text: the last third of the code points replaced by the first as many (or all) of the next row's text,
    by descending doc_id. Null texts are empty; null ids come last; rows of one id are ordered by a hash of their texts, so many of them are
    spread over tasks unless they are repeated rows; a single row is its own next; an empty table gives an empty table; other
    columns are not read. Very long texts are taken whole. Each text and each edited text is winnowed once. Hashes of words are given as
    ``hash@word``, those of short texts' code points behind them as ``hash@c`` and the code point; likenesses are of both.
    """
    d = in_ranges(docs).withColumn("own", winnow(F.col("text"), k, w)).withColumn("own_c", short_winnow(F.col("text")))
    every = lambda name: hashes_of(F.concat(name, f"{name}_c"))
    d = d.withColumn("own_set", every("own"))
    order = Window.partitionBy("slot", "part").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"), "text")
    d = d.withColumn("next_text", F.lead("text").over(order)).withColumn("next_set", F.lead("own_set").over(order)).where(~F.col("guest"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "own_c", "own_set", "next_set")
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "own_c", "own_set", "next_set", winnow(F.col("edited"), k, w).alias("changed"), short_winnow(F.col("edited")).alias("changed_c"))
    shown = lambda name: F.concat_ws(" ", *[F.when(F.size(c) > 0, as_text(F.col(c), m)) for c, m in ((name, "@"), (f"{name}_c", "@c"))])
    near = [likeness(F.col("own_set"), every("changed")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next")]
    return d.select("doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"), *near)

"""Mixing sources to target weights by Poisson replication, in DataFrame operations only (operator 4).

Each source has a rate: its target share of all characters over its own share. A document's number of copies is a Poisson
draw with that mean, inverted from a uniform number hashed from seed and id, so it is the same in every run and on every
cluster. Rates above 32 are drawn as sums of independent smaller ones, which is exact. Copies get a uniform key hashed in the same
way; partitions are equal stretches of it and sorted by it, so all copies come out in the key's order: one global shuffle, and no
pass to find the stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import parallelism, written

PART = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temper: float = 0.5) -> DataFrame:
    """(source, rate) with the Poisson table of each source; without ``targets`` a source's weight is its size to the power ``temper``.

    Sources are summed before they are shuffled. A source of no characters has rate 1; one that ``targets`` leaves out, 0.
    """
    size = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if targets is None:
        weight = F.pow(F.col("size"), F.lit(temper))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("source")), F.lit(0.0))
    weighed = written(size.withColumn("w", weight), "sizes")  # a row for each source: texts are read once for all that follows
    total, total_w = (weighed.agg(F.sum(c)).scalar() for c in ("size", "w"))
    rate = F.when((F.col("size") > 0) & (total_w > 0), F.col("w") / total_w * total / F.col("size")).otherwise(F.lit(1.0))
    r = weighed.select("source", rate.alias("rate"))
    r = r.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("table"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["table"], F.array(acc["c"] + p)).alias("table"))

    return r.select("source", "rate", "parts", F.aggregate(steps, start, step, lambda acc: acc["table"]).alias("below"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, temper: float = 0.5, seed: str = "mix") -> DataFrame:
    """``docs`` with copy (from 1), rate and mix_key, each document as often as its draw says, in the order of mix_key.

    Documents drawn zero times are out: that is the sampling this operator is for. A null source is a source of its own; rows
    of one id draw alike, each for itself, and rows without an id draw by their text; null and empty texts are documents of no
    characters. A text of any length is one document. An empty table gives an empty table. All columns pass, whatever their
    names; docs may not hold copy, rate and mix_key itself (they are replaced).
    """
    docs = docs.drop("copy", "rate", "mix_key")
    # written, so that Spark knows its size when it plans: small tables of sources are broadcast and the texts stay in
    # place; large ones are joined by a shuffle, where Spark splits a hot source
    r = written(rates(docs, targets, temper), "rates").select(F.col("source").alias("of"), "rate", "parts", "below")
    d = docs.select(F.struct("*").alias("doc"))  # no name of docs can clash
    d = d.join(r, F.col("doc.source").eqNullSafe(F.col("of"))).where("rate > 0")
    name = F.coalesce(F.col("doc.doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("doc.text", F.lit("")))))

    def draw(u: Column) -> Column:
        return F.size(F.filter("below", lambda c: c <= u))

    many = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, k: acc + draw(uniform(F.lit(seed), name, k.cast("string"))))
    d = d.select("doc", "rate", F.explode(F.when(many > 0, F.sequence(F.lit(1), many))).alias("copy"))
    d = d.withColumn("mix_key", uniform(F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")))
    parts = parallelism(docs.sparkSession)
    out = d.repartitionById(parts, F.floor(F.col("mix_key") * parts).cast("int")).sortWithinPartitions("mix_key")
    return out.select("doc.*", "copy", "rate", "mix_key")


#: The same rows in DuckDB; the rate is compared to nine decimals.
SQL = """
WITH RECURSIVE size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, pow(size, 0.5) AS w FROM size),
rate AS (SELECT source, CASE WHEN size > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(size) FROM weighed) / size ELSE 1 END AS rate FROM weighed),
part AS (SELECT source, rate, greatest(1, ceil(rate / 32))::INT AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM rate),
pmf AS (
  SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS c, mean, ceil(mean + 12 * sqrt(mean) + 20) AS most FROM part
  UNION ALL SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean, most FROM pmf WHERE k < most),
below AS (SELECT source, list(c ORDER BY k) AS below FROM pmf GROUP BY source),
d AS (SELECT documents.*, part.rate, part.parts, below.below FROM documents JOIN part ON documents.source IS NOT DISTINCT FROM part.source JOIN below ON documents.source IS NOT DISTINCT FROM below.source),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(below, lambda c: c <= ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || i), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS many FROM d),
copies AS (SELECT *, unnest(range(1, many + 1))::INT AS copy FROM drawn WHERE many > 0)
SELECT {columns} FROM copies
"""

"""Mixing sources to target weights with DataFrame functions only.

Every document gets a hash-random key. Within its source the documents are
ordered by that key, a prefix sum of their sizes is taken in two levels (sums
of key ranges, then running sums inside a range), and the source is cut at its
exact budget. A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace

#: A word is a run of characters other than ASCII white space (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: Mean rows of a key range; ranges bound what one task sorts.
ROWS_PER_RANGE = 8_192


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Targets from ``(source, source_size)`` rows, one row a source.

    A source's share of the total is proportional to its weight; what would
    exceed ``max_epochs`` times its size goes to the others by weight, until
    none is above. The fixed point is found in closed form: sources in the
    order of cap over weight, of which a first part is capped. The window runs
    over one row per source, not over documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    all_of = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the level were this source and all after it the uncapped ones
    left = F.sum("source_size").over(all_of).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    free = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    ranked = ranked.withColumn("level", left / free).withColumn("ratio", F.col("cap") / F.col("weight"))
    # the first source whose ratio is not below its level fixes the level of all after it
    ranked = ranked.withColumn("fixed", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_of))
    target = F.least(F.col("cap"), F.coalesce(F.col("fixed.level"), F.col("level")) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_to_targets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decide how many words the mix takes of every document.

    Returns ``doc_id, size, source_size, target, taken`` and the columns named
    in ``keep``, a row for each input row. ``taken`` counts repeats: whole
    epochs, plus the documents whose key comes first, up to the source's budget
    (its target without the fraction); the document on the cut gives the words
    that are left. The key is an MD5 of seed, id and text, so reruns agree at
    any partitioning; rows of equal keys are equal and come in any order. A null or
    empty text has size 0 and gives 0; null sources form one source, last;
    repeated rows are rows of their own; an empty table gives an empty one.
    Input columns named like results are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    # the text is part of the key, so that rows without an id, or of one id, do not share a range
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    # exactly the part of `docs` that the decision needs, its texts counted once
    rows = space.settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("key"), *[F.col(c).alias(f"kept_{c}") for c in keep]), "sizes")
    ranges = 1 << max(0, (rows.count() // ROWS_PER_RANGE).bit_length())
    bits = ranges.bit_length() - 1
    part = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")
    # null sources join as a value of their own
    rows = rows.withColumn("part", part).withColumn("has", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    sums = rows.groupBy("has", "source", "part").agg(F.sum("size").alias("part_size"))
    named = F.when(F.col("has"), F.col("source"))
    targets = source_targets(sums.groupBy("has", "source").agg(F.sum("part_size").alias("source_size")).select(named.alias("source"), "source_size"), weights=weights, max_epochs=max_epochs)
    targets = targets.select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    before = W.partitionBy("has", "source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0).cast("long"))).join(targets, ["has", "source"])
    inside = W.partitionBy("has", "source", "part").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    end = F.col("part_start") + F.sum("size").over(inside)
    partly = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (end - F.col("size"))))
    placed = rows.join(sums, ["has", "source", "part"])
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + partly).alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep])


#: Rows with their decision that are broadcast to the texts at most (24 bytes each); above, a join is shuffled.
BROADCAST_IDS = 2_000_000


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it.

    A document of which only a part is taken gives its first words, with the
    white space between them and ``chars_col`` counted anew. Documents of which
    nothing is taken, those without words among them, are not in the mix. Rows
    that repeat an id, or have none, are rows of their own.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "apply-mix")
    keyed = space.settle(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    decided = mix_to_targets(keyed, id_col=id_col, text_col=text_col, source_col=source_col, keep=("__row",))
    taken = space.settle(decided.filter("taken > 0").select("__row", F.col("taken").alias("__taken")), "taken")
    few = taken.count() <= BROADCAST_IDS
    rows = keyed.join(F.broadcast(taken) if few else taken, "__row").withColumn("__size", word_count(text_col)).filter("__size > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__taken") / F.col("__size")).cast("long"))))
    part = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))  # words with the white space before them
    text = F.when(part >= F.col("__size"), F.col(text_col)).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.least(part, F.col("__size")).cast("int")), ""))
    rows = rows.withColumn(text_col, text)
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return rows.select(*[f"`{c}`" for c in docs.columns])


#: DuckDB SQL for the same rows, over the registered view ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT) AS weight,
         3.0::DOUBLE * source_size AS cap
  FROM per_source),
levels AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER upto, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS level
  FROM weighted
  WINDOW upto AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level LIMIT 1), level) * weight) AS target
  FROM levels),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size, s.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS until
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM running)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - (until - size))))::BIGINT AS taken
FROM budgets
"""

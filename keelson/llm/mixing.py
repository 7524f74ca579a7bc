"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words.  The mix has as many words as the corpus.  Equal-token
blocks are the seats: first the sources get blocks by the highest quotients
``target / (2 k - 1)``, then the shards of each source get theirs from the
source's, so every quota is an integer.  A shard's documents stand in a
seeded order and are cut into blocks; it gives all its blocks
``quota div blocks`` times and, from a seeded start on, its next
``quota mod blocks`` blocks once more.  So documents are taken whole, but
for the two ends of that run, and none more than ``cap`` times.

A shard holds about 500 documents, or the square root of its source's
number if that is more, so a source with a third of all rows spreads over
many tasks; rows are dealt by id and text, so null or repeated ids spread, too.
Only tables of one row a source or a shard are ranked, the sources by range
partitions and their offsets, so that their number is not bounded either.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own, the last; repeated rows count and are taken
like others; null ids are allowed; an empty table gives an empty result;
``mix`` carries other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import fresh, scratch
from keelson.operators.windows import number_rows, running_totals

WORD = r"[^\x20\x09-\x0D]++"


def apportion(df: DataFrame, by: list[str], votes: str, seats: str, key: list[str]) -> DataFrame:
    """``df`` with ``won``: the seats of each row by Sainte-Lague's highest quotients within its group.

    ``seats`` is the same in all rows of a group; ties go to the smaller
    ``key``.  The common divisor lies within n / 2 seats of the even share,
    which settles all but about four quotients a row; those are ranked.
    Without ``by`` all rows are one group, which is ranked by ranges.
    """
    names = [*by, *[k for k in key if k not in by]]
    v, m = F.col(votes).cast("double"), F.col(seats).cast("double")

    def with_sums(rows: DataFrame, **sums: Column) -> DataFrame:
        """Each row with sums over its group."""
        per = rows.groupBy(*by).agg(*[x.alias(n) for n, x in sums.items()])
        if by:
            return rows.join(per, by)
        got = per.first()
        return rows.withColumns({n: F.lit(got[n]) for n in sums})

    t = with_sums(df, all_votes=F.sum(v), rivals=F.count("*") / 2)
    share = F.when(F.col("all_votes") > 0, v / F.col("all_votes")).otherwise(0.0)
    low = F.greatest(F.lit(0), F.floor(share * (m - F.col("rivals")) + 0.5) - 1).cast("long")
    high = F.when((v > 0) & (m > 0), F.floor(share * (m + F.col("rivals")) + 0.5).cast("long") + 1).otherwise(F.lit(0))
    t = t.withColumn("low", F.least(low, F.col(seats).cast("long"))).withColumn("high", F.greatest("low", high))
    t = with_sums(t, all_low=F.sum("low")).withColumn("open", F.col(seats) - F.col("all_low"))
    seat = F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high"))))
    bids = t.select(*names, "open", v.alias("v"), seat.alias("seat")).withColumn("bid", -F.col("v") / (2 * F.col("seat") - 1))
    if by:
        ranked = bids.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("bid", *key)))
    else:
        ranked = number_rows(bids, [], ["bid", *key], "rank").withColumn("rank", F.col("rank") + 1)
    won = ranked.where(F.col("rank") <= F.col("open")).groupBy(*names).agg(F.count("*").alias("more"))
    return (t.join(won, names, "left").withColumn("won", F.col("low") + F.coalesce("more", F.lit(0)))
            .select(*df.columns, "won"))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources(k, source_size, docs)`` with ``target``: words by weight, none above ``cap`` times its size.

    Weights repeat along the sources in order.  Filling by weight until each
    source is full or the words are spent gives the same as resharing the
    excess step by step.
    """
    full = F.lit(cap) * F.col("source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    t = (number_rows(sources, [], "k", "at").withColumn("weight", weight.cast("long")).withColumn("full", full)
         .withColumn("fill", F.col("full") / F.col("weight")))
    for value, before in (("full", "full_before"), ("weight", "weight_before")):
        t = running_totals(t, [], ["fill", "k"], value, before)
    t = scratch(t, "mix-order")
    sums = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weights_of_all = sums["size"] or 0, sums["weight"] or 0
    t = t.withColumn("rate", (F.lit(total) - F.col("full_before")) / (F.lit(weights_of_all) - F.col("weight_before")))
    # The first source, in the order of filling, that the words left do not fill.
    stop = t.where(F.col("rate") * F.col("weight") <= F.col("full")).orderBy("fill", "k").select("rate").first()
    rate = 0.0 if stop is None else stop["rate"]
    return t.select("k", "source_size", "docs", F.lit(total).cast("long").alias("total"),
                    F.least(F.col("full").cast("double"), F.lit(rate) * F.col("weight")).alias("target"))


def quotas(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int, seed: int) -> tuple[DataFrame, dict[str, Column]]:
    """Each row with its shard's quota; and columns for its place and what the mix takes of it.

    ``base``: times the whole row is taken; ``from1, to1, from2, to2``: the
    words ``[from, to)`` of it that are taken once more (two runs, as the
    shard's run may wrap around).
    """
    names = {c: fresh(docs, c) for c in ("k", "size", "shard", "end", "quota", "blocks", "tokens", "start", "source_size",
                                         "target")}
    n = {c: F.col(x) for c, x in names.items()}
    sized = (docs.withColumn(names["k"], F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")))
             .withColumn(names["size"], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")))
    count = (sized.select(n["k"].alias("k"), n["size"].alias("size"), "doc_id")
             .groupBy("k").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    source = scratch(targets(count, weights, cap).withColumn("shards", F.ceil(F.col("docs") / F.greatest(F.lit(500.0), F.sqrt("docs")))),
                     "mix-sources")

    plan = source.select(F.col("k").alias(names["k"]), "shards", F.col("source_size").alias(names["source_size"]),
                         F.col("target").alias(names["target"]))
    order_hash = F.xxhash64("doc_id", "text", F.lit(seed))
    dealt = (sized.join(plan, names["k"])
             .withColumn(names["shard"], F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.col("shards")))
             .drop("shards"))
    shards = (dealt.groupBy(n["k"].alias("k"), n["shard"].alias("shard")).agg(F.sum(n["size"]).alias("tokens"))
              .withColumn("blocks", F.ceil(F.col("tokens") / block)))
    shards = scratch(shards, "mix-shards")
    blocks = shards.groupBy("k").agg(F.sum("blocks").alias("blocks"))
    seats = source.join(blocks, "k").withColumn("seats", F.round(F.col("total") / block).cast("long"))
    seats = (apportion(seats, [], "target", "seats", ["k"])
             .select("k", F.least("won", cap * F.col("blocks")).alias("seats")))
    won = apportion(shards.join(seats, "k"), ["k"], "blocks", "seats", ["shard"])
    quota = scratch(won.select(F.col("k").alias(names["k"]), F.col("shard").alias(names["shard"]),
                               F.least("won", cap * F.col("blocks")).alias(names["quota"]),
                               F.col("blocks").alias(names["blocks"]), F.col("tokens").alias(names["tokens"]),
                               F.pmod(F.xxhash64("k", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1))).alias(names["start"])),
                    "mix-quotas")

    place = Window.partitionBy(names["k"], names["shard"]).orderBy(order_hash, "doc_id", n["size"])
    rows = (dealt.withColumn(names["end"], F.sum(n["size"]).over(place.rowsBetween(Window.unboundedPreceding, 0)))
            .join(quota, [names["k"], names["shard"]]))
    first, extra = n["end"] - n["size"], F.when(n["blocks"] > 0, n["quota"] % n["blocks"]).otherwise(0)

    def run(lo: Column, hi: Column) -> tuple[Column, Column]:
        a = F.greatest(lo * block - first, F.lit(0))
        return a, F.greatest(a, F.least(hi * block, n["end"]) - first)

    over = F.greatest(n["start"] + extra - n["blocks"], F.lit(0))  # what wraps around
    from1, to1 = run(n["start"], F.least(n["start"] + extra, n["blocks"]))
    from2, to2 = run(F.lit(0).cast("long"), over)
    return rows, n | {"base": F.when(n["blocks"] > 0, F.floor(n["quota"] / n["blocks"])).otherwise(0).cast("long"),
                      "from1": from1, "to1": to1, "from2": from2, "to2": to2}


def takes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 4, seed: int = 20240607) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``."""
    rows, n = quotas(docs.select("doc_id", "text", "source"), weights, cap, block, seed)
    taken = n["base"] * n["size"] + n["to1"] - n["from1"] + n["to2"] - n["from2"]
    return rows.select("doc_id", n["size"].alias("size"), n["source_size"].alias("source_size"),
                       n["target"].alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 4, seed: int = 20240607) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A row that is taken in part holds the taken words; ``n_chars`` follows
    the text where there is such a column.
    """
    rows, n = quotas(docs, weights, cap, block, seed)
    part = fresh(docs, "part")
    while part in rows.columns:
        part = f"_{part}"
    words = F.split("text", r"[\x20\x09-\x0D]++")
    words = F.when(words[0] == "", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    some = F.concat(F.slice(words, (n["from2"] + 1).cast("int"), (n["to2"] - n["from2"]).cast("int")),
                    F.slice(words, (n["from1"] + 1).cast("int"), (n["to1"] - n["from1"]).cast("int")))
    more = n["to1"] - n["from1"] + n["to2"] - n["from2"]
    times = n["base"] + F.when(more > 0, 1).otherwise(0)
    whole = (F.col(part) <= n["base"]) | (more == n["size"])
    text = F.when(whole, F.col("text")).otherwise(F.array_join(some, " "))
    out = (rows.where(n["size"] > 0).withColumn(part, F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
           .withColumn("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

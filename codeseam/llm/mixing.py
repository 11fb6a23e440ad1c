"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target in words (weights, capped at a multiple of what the
source holds, the excess reshared).  Its documents stand in a keyed random
order; the mix takes exactly the first ``target`` words of that order, starting
over once where the target exceeds the source.  So only the document at the
border is cut, and the order alone decides what is taken.  The tree decides where
it goes: what is taken falls into blocks of ``block`` words, by where a document
starts.  The exact numbers of blocks of all sources are split among the output
shards by a tree of multivariate hypergeometric draws (each node halves its
shards and draws how many blocks of each source go left), and each shard draws
its blocks, disjointly, from a keyed permutation of the source's blocks.  Within a
shard, documents are ordered by a keyed hash.

Scale: what is grouped is one (source, bucket) of about ``bucket_rows`` rows, so
a hot source is many groups; word positions come from sums in two levels.  Shards
hold about ``shard_words`` words, so their number grows with the input.  A row of the
tree holds at most ``FAN`` sources: beyond that, ranges of sources are split first,
then the sources of each range by what the range got, which is the same law.  The
tables of sources, buckets and shards are small aggregates that are joined, not
collected, and no row of the corpus carries one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.llm.shared import WORD, materialise, shuffle_width

WEIGHTS = (5, 2, 1)
FAN = 256  # sources, or ranges of them, in one row of the tree
CHUNK = 1024  # blocks of a source whose shards one row of the look-up tells


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def swap_or_not(x: Column, n: Column, seed: Column, rounds: int = 24) -> Column:
    """A keyed permutation of 0 .. n-1: in each round x and K - x mod n change
    places or not, by one keyed bit of the larger of both."""

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - acc, n)
        return F.when(F.xxhash64(seed, r, F.greatest(acc, other)) % 2 == 0, acc).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` are among the ``good``: inverse
    distribution function at u, by the recurrence of the probabilities from ten
    standard deviations below the mode to ten above (outside lies less than a
    double can tell)."""
    n, k, m = F.greatest(total, F.lit(1)).cast("double"), good.cast("double"), draws.cast("double")
    low = F.greatest(F.lit(0), draws - (total - good))
    high = F.least(draws, good)
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")
    spread = F.ceil(10 * F.sqrt(F.greatest(F.lit(0.0), m * k / n * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) + 10).cast("long")
    first, last = F.greatest(low, mode - spread), F.least(high, mode + spread)

    def after(p: Column, i: Column) -> Column:
        d = i.cast("double")
        return p * (k - d) * (m - d) / ((d + 1) * (n - k - m + d + 1))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["sum"] + acc["p"]).alias("sum"), after(acc["p"], i).alias("p"))

    mass = F.aggregate(F.sequence(first, last), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("p")), add, lambda a: a["sum"])

    def find(acc: Column, i: Column) -> Column:
        total_so_far = acc["sum"] + acc["p"]
        return F.struct(
            total_so_far.alias("sum"),
            after(acc["p"], i).alias("p"),
            acc["goal"].alias("goal"),
            F.when(total_so_far <= acc["goal"], i + 1).otherwise(acc["k"]).alias("k"),
        )

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("p"), (u * mass).alias("goal"), first.alias("k"))
    found = F.aggregate(F.sequence(first, last), start, find, lambda a: a["k"])
    return F.when((total <= 0) | (first >= last), F.least(F.greatest(first, F.lit(0)), high)).otherwise(F.least(found, last))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: (is_null, source, rows, words), one row a source.  Adds idx (order
    by code point, null last) and target.

    Capping and resharing until none is above ends at min(cap, level * weight)
    for one level; sorted by cap / weight, the capped sources come first, and the
    level after the first j of them is (goal - their caps) / (weights left).
    """
    by_name = Window.orderBy("is_null", "source")
    t = sizes.withColumn("idx", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", cap * F.col("words"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", (share * F.sum("words").over(everything) - capped) / (F.sum("weight").over(everything) - used))
    # the first source that its own level doesn't cap sets the level of all that follow
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "idx", "level"))).over(everything)["level"])
    return t.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).drop("cap", "level")


def block_count(target: Column, block: int) -> Column:
    return F.ceil(F.floor(target + 0.5) / block).cast("long")


def _split(nodes: DataFrame, shards: int, seed: int, level: int) -> DataFrame:
    """(p, quota, goal): the blocks of p's children, and how many of p each shard
    gets -> (p, shard, quota of each child).  The splitting tree: each round halves
    the ranges of shards."""
    nodes = nodes.select("p", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quota", "goal")
    for _ in range(max(1, math.ceil(math.log2(max(2, shards))))):
        width = F.col("hi") - F.col("lo")
        left_width = F.floor(width / 2).cast("int")
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q)
        to_left = F.aggregate(F.slice("goal", F.lit(1), left_width), F.lit(0).cast("long"), lambda a, q: a + q)

        def draw(acc: Column, q: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("p"), F.col("lo"), F.col("hi"), F.size(acc["left"]))
            x = hypergeometric(acc["total"], q, acc["draws"], u)
            return F.struct((acc["total"] - q).alias("total"), (acc["draws"] - x).alias("draws"), F.concat(acc["left"], F.array(x)).alias("left"))

        start = F.struct(total.alias("total"), to_left.alias("draws"), F.array().cast("array<bigint>").alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("quota", start, draw, lambda a: a["left"])).withColumn("mid", F.col("lo") + left_width)
        halves = F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quota"), F.slice("goal", F.lit(1), left_width).alias("goal")),
            F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("quota", "left", lambda q, x: q - x).alias("quota"), F.slice("goal", left_width + 1, width).alias("goal")),
        )
        nodes = nodes.select("p", F.explode(F.when(width > 1, halves).otherwise(F.array(F.struct("lo", "hi", "quota", "goal")))).alias("h")).select("p", "h.*")
    return nodes.select("p", F.col("lo").alias("shard"), "quota")


def shard_quotas(targets: DataFrame, shards: int, block: int, seed: int, fan: int = FAN) -> DataFrame:
    """idx, shard, quota, end: how many of the source's permuted blocks a shard
    gets, and where its range of them ends."""
    leaves = targets.select("idx", block_count(F.col("target"), block).alias("n"))
    count = leaves.count()
    levels = max(1, math.ceil(math.log(max(2, count), fan)))
    whole = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    share = lambda i: F.floor(F.col("n") * i / shards).cast("long")
    goals = whole.select(F.lit(0).cast("long").alias("p"), F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: share(i + 1) - share(i)).alias("goal"))
    for level in range(levels - 1, -1, -1):
        key = F.floor(F.col("idx") / fan**level).cast("long")
        children = leaves.groupBy(key.alias("c")).agg(F.sum("n").alias("n")).withColumn("p", F.floor(F.col("c") / fan).cast("long"))
        if level == levels - 1:
            children = children.withColumn("p", F.lit(0).cast("long"))
        lists = children.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cs"))  # at most ``fan``
        made = _split(lists.join(goals, "p").select("p", F.transform("cs", lambda x: x["n"]).alias("quota"), "goal"), shards, seed, level)
        each = made.select("p", "shard", F.posexplode("quota").alias("k", "quota")).join(lists.select("p", F.transform("cs", lambda x: x["c"]).alias("cs")), "p")
        each = each.select(F.get("cs", F.col("k")).alias("p"), "shard", "quota")
        if level:
            goals = materialise(each.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("goal")), "mix-ranges")
    so_far = Window.partitionBy("idx").orderBy("shard")
    return each.select(F.col("p").alias("idx"), "shard", "quota").filter("quota > 0").withColumn("end", F.sum("quota").over(so_far))


def shard_chunks(quotas: DataFrame) -> DataFrame:
    """idx, chunk, ends: of every CHUNK blocks of a source's permuted ones, where the
    shards' ranges that lie in it end, as an array of (end, shard)."""
    chunks = F.sequence(F.floor((F.col("end") - F.col("quota")) / CHUNK).cast("long"), F.floor((F.col("end") - 1) / CHUNK).cast("long"))
    return quotas.select("idx", F.explode(chunks).alias("chunk"), F.struct("end", "shard").alias("e")).groupBy("idx", "chunk").agg(F.array_sort(F.collect_list("e")).alias("ends"))


def _beyond(place: str):
    return lambda e: e["end"] > F.col(place)


def mix(docs: DataFrame, shards: int | None = None, block: int = 4096, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 17, bucket_rows: int = 1024, shard_words: int = 1 << 24, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) in one struct ``doc``, with mix_size (words),
    mix_source_size, mix_target and mix_draws: an array of (shard, ord, from,
    to), one for each time the document is taken, words from .. to - 1, ``ord``
    its place in the shard.  shards: by ``shard_words`` unless given.

    Null or empty texts have size 0 and are never drawn; null sources are one
    source, the last; equal rows are treated alike; an empty table gives an
    empty one.  Only the columns kept are shuffled, once.
    """
    t, s = F.col(f"`{text}`"), F.col(f"`{source}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
        word_count(t).alias("mix_size"),
        s.isNull().alias("is_null"),
        F.coalesce(s, F.lit("")).alias("source"),
        F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), t).alias("h"),
    )
    sizes = materialise(rows.select("is_null", "source", "h", "mix_size"), "mix-sizes")
    per_source = sizes.groupBy("is_null", "source").agg(F.count("*").alias("rows"), F.sum("mix_size").alias("words"))
    targets = materialise(source_targets(per_source, weights, share, cap), "mix-targets")
    shards = shards or max(1, math.ceil((targets.agg(F.sum("target")).first()[0] or 0) / shard_words))
    chunks = materialise(shard_chunks(shard_quotas(targets, shards, block, seed)), "mix-shards")

    key = ["is_null", "source"]
    buckets = F.ceil(F.col("rows") / bucket_rows).cast("long")
    bucket = F.pmod(F.col("h"), buckets).alias("bucket")
    known = targets.select(*key, "rows")
    per_bucket = sizes.join(known, key).groupBy(*key, bucket).agg(F.sum("mix_size").alias("in_bucket"))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = materialise(
        per_bucket.withColumn("base", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).join(targets, key).select(*key, "bucket", "base", "words", "target", "idx"),
        "mix-buckets",
    )

    placed = rows.join(known, key).select("doc", "mix_size", *key, "h", bucket).repartition(shuffle_width(docs), *key, "bucket")
    inside = Window.partitionBy(*key, "bucket").orderBy("h", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    placed = placed.join(per_bucket, [*key, "bucket"])

    goal = F.floor(F.col("target") + 0.5).cast("long")
    begin = F.col("base") + F.col("start")
    draws = []
    for again in range(math.ceil(cap)):
        at = begin + again * F.col("words")
        take, place, chunk, ends = (f"{n}{again}" for n in ("take", "place", "chunk", "ends"))
        placed = placed.withColumn(take, F.greatest(F.lit(0), F.least(F.col("mix_size"), goal - at)))
        spot = swap_or_not(F.floor(at / block).cast("long"), block_count(F.col("target"), block), F.xxhash64(F.lit(seed), "idx"))
        placed = placed.withColumn(place, F.when(F.col(take) > 0, spot)).withColumn(chunk, F.floor(F.col(place) / CHUNK).cast("long"))
        placed = placed.join(chunks.select("idx", F.col("chunk").alias(chunk), F.col("ends").alias(ends)), ["idx", chunk], "left")
        # the first range that ends beyond the place
        shard = F.get(F.filter(ends, _beyond(place)), F.lit(0))["shard"]
        placed = placed.withColumn(ends, shard)
        one = F.struct(
            F.col(ends).alias("shard"),
            F.xxhash64(F.lit(seed), F.lit(again), "h", "idx").alias("ord"),
            F.lit(0).cast("long").alias("from"),
            F.col(take).alias("to"),
        )
        draws.append(F.when(F.col(take) > 0, F.array(one)).otherwise(F.array().cast("array<struct<shard:int,ord:bigint,from:bigint,to:bigint>>")))
    return placed.select("doc", "mix_size", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"), F.concat(*draws).alias("mix_draws"))


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document: null and empty texts are of
    size 0 and taken 0 times, null sources are one source, null ids stay null."""
    mixed = mix(docs, keep=["doc_id"])
    return mixed.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["to"] - d["from"]).alias("taken"),
        F.transform("mix_draws", lambda d: d["shard"]).alias("shards"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is
    taken, by shard and in shuffled order within it.  The text of a document at
    a border is its first words, joined by spaces; n_chars, where there is such a
    column, is that of the text."""
    drawn = mix(docs, **options).select("doc", "mix_size", F.explode("mix_draws").alias("d"))
    words = F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), 1, F.col("d.to").cast("int"))
    text = F.when(F.col("d.to") == F.col("mix_size"), F.col("doc.text")).otherwise(F.array_join(words, " "))
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return drawn.repartition(shuffle_width(docs), "d.shard", F.pmod("d.ord", F.lit(64))).sortWithinPartitions("d.shard", "d.ord").select(*[c.alias(n) for n, c in out.items()])

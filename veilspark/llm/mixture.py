"""Operator 6, mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: sources in code-point order, null last, weigh 3, 1, 2, 3, ... and share `share` times all words; a target stops at
`most` times its source's words and what is above is shared again by weight among the others (water filling).

Apportionment: a source's target is spent in equal blocks of words. Seats, that is blocks, go to the highest quotients
target / (2 k - 1): first among sources, for the house that the sum of targets makes, then among the shards of a source for
the source's seats. A block is `block` words, or less, down to one, where the smallest target is below 128 such blocks, so
rounding to blocks moves no source by more than about one in a hundred. A shard is the part of a source with one value of a
seeded hash; a source has a shard for every `shard_rows` documents, or for the root of their number where that is more, so
hot sources are split and neither shards nor their list outgrow a task.

Selection: a shard's documents lie on a circle of words in seeded hash order, and blocks are laid from a seeded phase. Its
seats are a number of whole rounds and a run of blocks from the phase on. A document takes the words that its part of the
circle has in them, so no document exceeds `most` (2) times its size and a shard takes what its seats say, to the word.

Everything follows from ids, sizes and the seed: reruns agree. Results: null and empty texts have size 0 and take 0. A
source of size 0 has target 0. Repeated rows are separate documents. Rows without an id are ordered by their text. A table
without rows gives none. The list of sources (one aggregated row each) is ordered as a whole; all else is partitioned.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import free_name
from veilspark.llm.scratch import kept

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a plan (a source, a shard, numbers) that may be broadcast. Beyond this count both sides are shuffled.
BROADCAST_ROWS = 200_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sources(source, source_size) with weight and target."""
    w = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = (F.row_number().over(w) - 1) % len(weights)
    rows = sources.select("*", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int") + 1).cast("double").alias("weight"))
    # Those capped come first by cap / weight. With the first i capped, the level of the rest is what remains / their weight.
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    total = F.sum("source_size").over(everything) * F.lit(share)
    spent = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = rows.withColumn("level", (total - spent) / left)
    free = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), F.col("level")))).over(everything)
    final = free.getField("level")
    return level.withColumn("target", F.when(final.isNull(), cap).otherwise(F.least(cap, final * F.col("weight")))).drop("level")


def seats(claims: DataFrame, group: list[str], ids: list[str], votes: str, house: str) -> DataFrame:
    """Sainte-Lague: claims with column `seats`; in each group the column `house` tells how many there are; ties go by ids.

    Highest quotients, exactly. Only quotients near the cut are listed: a claim's seats differ from its rounded quota by less
    than half its share of the number of claims plus two, so the list is a few times as long as the claims.
    """
    w = Window.partitionBy(*group)
    v = F.col(votes)
    mean = F.avg(v).over(w)
    quota = F.when(F.sum(v).over(w) > 0, v * F.col(house) / F.sum(v).over(w)).otherwise(0.0)
    base = claims.withColumn("_quota", quota).withColumn("_reach", F.ceil(F.when(mean > 0, v / (2 * mean)).otherwise(0.0)) + 2)
    base = base.withColumn("_low", F.greatest(F.lit(0), F.floor("_quota") - F.col("_reach"))).withColumn("_key", F.monotonically_increasing_id())
    base = kept(base, "claims")
    some = base.filter(v > 0)
    spare = some.withColumn("_spare", F.col(house) - F.sum("_low").over(w))
    listed = spare.select(*group, *ids, "_key", "_spare", votes, F.explode(F.sequence(F.col("_low") + 1, F.floor("_quota") + F.col("_reach"))).alias("_k"))
    ranked = listed.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(v / (2 * F.col("_k") - 1)), *ids, "_k")))
    got = ranked.filter(F.col("_rank") <= F.col("_spare")).groupBy("_key").agg(F.count("*").alias("_more"))
    out = base.join(got, "_key", "left").withColumn("seats", F.when(v > 0, F.col("_low") + F.coalesce("_more", F.lit(0))).otherwise(0))
    return out.drop("_quota", "_reach", "_low", "_key", "_more")


def code_of(docs: DataFrame, seed: int) -> Column:
    """The place of a row in the seeded order: by its id, or without one by its text."""
    key = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"), F.lit(1)))
    return F.xxhash64(key, F.lit(seed))


class Plan:
    """What each source and shard takes."""

    def __init__(self, docs: DataFrame, seed: int, share: float, most: int, weights: tuple[int, ...], block: int, shard_rows: int):
        self.sized = kept(
            docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"), code_of(docs, seed).alias("code")), "sizes"
        )
        by_source = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        claims = targets(by_source, share, most, weights).select("*", F.lit(0).alias("all"))
        everything = Window.partitionBy("all")
        least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
        claims = claims.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 128))).cast("long"))
        claims = claims.withColumn("house", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
        # Neither a shard's rows nor a source's shards grow faster than the root of its rows.
        shards = F.ceil(F.col("rows") / F.greatest(F.lit(shard_rows), F.sqrt("rows"))).cast("long").alias("shards")
        self.sources = kept(seats(claims, ["all"], ["source"], "target", "house").select("source", "source_size", "target", "block", "seats", shards), "sources")
        same = self.sized["source"].eqNullSafe(self.sources["source"])
        rows = self.sized.join(self.sources, same).select("doc_id", self.sized["source"], "size", "source_size", "target", "block", F.col("seats").alias("house"), "code", "shards")
        self.rows = rows.withColumn("shard", F.pmod("code", "shards"))
        claims = self.rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("house").alias("house"), F.first("block").alias("block"))
        words = F.least(F.col("seats") * F.col("block"), F.col("shard_size") * most)
        size = F.greatest(F.lit(1), F.col("shard_size"))
        quotas = seats(claims, ["source"], ["shard"], "shard_size", "house").select(
            F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", F.floor(words / size).alias("whole"), (words % size).alias("run"),
            F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), size).alias("phase"),
        )
        self.quotas = kept(quotas, "quotas")

    def placed(self) -> DataFrame:
        """Each row with the words `taken` and whole `copies`."""
        w = Window.partitionBy("source", "shard").orderBy("code", "doc_id", "size")
        line = self.rows.withColumn("stop", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
        line = line.join(self.quotas, line["source"].eqNullSafe(self.quotas["_source"]) & (line["shard"] == self.quotas["_shard"])).drop("_source", "_shard")
        end = F.col("phase") + F.col("run")  # the run; what is beyond the circle's end lies at its begin
        over = end - F.col("shard_size")

        def common(a: Column, b: Column) -> Column:
            return F.greatest(F.lit(0), F.least(F.col("stop"), b) - F.greatest(F.col("start"), a))

        taken = F.col("whole") * F.col("size") + common(F.col("phase"), end) + common(F.lit(0), over)
        middle = F.floor((F.col("start") + F.col("stop")) / 2)
        late, early = (middle >= F.col("phase")) & (middle < end), middle < over
        copies = F.when(F.col("size") > 0, F.col("whole") + late.cast("int") + early.cast("int")).otherwise(0)
        return line.select(
            "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), "source", "shard", "code", "whole", late.alias("late"), early.alias("early")
        )


def mixed(
    docs: DataFrame, seed: int = 5, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), block: int = 64, shard_rows: int = 2048
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of docs(doc_id, text, source).

    copies: whole copies for a mix of whole documents, as often as the word at the document's middle is taken.
    """
    return Plan(docs, seed, share, most, weights, block, shard_rows).placed().drop("shard", "code", "whole", "late", "early")


def repeated(
    docs: DataFrame, seed: int = 5, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), block: int = 64, shard_rows: int = 2048
) -> DataFrame:
    """docs as a mix of whole documents: each row as often as its `copies` tell, 0 to 2 times, with all its columns.

    A shard's run is one or two ranges of the seeded order, so a row's copies follow from the row and a plan with a row for
    each shard; texts are not shuffled. Rows that repeat an id in a source lie together and are taken together.
    """
    plan = Plan(docs, seed, share, most, weights, block, shard_rows)
    late, early = (F.when(F.col(c) & (F.col("size") > 0), F.col("code")) for c in ("late", "early"))
    shards = plan.placed().groupBy("source", "shard").agg(F.first("whole").alias("whole"), *(f(x).alias(c) for c, f, x in (("l0", F.min, late), ("l1", F.max, late), ("e0", F.min, early), ("e1", F.max, early))))
    shards = shards.join(plan.sources.select(F.col("source").alias("_s"), "shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = kept(shards.filter("whole > 0 or l0 is not null or e0 is not null").withColumn("plan", F.struct("shards", "whole", "l0", "l1", "e0", "e1")).select("source", "shard", "plan"), "plan")
    names = {c: free_name(docs, c) for c in ("mix_source", "mix_code", "mix_shards", "mix_shard", "mix_plan", "mix_nth", "mix_key")}
    source, code, count, shard, told, nth, key = names.values()
    sources = plan.sources.select(F.col("source").alias(key), F.col("shards").alias(count))
    out = docs.withColumns({source: docs["source"].cast("string"), code: code_of(docs, seed)})
    # Up to a checked number of rows the plan is sent to the texts; beyond it both are shuffled.
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    out = out.join(small(sources), out[source].eqNullSafe(sources[key])).drop(key).withColumn(shard, F.pmod(F.col(code), F.col(count)))
    shards = shards.select(F.col("source").alias(key), F.col("shard").alias(nth), F.col("plan").alias(told))
    out = out.join(small(shards), out[source].eqNullSafe(shards[key]) & (out[shard] == shards[nth])).drop(key, nth)
    within = lambda a, b: F.coalesce(F.col(code).between(F.col(f"{told}.{a}"), F.col(f"{told}.{b}")), F.lit(False)).cast("int")
    copies = F.when(size_of(docs["text"]) > 0, F.col(f"{told}.whole") + within("l0", "l1") + within("e0", "e1")).otherwise(0)
    return out.withColumn(nth, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(*names.values())

"""Operator 4, exact dedup by deterministic block naming, in DataFrame operations only.

Texts are normalised and cut into blocks of fixed size. Distinct blocks are sorted into integer names. Then the names of
adjacent pairs of blocks are named in turn, again and again, until each text has a single name; two texts are equal if and
only if they have the same number of blocks and the same name. Names are ranks in a sorted list of distinct contents,
so no two contents share one: hashes only say where in the sorted list a content stands, and contents whose hash is not
unique are compared as they are.

A rank is taken within one of `SPANS` spans of the hash range, so naming is a sort in many tasks, and the span and the rank
together are one integer. Hot blocks are aggregated before the shuffle; names are written to the shared folder, and
joined back to their positions by joins that adaptive execution can split.

Results: null text counts as empty, so null and empty texts are equal. Of equal texts the row with the smallest doc_id
stays; null ids come last; of rows that repeat an id and its text, exactly one stays. A table without rows gives none.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import free_name
from veilspark.llm.scratch import dropped, kept

BLOCK, SPANS = 4096, 1024
#: Ids that may be broadcast.
BROADCAST_IDS = 1_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Only runs other than one space are rewritten."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters, one piece at least."""
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def named(contents: DataFrame, columns: list[str], key: Callable[..., Column]) -> DataFrame:
    """Names for the distinct rows of contents(columns): (h, columns or nulls where h alone is unique, name), written.

    Names depend on nothing but contents, so they are the same however often they are computed.
    """
    distinct = contents.groupBy(key(*columns).alias("h"), *columns).agg(F.lit(1).alias("one"))
    by_hash = kept(distinct.groupBy("h").agg(F.count("one").alias("n")), "hashes")
    span = F.pmod(F.shiftright("h", 40), F.lit(SPANS)).alias("span")
    empty = [F.lit(None).cast(contents.schema[c].dataType).alias(c) for c in columns]
    rows = by_hash.filter("n = 1").select("h", *empty)
    shared = by_hash.filter("n > 1").select("h")
    if not shared.isEmpty():
        rows = rows.unionByName(distinct.select("h", *columns).join(shared, "h"))
    w = Window.partitionBy("span").orderBy("h", *columns)
    out = kept(rows.select("*", span).select("h", *columns, (F.shiftleft(F.col("span").cast("long"), 43) + F.row_number().over(w)).alias("name")), "names")
    dropped(by_hash)
    return out


def with_names(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """rows(h, columns, ...) with the name of their content, without h and columns."""
    plain = names.filter(F.col(columns[0]).isNull()).select("h", "name")
    shared = names.filter(F.col(columns[0]).isNotNull())
    if shared.isEmpty():
        return rows.drop(*columns).join(plain, "h").drop("h")
    hashes = shared.select("h").distinct()
    return (
        rows.join(hashes, "h", "left_anti").drop(*columns).join(plain, "h").drop("h")
        .unionByName(rows.join(hashes, "h", "left_semi").join(shared, ["h", *columns]).drop("h", *columns))
    )


def identities(docs: DataFrame, key: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """uid, doc_id, text_sha256, parts, name of each row of docs(doc_id, text): rows with the same parts and name are equal.

    uid numbers the rows as they were read; it is written before it is used.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("t"))
    whole = own.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(blocks(F.col("t")), lambda b: key(b)).alias("hs"))
    whole = kept(whole.withColumn("uid", F.monotonically_increasing_id()), "texts")
    names = named(own.select(F.explode(blocks(F.col("t"))).alias("block")), ["block"], key)
    shared = names.filter(F.col("block").isNotNull())
    spots = whole.select("uid", F.size("hs").alias("parts"), F.posexplode("hs").alias("pos", "h"))
    if shared.isEmpty():
        level = spots.join(names.select("h", "name"), "h").select("uid", "parts", "pos", "name")
    else:  # blocks whose hash is not unique are compared by content, read again
        # uid is only known by its written rows, so contents are matched by all that identifies a row
        again = own.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.posexplode(blocks(F.col("t"))).alias("pos", "block")).withColumn("h", key("block"))
        clash = again.join(shared, ["h", "block"]).select("doc_id", "text_sha256", "pos", "h", F.col("name").alias("exact")).distinct()
        spots = whole.select("uid", "doc_id", "text_sha256", F.size("hs").alias("parts"), F.posexplode("hs").alias("pos", "h"))
        same = [spots["doc_id"].eqNullSafe(clash["doc_id"]), *(spots[c] == clash[c] for c in ("text_sha256", "pos", "h"))]
        spots = spots.join(clash, same, "left").select("uid", "parts", spots["pos"], spots["h"], "exact")
        level = spots.join(names.filter("block is null").select("h", "name"), "h", "left").select("uid", "parts", "pos", F.coalesce("exact", "name").alias("name"))
    level = kept(level, "level")
    dropped(names)
    done, size = None, int(level.agg(F.max("parts")).first()[0] or 0)
    while True:
        ready = level.filter("parts_left = 1" if "parts_left" in level.columns else "parts = 1").select("uid", "parts", "name")
        done = ready if done is None else done.unionByName(ready)
        if size <= 1:
            break
        left = F.col("parts_left") if "parts_left" in level.columns else F.col("parts")
        at = level.filter(left > 1).withColumn("left", left)
        pairs = at.groupBy("uid", "parts", "left", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.min(F.struct("pos", "name"))["name"].alias("a"), F.when(F.count("*") > 1, F.max(F.struct("pos", "name"))["name"]).otherwise(F.lit(-1)).alias("b")
        )
        pairs = kept(pairs, "pairs")
        names = named(pairs.select("a", "b"), ["a", "b"], key)
        rows = pairs.select("uid", "parts", F.ceil(F.col("left") / 2).alias("parts_left"), "pos", "a", "b", key("a", "b").alias("h"))
        level = kept(with_names(rows, names, ["a", "b"]), "level")
        dropped(names)
        dropped(pairs)
        size = -(-size // 2)
    return whole.select("uid", "doc_id", "text_sha256").join(done, "uid")


def groups(docs: DataFrame, key: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = kept(identities(docs, key), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid"))
    found = kept(rows.groupBy("parts", "name").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    out = rows.join(found, ["parts", "name"])
    return out.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of equal texts the one with the smallest doc_id.

    Rows that repeat an id and its text are alike for this purpose only if all columns are: the id decides, and of rows with
    that id and text one is taken.
    """
    found = kept(groups(docs), "found")
    names = {c: free_name(docs, c) for c in ("dedup_id", "dedup_sha")}
    key, sha = names.values()
    own = docs.withColumn(key, docs["doc_id"].cast("long"))
    ids = kept(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("many"), F.max("kept").alias("any")).filter("many > 1 or not any"), "leaving")
    # Ids of rows that leave, and ids in several rows, which are looked at by id and text. Up to a checked number of ids (of
    # eight bytes) they are sent to the texts; beyond it both are shuffled.
    side = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    out = own.join(side(ids.select("_id")), own[key].eqNullSafe(F.col("_id")), "left_anti")
    several = ids.filter("many > 1 and any").select("_id")
    if not several.isEmpty():
        hot = own.join(side(several), own[key].eqNullSafe(F.col("_id")), "left_semi").withColumn(sha, F.sha2(normalised(docs["text"]), 256))
        stay = found.filter("kept").join(several, found["doc_id"].eqNullSafe(F.col("_id"))).select("_id", F.col("text_sha256").alias("_sha"))
        hot = hot.join(stay, hot[key].eqNullSafe(stay["_id"]) & (hot[sha] == stay["_sha"]), "left_semi").dropDuplicates([key, sha])
        out = out.unionByName(hot.drop(sha))
    return out.drop(key)

"""Consistent synthetic values: one for each distinct (type, normalised value).

Distinct values of a type are numbered 0, 1, 2, ... by a two-level rank: values fall into BUCKETS groups by a digest,
are ranked within their group, and groups are offset by the sizes of those before. So numbering is a sort in many tasks,
and it depends on the set of values alone. A bijection of the number gives the value; no retry and no shared state.
"""

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import DEFAULT_SEED
from veilspark.functions.text import normalize

BUCKETS = 4096

FIRST = (
    "Aarav", "Aditi", "Ananya", "Arjun", "Bhavna", "Chetan", "Deepa", "Dhruv", "Esha", "Farhan", "Gauri", "Harish", "Isha", "Jatin", "Kavya", "Kiran",
    "Lata", "Manish", "Meera", "Nakul", "Neha", "Omkar", "Pooja", "Pranav", "Ravi", "Rekha", "Sahil", "Sneha", "Tara", "Uday", "Varun", "Yamini",
)
LAST = (
    "Achari", "Bakshi", "Banerji", "Bhalla", "Chawla", "Dalal", "Deshmukh", "Dutta", "Gokhale", "Hegde", "Iyengar", "Joshi", "Kamat", "Kapoor", "Lele",
    "Mahajan", "Menon", "Nayar", "Oberoi", "Pillai", "Rane", "Sathe", "Sethi", "Talwar", "Thakur", "Upadhyay", "Varma", "Wagle", "Yadav", "Zaveri",
)
STREETS = ("Lotus Lane", "Banyan Road", "River View Street", "Temple Road", "Orchard Lane", "Hill Cart Road", "Station Road", "Garden Street")
CITIES = ("Nandpur", "Sitanagar", "Ramgarh", "Devpur", "Shantipur", "Kalyanpur", "Suryanagar")
PLACES = ("Amberfield", "Copperhill", "Driftwood", "Eastgate", "Foxglove", "Harborview", "Larkspur", "Moonstone", "Redwater", "Tidewell")
TRADES = ("Textile", "Marine", "Optical", "Dairy", "Printing", "Ceramic", "Solar", "Timber")
HOUSES = ("Works", "Traders", "Mills", "Partners", "Associates", "Ventures", "Foundry", "Merchants")
SUFFIXES = ("Limited", "Private Limited", "LLP")
STATES = ("Kerala", "Odisha", "Punjab", "Assam", "Bihar", "Goa", "Haryana")
#: Further numbers that are tried for a value whose replacement is an original of the batch.
LANES = 8

#: Number of values of each type before a suffix or a wider range is needed.
CAPACITY = {
    "PERSON": len(FIRST) * len(LAST), "EMAIL_ADDRESS": len(FIRST) * len(LAST), "PHONE_NUMBER": 4 * 10**9, "ORGANIZATION": 10 * 8 * 8 * 3,
    "ADDRESS": 990 * len(STREETS) * len(CITIES) * len(STATES) * 900_000, "DATE_OF_BIRTH": 20_454, "SSN": 800 * 90 * 9000, "CREDIT_CARD": 10**9, "IP_ADDRESS": 254,
}


def factors(kind: str, seed: int = DEFAULT_SEED) -> tuple[int, int, int]:
    """(a, b, n): number i stands for place (a i + b) mod n, a bijection of the n places."""
    n = CAPACITY[kind]
    a = int(n * 0.618034) | 1
    while gcd(a, n) != 1 or (a * n) >= 2**62:
        a = a + 2 if a * n < 2**61 else a // 3 | 1
    return a, seed % n, n


def digest_bucket(kind: Column, value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", kind, value)), 1, 3), 16, 10).cast("int")


def numbered(values: DataFrame) -> DataFrame:
    """values(entity_type, norm_value), distinct, with `number` from 0 within each type."""
    rows = values.withColumn("bucket", digest_bucket(F.col("entity_type"), F.col("norm_value")))
    sizes = rows.groupBy("entity_type", "bucket").agg(F.count("*").alias("n"))  # at most BUCKETS rows a type
    before = Window.partitionBy("entity_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("entity_type", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("entity_type", "bucket").orderBy("norm_value")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["entity_type", "bucket"]).select("entity_type", "norm_value", (F.col("offset") + F.col("rank")).alias("number"))


def pick(words: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (i % len(words)).cast("int") + 1)


def luhn_digit(body: Column) -> Column:
    """The last digit that makes a 15-digit body a valid number of 16."""
    digit = lambda i: F.substring(body, i, 1).cast("int")
    total = F.lit(0)
    for i in range(1, 16):
        d = digit(i) * (2 if i % 2 else 1)
        total = total + F.when(d > 9, d - 9).otherwise(d)
    return F.pmod(-total, F.lit(10)).cast("string")


def synthetic(kind: str, number: Column, seed: int = DEFAULT_SEED) -> Column:
    """The synthetic value of a number. Beyond a type's capacity the round is put into the value, so values stay unique."""
    a, b, n = factors(kind, seed)
    place = F.pmod(F.pmod(number, F.lit(n)) * a + b, F.lit(n))
    again = F.floor(number / n).cast("long")
    first, last = pick(FIRST, F.floor(place / len(LAST))), pick(LAST, place)
    pad = lambda x, k: F.lpad(x.cast("long").cast("string"), k, "0")
    word = lambda sep: F.when(again > 0, F.concat(F.lit(sep), (again + 1).cast("string"))).otherwise("")
    if kind == "PERSON":
        return F.concat(first, F.lit(" "), last, word(" "))
    if kind == "EMAIL_ADDRESS":
        return F.concat(F.lower(first), F.lit("."), F.lower(last), word(""), F.lit("@example.com"))
    if kind == "PHONE_NUMBER":
        return F.concat(F.lit("+91 "), (F.floor(place / 10**9) + 6).cast("string"), pad(place % 10**9, 9), word(" x"))
    if kind == "ORGANIZATION":
        parts = (PLACES, F.floor(place / 192)), (TRADES, F.floor(place / 24)), (HOUSES, F.floor(place / 3))
        return F.concat(*(x for w, i in parts for x in (pick(w, i), F.lit(" "))), F.when(again > 0, F.concat((again + 1).cast("string"), F.lit(" "))).otherwise(""), pick(SUFFIXES, place))
    if kind == "ADDRESS":
        x = F.floor(place / 900_000)
        house, street, city, state = x % 990 + 10, pick(STREETS, F.floor(x / 990)), pick(CITIES, F.floor(x / (990 * 8))), pick(STATES, F.floor(x / (990 * 56)))
        return F.concat(house.cast("string"), F.lit(", "), street, F.lit(", "), city, F.lit(", "), state, F.lit(" – "), (place % 900_000 + 100_000).cast("string"), F.lit(", India"), word(" "))
    if kind == "DATE_OF_BIRTH":
        return F.concat(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), place.cast("int")), "dd MMMM yyyy"), word(" #"))
    if kind == "SSN":
        return F.concat((F.floor(place / 810_000) + 100).cast("string"), F.lit("-"), (F.floor(place / 9000) % 90 + 10).cast("string"), F.lit("-"), (place % 9000 + 1000).cast("string"), word("-"))
    if kind == "CREDIT_CARD":  # under a prefix reserved for tests
        body = F.concat(F.lit("411111"), pad(place, 9))
        full = F.concat(body, luhn_digit(body))
        return F.concat(*(x for i in (1, 5, 9) for x in (F.substring(full, i, 4), F.lit(" "))), F.substring(full, 13, 4), word(" "))
    if kind == "IP_ADDRESS":  # the documentation nets, then the block 240.0.0.0/4 that is reserved
        host, far = (place + 1).cast("string"), number - 3 * n
        part = lambda k: F.pmod(F.floor(far / 256**k), F.lit(256)).cast("string")
        wide = F.concat((F.lit(240) + F.pmod(F.floor(far / 256**3), F.lit(15))).cast("string"), F.lit("."), part(2), F.lit("."), part(1), F.lit("."), part(0))
        return (
            F.when(again == 0, F.concat(F.lit("192.0.2."), host)).when(again == 1, F.concat(F.lit("198.51.100."), host)).when(again == 2, F.concat(F.lit("203.0.113."), host)).otherwise(wide)
        )
    raise ValueError(f"Unsupported entity type: {kind}")


def replacement(kind: Column, number: Column, seed: int = DEFAULT_SEED) -> Column:
    out = F.lit(None).cast("string")
    for k in CAPACITY:
        out = F.when(kind == k, synthetic(k, number, seed)).otherwise(out)
    return out


def build(entities: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """entity_type, norm_value, replacement: unique replacements, none of which is an original value of the batch.

    Value i of a type's `total` has the numbers i, i + total, i + 2 total, ..., which no other value has; the first whose
    synthetic value is no original counts. If LANES of them are taken, a digest of the value is put behind the next one.
    """
    values = entities.select("entity_type", normalize(F.col("original_text")).alias("norm_value")).distinct()
    rows = numbered(values).withColumn("replacement", replacement(F.col("entity_type"), F.col("number"), seed))
    taken = values.select(F.col("norm_value").alias("own")).distinct()
    total = rows.groupBy("entity_type").agg(F.count("*").alias("total"))
    marked = rows.join(taken, normalize(rows["replacement"]) == taken["own"], "left")
    fine = marked.filter("own is null").select("entity_type", "norm_value", "replacement")
    nth = lambda k: replacement(F.col("entity_type"), F.col("number") + k * F.col("total"), seed)
    clash = marked.filter("own is not null").join(total, "entity_type").select("entity_type", "norm_value", "number", "total")
    lanes = clash.withColumn("lane", F.explode(F.sequence(F.lit(1), F.lit(LANES))))
    lanes = lanes.withColumn("moved", nth(F.col("lane")))
    seen = lanes.join(taken, normalize(F.col("moved")) == taken["own"], "left").groupBy("entity_type", "norm_value", "number", "total")
    free = seen.agg(F.min_by("moved", F.when(F.col("own").isNull(), F.col("lane"))).alias("moved"))
    last = F.concat(nth(F.lit(LANES + 1)), F.lit(" "), F.md5(F.concat_ws("|", F.lit(seed), "entity_type", "norm_value")))
    moved = free.select("entity_type", "norm_value", F.coalesce("moved", last).alias("replacement"))
    return fine.unionByName(moved)


def with_replacements(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """entities with their replacement. Spark broadcasts the mapping where its size allows, and joins by hash elsewhere."""
    rows = entities.withColumn("norm_value", normalize(F.col("original_text")))
    return rows.join(mapping, ["entity_type", "norm_value"])


def typed_export(mapping: DataFrame) -> DataFrame:
    """entity_type, values: the mapping of each type as one map, for small exports."""
    return mapping.groupBy("entity_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm_value", "replacement")))).alias("values"))


def raw_export(replaced: DataFrame) -> DataFrame:
    """raw_text, replacement: without types; of several the last occurrence's wins."""
    order = F.struct("doc_id", "block_index", "start")
    return replaced.groupBy(F.col("original_text").alias("raw_text")).agg(F.max_by("replacement", order).alias("replacement"))


def search(mapping: DataFrame, category: str | None, pattern: str) -> DataFrame:
    """Rows of a category (None: any) whose value or replacement matches a pattern, whatever the case."""
    hit = F.col("norm_value").rlike("(?iu)" + pattern) | F.col("replacement").rlike("(?iu)" + pattern)
    return mapping.filter(hit & (F.lit(True) if category is None else F.col("entity_type") == category))


def category_of(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw(raw_text, ...) with the category of its last occurrence, or PII where it has none."""
    known = entities.groupBy(F.col("original_text").alias("raw_text")).agg(F.max_by("entity_type", F.struct("doc_id", "block_index", "start")).alias("category"))
    return raw.join(known, "raw_text", "left").withColumn("category", F.coalesce("category", F.lit("PII")))

"""Queries of the engine over whole tables, by name, and the DuckDB SQL that gives the same rows.

Rules for values that the test tables lack (Indian phones, roles, companies, birth dates, PIN codes) run over text that
both sides derive from the customers' keys, so it grows with the data; every derived text has negative cases.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.model import ENTITIES, ENTITY_TYPES
from veilspark.operators import audit, detect, evaluate, mapping, redact
from veilspark.operators import blocks as B
from veilspark.operators.entities import exploded, with_entities
from veilspark.operators.resolve import finished, is_suspicious, is_valid, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CAST = {"int": "bigint"}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL; whole numbers are returned as bigint."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast(CAST[t]).alias(c) if t in CAST else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Blocks


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


BLOCKS_SQL = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS block_index, p, text FROM lines WHERE regexp_matches(text, '\S'))"""


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_index, 'paragraph' AS block_type, 'body.p_' || p AS location, text, NULL::VARCHAR AS style_name FROM blocks")
def block_scan(spark, sf_dir):
    return doc_blocks(spark, sf_dir)


@query(f"WITH {BLOCKS_SQL} SELECT 'paragraph' AS block_type, count(*) AS blocks FROM blocks HAVING count(*) > 0")
def block_histogram(spark, sf_dir):
    return B.histogram(doc_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(text, chr(10) ORDER BY block_index) AS text FROM blocks GROUP BY doc_id")
def full_text(spark, sf_dir):
    return B.full_text(doc_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_index, trim(text, ' ' || chr(9) || chr(13)) AS text FROM blocks")
def paragraph_scan(spark, sf_dir):
    return B.paragraphs(doc_blocks(spark, sf_dir))


# Scalar functions


@query(r"""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm, regexp_replace(text, '[^0-9]', '', 'g') AS digits,
    len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS words FROM conversations""")
def text_functions(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_or_empty(text).alias("norm"), X.digits(text).alias("digits"), F.size(X.tokens(text)).alias("words"))


@query("""SELECT c_custkey, upper(c_name) = c_name AND lower(c_name) <> c_name AS is_upper, c_name[1:5] AS shown,
    printf('%.4f', c_acctbal) AS amount, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed FROM customer""")
def value_tests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shown, amount = X.display(F.col("c_name"), 5).alias("shown"), F.format_string("%.4f", "c_acctbal").alias("amount")
    return c.select("c_custkey", X.is_upper(F.col("c_name")).alias("is_upper"), shown, amount, F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("listed"))


# Detectors over documents and pages. DuckDB has no lookaround: the characters around a match are matched too and put back.

S = "chr(57344)"


def spans_sql(source: str, keys: str, text: str, pattern: str, lead: bool = True, where: str = "true") -> str:
    """SQL of (keys, start, value) for matches of a pattern; with lead it has three groups (before)(value)(after)."""
    mark = rf"'\1' || {S} || '\2' || {S} || '\3'" if lead else rf"{S} || '\0' || {S}"
    return rf"""(SELECT {keys}, coalesce(list_sum(list_transform(list_slice(seg, 1, 2 * nth - 1), lambda x: length(x))), 0) AS start, seg[2 * nth] AS value
        FROM (SELECT {keys}, seg, unnest(range(1, len(seg) // 2 + 1)) AS nth
              FROM (SELECT {keys}, string_split(regexp_replace({text}, '{pattern}', {mark}, 'g'), {S}) AS seg FROM {source} WHERE {where})))"""


LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) + 1 - i, 1)::INT ELSE (substr(d, length(d) + 1 - i, 1)::INT * 2) // 10 + (substr(d, length(d) + 1 - i, 1)::INT * 2) % 10 END)) % 10 = 0"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TAIL = r"(?:[0-9]{3,4}[\s-]?[0-9]{3,4}|[0-9]{6,8})"
PHONE_SQL = rf"(^|[^0-9])((?:\+?\s*91[\s-]?)?[6-9][0-9]{{4}}[\s-]?[0-9]{{5}}|\+?\s*91[\s-]?[0-9]{{2,4}}[\s-]?{TAIL}|0[0-9]{{2,4}}[\s-]?{TAIL}|\(0[0-9]{{2,4}}\)[\s-]?{TAIL})([^0-9]|$)"


def detected_sql(kind: str, source: str, keys: str, text: str) -> str:
    """SQL of (keys, entity_type, original_text, start, end) for one pattern detector."""
    if kind == "EMAIL_ADDRESS":
        found = spans_sql(source, keys, text, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", lead=False, where=f"contains({text}, ''@'')".replace("''", "'"))
    elif kind == "IP_ADDRESS":
        found = f"(SELECT * FROM {spans_sql(source, keys, text, r'(^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})([^0-9.]|$)')} WHERE regexp_full_match(value, '{OCTET}(?:\\.{OCTET}){{3}}'))"
    elif kind == "CREDIT_CARD":
        # A mark after each non-digit stands before the next number, so the character after a number may be taken.
        marked = f"regexp_replace({text}, '([^0-9])', '\\1' || chr(57345), 'g')"
        spans = spans_sql(source, keys, marked, "(^|\ue001)((?:[0-9](?:[ -]\ue001)?){13,19})([^0-9]|$)").replace("lambda x: length(x)", "lambda x: length(replace(x, chr(57345), ''))")
        found = f"(SELECT {keys}, start, replace(value, chr(57345), '') AS value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM {spans}) WHERE {LUHN})"
    elif kind == "SSN":
        found = spans_sql(source, keys, text, "(^|[^0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})([^0-9]|$)")
    else:
        found = spans_sql(source, keys, text, PHONE_SQL)
    return f"SELECT {keys}, '{kind}' AS entity_type, value AS original_text, start::BIGINT AS start, (start + length(value))::BIGINT AS \"end\" FROM {found}"


def detected(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    rows = df.select(*keys, found.alias("found")).filter(F.size("found") > 0).select(*keys, F.explode("found").alias("e"))
    return rows.select(*keys, "e.entity_type", "e.original_text", "e.start", "e.end")


def on_documents(name: str, kind: str, detector: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        return detected(doc_blocks(spark, sf_dir), ["doc_id", "block_index"], detector(F.col("text")))

    run.__name__ = name
    query(f"WITH {BLOCKS_SQL} {detected_sql(kind, 'blocks', 'doc_id, block_index', 'text')}")(run)


on_documents("detect_email", "EMAIL_ADDRESS", detect.email)
on_documents("detect_ipv4", "IP_ADDRESS", detect.ip_address)
on_documents("detect_card_luhn", "CREDIT_CARD", detect.credit_card)


@query(" UNION ALL ".join(detected_sql(k, "pages", "page_id", "html") for k in ("EMAIL_ADDRESS", "IP_ADDRESS")))
def detect_in_pages(spark, sf_dir):
    return detected(table(spark, sf_dir, "pages"), ["page_id"], F.concat(detect.email(F.col("html")), detect.ip_address(F.col("html"))))


# Derived text: one line for each customer and rule

DERIVED = {
    "phone": "CASE WHEN k % 5 = 0 THEN 'Ref ' || (10000 + k % 89999) || '.' WHEN k % 5 = 1 THEN 'Call +91 ' || (60000 + k % 39999) || ' ' || (10000 + k % 89999)"
    " WHEN k % 5 = 2 THEN 'Tel: 0' || (20 + k % 70) || '-' || (1000 + k % 8999) || (1000 + k % 8999) WHEN k % 5 = 3 THEN '+91 ' || (20 + k % 70) || ' ' || (1000 + k % 8999) || ' ' || (1000 + k % 8999)"
    " ELSE 'Dial (0' || (20 + k % 70) || ') ' || (1000 + k % 8999) || ' ' || (1000 + k % 8999) || ' or ' || (6000000000 + k % 3999999) || '.' END",
    "ssn": "CASE WHEN k % 3 = 0 THEN 'No. ' || (100 + k % 899) || '-' || (1000 + k % 8999) ELSE 'SSN: ' || (100 + k % 899) || '-' || (10 + k % 89) || '-' || (1000 + k % 8999) || ' end' END",
    "person": "CASE k % 4 WHEN 0 THEN 'Contact Person: Asha' WHEN 1 THEN 'Compliance Officer : ' || f || ' ' || l || ', Pune' WHEN 2 THEN 'Note: ' || f || ' ' || l ELSE 'The directors named: ' || f || ' R. ' || l || ' and: Second Name' END",
    "company": "CASE k % 4 WHEN 0 THEN 'the company requires additional working capital.' WHEN 1 THEN 'by ' || f || ' ' || l || ' Works Private Limited, at' WHEN 2 THEN 'Pandit LLP' ELSE 'with ' || l || ' & Sons LLP today' END",
    "dob": "CASE k % 4 WHEN 0 THEN 'Date of Incorporation: 12 March ' || (1950 + k % 50) WHEN 1 THEN 'DOB: ' || (1 + k % 28) || '/' || (1 + k % 12) || '/' || (1950 + k % 50) || ' and on' WHEN 2 THEN 'date of birth is ' || (1 + k % 28) || ' June ' || (1950 + k % 50) ELSE 'Birth Date - January ' || (1 + k % 28) || ', ' || (1950 + k % 50) END",
    "address": "CASE k % 4 WHEN 0 THEN 'The plant is near the road in Pune.' WHEN 1 THEN 'It is at Plot No. ' || k || ', Baner Road, Pune ' || (100000 + k % 899999) || '. The rest' WHEN 2 THEN 'Goods go to Flat ' || k || ', Demo Nagar, Mumbai - ' || (100 + k % 899) || ' ' || (100 + k % 899) || ', Maharashtra, India; so' ELSE 'PIN ' || (100000 + k % 899999) || ' only' END",
    "labelled": "CASE k % 3 WHEN 0 THEN 'Registered Office: none given' WHEN 1 THEN 'Registered Office at ' || k || ' Alpha Tower, Pune ' || (100000 + k % 899999) || ', India. Next' ELSE 'Address: Beta House ' || k || ', Mumbai ' || (100 + k % 899) || ' ' || (100 + k % 899) || '; end' END",
}
FIRST, LAST = ("Asha", "Ravi", "Meera", "Kiran", "Neha"), ("Example", "Sample", "Demo", "Test", "Model", "Pattern", "Figure")


def names_sql(words: tuple[str, ...], shift: int) -> str:
    return "CASE (k + " + str(shift) + f") % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


DERIVED_SQL = f"derived AS (SELECT k, {{}} AS text FROM (SELECT k, {names_sql(FIRST, 0)} AS f, {names_sql(LAST, 1)} AS l FROM (SELECT c_custkey AS k FROM customer)))"


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr("k", names_sql(FIRST, 0) + " AS f", names_sql(LAST, 1) + " AS l")
    return names.selectExpr("k", DERIVED[name] + " AS text")


def on_derived(name: str, key: str, detector: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return detected(derived(spark, sf_dir, key), ["k"], detector(F.col("text")))

    run.__name__ = name
    query(f"WITH {DERIVED_SQL.format(DERIVED[key])} {sql}")(run)


def grouped_sql(kind: str, pattern: str, where: str = "true") -> str:
    found = spans_sql("derived", "k", "text", pattern, where=where)
    return f"SELECT k, '{kind}' AS entity_type, value AS original_text, start::BIGINT AS start, (start + length(value))::BIGINT AS \"end\" FROM {found}"


ANY_DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2} (?:March|June|January) [0-9]{4}|January [0-9]{1,2}, [0-9]{4}"
on_derived("detect_phone", "phone", detect.phone, detected_sql("PHONE_NUMBER", "derived", "k", "text"))
on_derived("detect_ssn", "ssn", detect.ssn, detected_sql("SSN", "derived", "k", "text"))
on_derived("person_context", "person", detect.person, grouped_sql("PERSON", r"^([^:]*: ?)([A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)+)(.*)$", "k % 4 <> 2"))
on_derived("company_suffix", "company", detect.company, grouped_sql("ORGANIZATION", r"(by |& )((?:[A-Z][a-z]+ )+(?:Private Limited|LLP))(.*)"))
on_derived("dob_label", "dob", detect.date_of_birth, grouped_sql("DATE_OF_BIRTH", rf"((?:DOB: |date of birth is |Birth Date - ))({ANY_DATE})(.*)"))
on_derived("address_pin", "address", detect.address, grouped_sql("ADDRESS", r"(is at Plot No\. |Flat [0-9]+, Demo )((?:[0-9]+, Baner Road|Nagar), [A-Za-z]+(?: -)? [0-9 ]{6,7}(?:, Maharashtra, India)?)(.*)"))
on_derived("address_label", "labelled", detect.address, grouped_sql("ADDRESS", r"((?:Office at |Address: ))([^.;]*[0-9]{3} ?[0-9]{3}[^.;]*)(.*)"))


# The ensemble over documents

ENSEMBLE_SQL = f"""{BLOCKS_SQL},
found AS ({" UNION ALL ".join(detected_sql(k, "blocks", "doc_id, block_index", "text") for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD", "SSN"))}),
entities AS (SELECT a.* FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.block_index = b.block_index AND a.start < b."end" AND b.start < a."end"
    AND b."end" - b.start > a."end" - a.start) AND (a.entity_type <> 'PHONE_NUMBER' OR length(regexp_replace(a.original_text, '[^0-9]', '', 'g')) >= 10)),
norms AS (SELECT *, lower(trim(regexp_replace(original_text, '\\s+', ' ', 'g'))) AS norm_value FROM entities)"""


def doc_entities(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """Entities of documents; again: they are read more than once, so they are kept (in memory or on disk) when first found."""
    found = exploded(with_entities(doc_blocks(spark, sf_dir)))
    return found.persist() if again else found


@query(f"WITH {ENSEMBLE_SQL} SELECT doc_id, block_index, entity_type, original_text, start, \"end\", 1.0::DOUBLE AS confidence, 'regex' AS source FROM entities")
def entities(spark, sf_dir):
    return doc_entities(spark, sf_dir)


@query(f"WITH {ENSEMBLE_SQL} SELECT entity_type, count(*) AS occurrences FROM entities GROUP BY 1")
def entity_counts(spark, sf_dir):
    return audit.counts(doc_entities(spark, sf_dir))


@query(f"WITH {ENSEMBLE_SQL} SELECT entity_type, count(*) AS occurrences FROM entities GROUP BY ROLLUP (entity_type)")
def entity_rollup(spark, sf_dir):
    return audit.totals(doc_entities(spark, sf_dir))


TYPES_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in ENTITY_TYPES) + ") types(entity_type)"
SUMMARY_SQL = f"SELECT entity_type, count(norm_value) AS occurrences, count(DISTINCT norm_value) AS unique_values FROM {TYPES_SQL} LEFT JOIN norms USING (entity_type) GROUP BY 1"


@query(f"WITH {ENSEMBLE_SQL} {SUMMARY_SQL}")
def summary_zero_filled(spark, sf_dir):
    return audit.summary(doc_entities(spark, sf_dir))


@query(
    f"""WITH {ENSEMBLE_SQL}, s AS ({SUMMARY_SQL}) SELECT '{{"input_file":"documents","text_blocks":' || (SELECT count(*) FROM blocks) || ',"total_detections":' || sum(occurrences) || ',"categories":{{'
    || string_agg('"' || entity_type || '":{{"occurrences":' || occurrences || ',"unique_values":' || unique_values || '}}', ',' ORDER BY list_position({list(ENTITY_TYPES)}, entity_type)) || '}}}}}}}}' AS summary FROM s""".replace("{{", "{").replace("}}", "}")
)
def summary_json(spark, sf_dir):
    return audit.summary_json(doc_entities(spark, sf_dir), doc_blocks(spark, sf_dir), "documents")


@query(f"""WITH {ENSEMBLE_SQL}, n AS (SELECT doc_id, count(*) AS total FROM blocks GROUP BY 1),
    e AS (SELECT doc_id, list({{'entity_type': entity_type, 'original_text': original_text, 'block_index': block_index, 'start': start, 'end': "end", 'confidence': 1.0::DOUBLE, 'source': 'regex'}} ORDER BY block_index, start) AS es FROM entities GROUP BY 1)
    SELECT doc_id, to_json({{'filename': doc_id::VARCHAR, 'total_blocks': total, 'total_detections': coalesce(len(es), 0), 'entities': coalesce(es, [])}})::VARCHAR AS result FROM n LEFT JOIN e USING (doc_id)""")
def result_json(spark, sf_dir):
    return audit.result_json(doc_entities(spark, sf_dir), doc_blocks(spark, sf_dir))


UNIQUES_SQL = "SELECT entity_type, norm_value AS normalized_value, count(*) AS occurrences FROM norms GROUP BY 1, 2"


@query(f"WITH {ENSEMBLE_SQL} {UNIQUES_SQL}")
def unique_entities(spark, sf_dir):
    return audit.uniques(doc_entities(spark, sf_dir))


@query(f"WITH {ENSEMBLE_SQL} SELECT * FROM ({UNIQUES_SQL}) ORDER BY list_position({list(ENTITY_TYPES)}, entity_type), occurrences DESC, normalized_value LIMIT 20")
def top_entities(spark, sf_dir):
    return audit.ordered_uniques(audit.uniques(doc_entities(spark, sf_dir))).limit(20)


@query(f"WITH {ENSEMBLE_SQL} SELECT doc_id, entity_type, original_text, block_index, start, \"end\", '1.0000' AS confidence, 'regex' AS source FROM entities")
def audit_trail(spark, sf_dir):
    return audit.audit_rows(doc_entities(spark, sf_dir))


@query(f"WITH {ENSEMBLE_SQL} SELECT doc_id, block_index, entity_type, original_text FROM entities WHERE entity_type IN ('EMAIL_ADDRESS', 'IP_ADDRESS')")
def category_filter(spark, sf_dir):
    return doc_entities(spark, sf_dir).filter(F.col("entity_type").isin("EMAIL_ADDRESS", "IP_ADDRESS")).select("doc_id", "block_index", "entity_type", "original_text")


# Resolution and validation over derived candidates

CANDIDATES = """SELECT k, i, CASE (k + i) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'LOCATION' ELSE 'PHONE_NUMBER' END AS entity_type,
    (k * 7 + i * 5) % 20 AS start, (k * 7 + i * 5) % 20 + 3 + (k + i * 3) % 9 AS stop, (80 + (k * 3 + i) % 4 * 5) / 100.0 AS confidence,
    CASE (k + i * i) % 4 WHEN 0 THEN 'regex' WHEN 1 THEN 'presidio' WHEN 2 THEN 'spacy' ELSE 'context' END AS source FROM spots"""


@query(
    f"""WITH RECURSIVE spots AS (SELECT c_custkey AS k, unnest(range(0, 4)) AS i FROM customer), cand AS ({CANDIDATES}),
    ord AS (SELECT *, CASE source WHEN 'regex' THEN 3 WHEN 'presidio' THEN 2 WHEN 'spacy' THEN 1 ELSE 0 END AS prio,
        row_number() OVER (PARTITION BY k ORDER BY start, start - stop, -confidence, -CASE source WHEN 'regex' THEN 3 WHEN 'presidio' THEN 2 WHEN 'spacy' THEN 1 ELSE 0 END, i) AS n FROM cand),
    lists AS (SELECT k, list({{'n': n, 'a': start, 'b': stop, 'c': confidence, 'p': prio}} ORDER BY n) AS es FROM ord GROUP BY k),
    fold AS (SELECT k, es, 0 AS pos, list_filter(es, lambda x: false) AS acc FROM lists
        UNION ALL SELECT k, es, pos + 1, CASE WHEN len(list_filter(acc, lambda y: y.a < es[pos + 1].b AND es[pos + 1].a < y.b AND NOT (es[pos + 1].c, es[pos + 1].b - es[pos + 1].a, es[pos + 1].p) > (y.c, y.b - y.a, y.p))) = 0
            THEN list_append(list_filter(acc, lambda y: NOT (y.a < es[pos + 1].b AND es[pos + 1].a < y.b)), es[pos + 1]) ELSE acc END FROM fold WHERE pos < len(es)),
    won AS (SELECT k, unnest(list_transform(acc, lambda x: x.n)) AS n FROM fold WHERE pos = len(es))
    SELECT ord.k, i, entity_type, start, stop FROM ord JOIN won ON ord.k = won.k AND ord.n = won.n"""
)
def resolve_overlaps(spark, sf_dir):
    spots = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "explode(sequence(0, 3)) AS i")
    cand = spots.selectExpr(*[x.strip() for x in _columns(CANDIDATES)])
    e = F.struct("entity_type", F.col("i").cast("string").alias("original_text"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"), F.col("confidence").cast("double").alias("confidence"), "source")
    lists = cand.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", e.alias("e")))).alias("es")).select("k", F.transform("es", lambda x: x["e"]).cast(ENTITIES).alias("es"))
    won = lists.select("k", F.explode(resolve(F.col("es"))).alias("e"))
    return won.select("k", F.col("e.original_text").cast("int").alias("i"), "e.entity_type", "e.start", F.col("e.end").alias("stop"))


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT list, cut at commas outside parentheses and strings."""
    body, out, depth, at, quoted = select.strip()[len("SELECT ") : select.strip().rindex(" FROM ")], [], 0, 0, False
    for j, c in enumerate(body):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and depth == 0 and not quoted:
            out.append(body[at:j])
            at = j + 1
    return [*out, body[at:]]


OVERLAPS_SQL = f"""WITH spots AS (SELECT c_custkey AS k, unnest(range(0, 4)) AS i FROM customer), cand AS ({CANDIDATES})
    SELECT a.k, a.i AS a, b.i AS b FROM cand a JOIN cand b ON a.k = b.k AND a.i < b.i AND a.start < b.stop AND b.start < a.stop"""


@query(OVERLAPS_SQL)
def overlapping_pairs(spark, sf_dir):
    cand = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "explode(sequence(0, 3)) AS i").selectExpr(*[x.strip() for x in _columns(CANDIDATES)])
    a, b = cand.alias("a"), cand.alias("b")
    return a.join(b, F.expr("a.k = b.k AND a.i < b.i AND a.start < b.stop AND b.start < a.stop")).selectExpr("a.k", "a.i AS a", "b.i AS b")


VALUES = {
    "PERSON": ("SCRR", "Asha Example Rao", "Asha", "Working Capital", "12 34"),
    "ORGANIZATION": ("Working Capital", "UPI", "Private Limited", "Sample Metal Works Limited", "Demo Works", "A.B. C.D."),
    "PHONE_NUMBER": ("12345", "98765 43210", "+91 98765 43210", "91 98765 4321"),
    "DATE_OF_BIRTH": ("June 30, 2025", "12/03/1985", "1985", "12 March 1985 x"),
}
SOURCES = ("regex", "presidio", "spacy", "context")
VALID_SQL = r"""CASE entity_type
    WHEN 'PERSON' THEN lower(value) NOT IN ('scrr', 'challan', 'unpai', 'senior management', 'working capital', 'operations', 'maximum', 'offer') AND regexp_matches(value, '[A-Za-z]')
        AND (source = 'context' OR len(list_filter(string_split(value, ' '), lambda w: regexp_matches(w, '[A-Za-z]'))) >= 2) AND NOT (length(value) <= 6 AND upper(value) = value AND lower(value) <> value)
    WHEN 'ORGANIZATION' THEN lower(value) NOT IN ('working capital', 'upi', 'senior management', 'red herring') AND len(regexp_extract_all(value, '[A-Za-z0-9]+')) >= 2
        AND NOT regexp_full_match(lower(value), '((private|limited|pvt|ltd|llp|inc|corp|corporation|co|the|and) ?)+')
        AND NOT (length(replace(replace(value, ' ', ''), '.', '')) <= 8 AND upper(value) = value AND lower(value) <> value) AND (source <> 'spacy' OR regexp_matches(lower(value), '\b(limited|ltd|llp|inc|corp)\b'))
    WHEN 'PHONE_NUMBER' THEN length(CASE WHEN d LIKE '91%' AND length(d) = 12 THEN substr(d, 3) ELSE d END) >= 10 AND NOT (source = 'presidio' AND confidence < 0.6)
    ELSE regexp_full_match(value, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2} (March|June) [0-9]{4}|(March|June) [0-9]{1,2},? [0-9]{4}') END"""
_ROWS = [(t, v) for t, vs in VALUES.items() for v in vs]


def _valid_rows_sql() -> str:
    kinds = " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_ROWS))
    values = " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_ROWS))
    sources = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES))
    n = len(_ROWS)
    return f"SELECT k, CASE k % {n} {kinds} END AS entity_type, CASE k % {n} {values} END AS value, CASE CAST(floor(k / {n}) AS BIGINT) % 4 {sources} END AS source, CASE WHEN k % 2 = 0 THEN 0.4 ELSE 0.9 END AS confidence"


@query(f"SELECT k, entity_type, value, source, {VALID_SQL} AS valid FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_valid_rows_sql()} FROM (SELECT c_custkey AS k FROM customer)))")
def validated_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr(*_columns(_valid_rows_sql() + " FROM x"))
    e = F.struct("entity_type", F.col("value").alias("original_text"), F.col("confidence").cast("double").alias("confidence"), "source")
    return rows.withColumn("e", e).select("k", "entity_type", "value", "source", is_valid(F.col("e")).alias("valid"))


SUSPECTS = {
    "ORGANIZATION": ("Pandit LLP", "Sample Metal Works Limited", "Anchor Investors", "Demo Works Group"),
    "ADDRESS": ("Registered Office at 1 Long Road, Pune 411 045", "1 Road, Pune", "12 Long Road, Demo Nagar, Pune 411 045 India"),
    "PERSON": ("Asha", "Asha Example"),
    "SSN": ("123-45-6789",),
}
_SUSPECT_ROWS = [(t, v) for t, vs in SUSPECTS.items() for v in vs]


def _suspect_rows_sql() -> str:
    n = len(_SUSPECT_ROWS)
    case = lambda j: " ".join(f"WHEN {i} THEN '{r[j]}'" for i, r in enumerate(_SUSPECT_ROWS))
    return f"SELECT k, CASE k % {n} {case(0)} END AS entity_type, CASE k % {n} {case(1)} END AS original_text"


@query(f"""SELECT * FROM ({_suspect_rows_sql()} FROM (SELECT c_custkey AS k FROM customer)) WHERE CASE entity_type
    WHEN 'ORGANIZATION' THEN lower(original_text) IN ('pandit llp', 'anchor investors') OR len(string_split(original_text, ' ')) <= 2
    WHEN 'ADDRESS' THEN contains(lower(original_text), 'registered office at') OR len(string_split(original_text, ' ')) < 6
    WHEN 'PERSON' THEN len(string_split(original_text, ' ')) = 1 ELSE false END""")
def suspicious(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr(*_columns(_suspect_rows_sql() + " FROM x"))
    return rows.filter(is_suspicious(F.col("entity_type"), F.col("original_text")))


# Mapping

_A, _B, _N = mapping.factors("PHONE_NUMBER")


@query(f"""WITH v AS (SELECT DISTINCT lower(c_name) AS norm_value FROM customer),
    n AS (SELECT norm_value, row_number() OVER (ORDER BY substr(md5('PHONE_NUMBER|' || norm_value), 1, 3), norm_value) - 1 AS number FROM v)
    SELECT norm_value, number, '+91 ' || (6 + ((number::HUGEINT * {_A} + {_B}) % {_N}) // 1000000000) || lpad((((number::HUGEINT * {_A} + {_B}) % {_N}) % 1000000000)::VARCHAR, 9, '0') AS replacement FROM n""")
def synthetic_mapping(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.lit("PHONE_NUMBER").alias("entity_type"), X.normalize(F.col("c_name")).alias("norm_value")).distinct()
    return mapping.numbered(values).select("norm_value", "number", mapping.synthetic("PHONE_NUMBER", F.col("number")).alias("replacement"))


def doc_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.build(doc_entities(spark, sf_dir, True))


@query(f"WITH {ENSEMBLE_SQL} SELECT entity_type, norm_value, 1 AS replacements, true AS fresh FROM norms GROUP BY 1, 2")
def mapping_consistency(spark, sf_dir):
    found = doc_entities(spark, sf_dir, True)
    replaced = mapping.with_replacements(found, mapping.build(found))
    originals = found.select(X.normalize(F.col("original_text")).alias("own")).distinct()
    seen = replaced.groupBy("entity_type", "norm_value").agg(F.count_distinct("replacement").alias("replacements"), F.max("replacement").alias("r"))
    return seen.join(originals, X.normalize(F.col("r")) == F.col("own"), "left").select("entity_type", "norm_value", "replacements", F.col("own").isNull().alias("fresh"))


@query(f"WITH {ENSEMBLE_SQL} SELECT entity_type, count(DISTINCT norm_value) AS originals, count(DISTINCT norm_value) AS replacements FROM norms GROUP BY 1")
def mapping_uniqueness(spark, sf_dir):
    return doc_mapping(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("originals"), F.count_distinct("replacement").alias("replacements"))


@query(f"WITH {ENSEMBLE_SQL} SELECT DISTINCT entity_type, norm_value FROM norms WHERE entity_type = 'IP_ADDRESS' AND (contains(norm_value, '1.2') OR contains(reverse(norm_value), '1.2'))")
def mapping_search(spark, sf_dir):
    """Values with `1.2` in them or in what stands for them: here the value written backwards, so that SQL knows it too."""
    return mapping.search(doc_mapping(spark, sf_dir).withColumn("replacement", F.reverse("norm_value")), "IP_ADDRESS", r"1\.2").select("entity_type", "norm_value")


@query(f"WITH {ENSEMBLE_SQL}, raw AS (SELECT original_text AS raw_text, max_by(entity_type, (doc_id, block_index, start)) AS category FROM entities GROUP BY 1) SELECT * FROM raw UNION ALL SELECT 'nowhere', 'PII'")
def mapping_category(spark, sf_dir):
    found = doc_entities(spark, sf_dir, True)
    raw = found.select(F.col("original_text").alias("raw_text")).distinct().unionByName(spark.createDataFrame([("nowhere",)], "raw_text string"))
    return mapping.category_of(raw, found)


# Redaction and leaks

MASKED_SQL = """seg AS (SELECT doc_id, block_index, list({'a': start, 'b': "end", 't': entity_type} ORDER BY start) AS es FROM entities GROUP BY 1, 2),
masked AS (SELECT b.doc_id, b.block_index, CASE WHEN es IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(es) + 1),
    lambda i: substr(text, (CASE WHEN i = 1 THEN 0 ELSE es[i - 1].b END)::BIGINT + 1, (es[i].a - CASE WHEN i = 1 THEN 0 ELSE es[i - 1].b END)::BIGINT) || '[' || es[i].t || ']'), '') || substr(text, es[len(es)].b + 1) END AS text
    FROM blocks b LEFT JOIN seg s ON b.doc_id = s.doc_id AND b.block_index = s.block_index)"""


@query(f"WITH {ENSEMBLE_SQL}, {MASKED_SQL} SELECT * FROM masked")
def redact_mask(spark, sf_dir):
    return redact.masked(with_entities(doc_blocks(spark, sf_dir))).select("doc_id", "block_index", "text")


@query(f"WITH {ENSEMBLE_SQL} SELECT doc_id, count(*) AS changed FROM (SELECT DISTINCT doc_id, block_index FROM entities) GROUP BY 1")
def redact_synthetic(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir)).withColumn("old", F.col("text"))
    return redact.redacted(tagged, doc_mapping(spark, sf_dir)).filter("text <> old").groupBy("doc_id").agg(F.count("*").alias("changed"))


def still_there_sql(texts: str) -> str:
    """Rows of norms whose value is in the text of texts(doc_id, block_index, text): phones by ten digits or more, others in normal form."""
    return rf"""(SELECT n.* FROM norms n JOIN (SELECT doc_id, lower(trim(regexp_replace(string_agg(text, chr(10) ORDER BY block_index), '\s+', ' ', 'g'))) AS t,
        regexp_replace(string_agg(text, chr(10) ORDER BY block_index), '[^0-9]', '', 'g') AS d FROM {texts} GROUP BY 1) w USING (doc_id)
        WHERE CASE WHEN n.entity_type = 'PHONE_NUMBER' THEN length(regexp_replace(n.original_text, '[^0-9]', '', 'g')) >= 10 AND contains(w.d, regexp_replace(n.original_text, '[^0-9]', '', 'g'))
            ELSE contains(w.t, n.norm_value) END)"""


@query(f"WITH {ENSEMBLE_SQL}, {MASKED_SQL} SELECT doc_id, block_index, entity_type, original_text FROM {still_there_sql('masked')}")
def leak_check(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    return redact.leaked(exploded(tagged), redact.masked(tagged)).select("doc_id", "block_index", "entity_type", "original_text")


@query(f"WITH {ENSEMBLE_SQL}, {MASKED_SQL}, planted AS (SELECT m.doc_id, m.block_index, CASE WHEN m.block_index % 3 = 1 THEN b.text ELSE m.text END AS text FROM masked m JOIN blocks b ON m.doc_id = b.doc_id AND m.block_index = b.block_index) SELECT doc_id, block_index, entity_type, original_text FROM {still_there_sql('planted')}")
def leak_check_planted(spark, sf_dir):
    """Every third block of the redacted text is the original one again: its values, wherever they were found, are leaks."""
    tagged = with_entities(doc_blocks(spark, sf_dir))
    back = redact.masked(tagged.withColumn("old", F.col("text"))).withColumn("text", F.when(F.col("block_index") % 3 == 1, F.col("old")).otherwise(F.col("text")))
    return redact.leaked(exploded(tagged), back).select("doc_id", "block_index", "entity_type", "original_text")


ORIGINAL_LEAKS_SQL = f"WITH {ENSEMBLE_SQL}, leaks AS (SELECT * FROM norms)"  # nothing is redacted: every value is still there


@query(f"{ORIGINAL_LEAKS_SQL} SELECT entity_type, count(*) AS occurrences FROM leaks GROUP BY 1")
def leaks_by_type(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    return audit.counts(redact.leaked(exploded(tagged), tagged))


@query(f"{ORIGINAL_LEAKS_SQL} SELECT 'paragraph' AS block_type, count(*) AS occurrences FROM leaks HAVING count(*) > 0")
def leaks_by_block_type(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    return audit.by_block_type(redact.leaked(exploded(tagged), tagged, guard=False), tagged)


@query(f"{ORIGINAL_LEAKS_SQL} SELECT doc_id, block_index, start, entity_type, original_text FROM leaks ORDER BY 1, 2, 3 LIMIT 20")
def first_leaks(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    return redact.leaked(exploded(tagged), tagged).select("doc_id", "block_index", "start", "entity_type", "original_text").orderBy("doc_id", "block_index", "start").limit(20)


@query(f"""WITH {ENSEMBLE_SQL}, {MASKED_SQL}, a AS (SELECT doc_id, count(*) AS blocks FROM blocks GROUP BY 1), b AS (SELECT doc_id, count(*) AS blocks FROM masked GROUP BY 1)
    SELECT coalesce(a.blocks, 0) AS before, coalesce(b.blocks, 0) AS after, count(*) AS documents FROM a FULL JOIN b USING (doc_id) GROUP BY 1, 2""")
def structure_check(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    a, b = (df.groupBy("doc_id").agg(F.count("*").alias(c)) for df, c in ((tagged, "before"), (redact.masked(tagged), "after")))
    both = a.join(b, "doc_id", "full").select(F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.groupBy("before", "after").agg(F.count("*").alias("documents"))


FIND_SQL = "CASE k % 5 WHEN 0 THEN 'for Asha  Example here' WHEN 1 THEN 'by ASHA EXAMPLE.' WHEN 2 THEN 'x Asha-Example y ' || k WHEN 3 THEN 'none' ELSE 'Asha Example' END"


@query(f"SELECT k, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 0 END::BIGINT AS start, CASE k % 5 WHEN 0 THEN 17 WHEN 1 THEN 15 WHEN 2 THEN 14 WHEN 4 THEN 12 END::BIGINT AS stop FROM (SELECT c_custkey AS k, {FIND_SQL.replace('k ', 'c_custkey ').replace('|| k', '|| c_custkey')} AS t FROM customer)")
def flexible_find(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr("k", FIND_SQL + " AS t")
    return rows.select("k", redact.find(F.col("t"), F.lit("Asha Example")).alias("f")).select("k", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("stop"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Mail X for x and [' || c_custkey || '].' ELSE 'Nothing here.' END AS text FROM customer")
def global_pass(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Mail ASHA example for Asha and ["), F.col("doc_id").cast("string"), F.lit("]."))).otherwise("Nothing here.")
    values = c.filter("doc_id % 3 = 0").select("doc_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("Asha", "x"), ("Asha Example", "X"), ("an", "zz"))))).alias("v"))
    return redact.global_pass(c.withColumn("text", text), values.select("doc_id", F.col("v.a").alias("original_text"), F.col("v.b").alias("replacement"))).select(F.col("doc_id").alias("k"), "text")


FORMS = "'See ASHA -  example, call 98765-43210 or (98) 7654.3210; a_b and a b [' || c_custkey || '].'"


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'See X, call P or (P; U and U [' || c_custkey || '].' ELSE 'Nothing here.' END AS text FROM customer")
def global_pass_forms(spark, sf_dir):
    """Values that come again with other separators between words or digits."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"CASE WHEN c_custkey % 3 = 0 THEN {FORMS} ELSE 'Nothing here.' END AS text")
    values = c.filter("doc_id % 3 = 0").select("doc_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("Asha Example", "X"), ("9876543210", "P"), ("a_b", "U"), ("--- ", "no"))))).alias("v"))
    return redact.global_pass(c, values.select("doc_id", F.col("v.a").alias("original_text"), F.col("v.b").alias("replacement"))).select(F.col("doc_id").alias("k"), "text")


# Evaluation: truth is every other distinct value, with values that are nowhere

TRUTH_SQL = f"""{ENSEMBLE_SQL}, preds AS (SELECT DISTINCT entity_type, norm_value AS value FROM norms),
    truth AS (SELECT entity_type, value FROM preds WHERE length(value) % 2 = 0 UNION SELECT 'EMAIL_ADDRESS', 'nobody@nowhere.example' UNION SELECT 'PERSON', 'asha example'),
    have AS (SELECT * FROM preds WHERE entity_type IN (SELECT entity_type FROM truth)),
    n AS (SELECT entity_type, count(*) FILTER (h.value IS NOT NULL AND t.value IS NOT NULL) AS tp, count(*) FILTER (t.value IS NULL) AS fp, count(*) FILTER (h.value IS NULL) AS fn
        FROM have h FULL JOIN truth t USING (entity_type, value) GROUP BY 1),
    pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN CASE WHEN fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fn) END AS r FROM n),
    f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


def predictions_and_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = doc_entities(spark, sf_dir, True)
    value = X.normalize(F.col("original_text"))
    truth = found.select("entity_type", value.alias("value")).filter(F.length("value") % 2 == 0).distinct()
    return found, truth.unionByName(spark.createDataFrame([("EMAIL_ADDRESS", "nobody@nowhere.example"), ("PERSON", "asha example")], "entity_type string, value string"))


@query(f"WITH {TRUTH_SQL} SELECT entity_type, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1_score FROM f")
def eval_metrics(spark, sf_dir):
    return evaluate.rounded(evaluate.metrics(*predictions_and_truth(spark, sf_dir)))


@query(f"""WITH {TRUTH_SQL}, t AS (SELECT sum(tp) / greatest(1, sum(tp) + sum(fp)) AS p, sum(tp) / greatest(1, sum(tp) + sum(fn)) AS r, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf FROM f)
    SELECT 'micro' AS average, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1_score FROM t UNION ALL SELECT 'macro', round(mp, 4), round(mr, 4), round(mf, 4) FROM t""")
def eval_micro_macro(spark, sf_dir):
    return evaluate.rounded(evaluate.averages(evaluate.metrics(*predictions_and_truth(spark, sf_dir))))


@query(f"""WITH {TRUTH_SQL} SELECT 'both' AS side, * FROM (SELECT * FROM have INTERSECT SELECT * FROM truth) UNION ALL SELECT 'predicted', * FROM (SELECT * FROM have EXCEPT SELECT * FROM truth)
    UNION ALL SELECT 'truth', * FROM (SELECT * FROM truth EXCEPT SELECT * FROM have)""")
def set_ops_truth(spark, sf_dir):
    return evaluate.differences(*predictions_and_truth(spark, sf_dir))


@query(f"""WITH {ENSEMBLE_SQL}, {MASKED_SQL} SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM entities) AS detections, (SELECT count(DISTINCT original_text) FROM entities) AS raw_values,
    (SELECT count(*) FROM {still_there_sql('masked')}) AS leaked""")
def key_figures(spark, sf_dir):
    tagged = with_entities(doc_blocks(spark, sf_dir))
    found = exploded(tagged)
    left = redact.leaked(found, redact.masked(tagged)).agg(F.count("*").alias("leaked"))
    a = tagged.agg(F.count("*").alias("blocks"))
    b = found.agg(F.count("*").alias("detections"), F.count_distinct("original_text").alias("raw_values"))
    return a.crossJoin(b).crossJoin(left)  # one row each


__all__ = ["QUERIES", "ORACLE_SQL", "finished"]

"""The named queries over the driver's tables and the SQL that gives the same rows.

No table has the shape of a raw profile, so records are derived from customers (as ``ats``) and suppliers (as
``recruiter_notes``): ``PROFILES`` is one text that both SQL dialects run. Records are linked by e-mail keys that three
customers and a supplier share, and by phone keys that bridge such groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions.formats import FORMATS
from weftline.operators import link as L
from weftline.operators import merge as M
from weftline.plans import pipeline, projection
from weftline.plans import validate as V
from weftline.sources import profiles as S

# --- derived records ------------------------------------------------------------------------------------------------

PROFILES = """
SELECT c_custkey AS ordinal, CAST(floor(c_custkey / 3) AS BIGINT) AS grp, concat('  ', c_name, ' ') AS full_name,
       ARR(concat(' E', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING), '@Mail.Example.com'), concat('c', CAST(c_custkey AS STRING), '@own.example.com'), '  ') AS emails,
       ARR(CASE WHEN c_custkey % 4 = 0 THEN concat('(', CAST(200 + c_custkey % 7 AS STRING), ') 555-', lpad(CAST(c_custkey % 60 AS STRING), 4, '0')) ELSE concat('12', CAST(c_custkey % 10 AS STRING)) END) AS phones,
       CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE concat(' City ', CAST(c_nationkey AS STRING)) END AS city,
       CASE WHEN c_custkey % 5 = 0 THEN r_name ELSE ' ' END AS region,
       CASE c_nationkey % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'deutschland' WHEN 2 THEN 'fr' WHEN 3 THEN ' U.K. ' WHEN 4 THEN 'Atlantis' ELSE NULL END AS country,
       CASE WHEN c_custkey % 2 = 0 THEN concat('https://link.example.com/', CAST(c_custkey AS STRING)) ELSE NULL END AS linkedin,
       ARR(concat('https://o.example.com/', CAST(c_nationkey AS STRING)), ' ', concat('https://o.example.com/', CAST(c_custkey % 4 AS STRING))) AS other,
       ARR(c_mktsegment, lower(c_mktsegment), concat(' skill ', CAST(c_custkey % 5 AS STRING)), '') AS skills,
       concat('Company ', CAST(c_nationkey % 4 AS STRING)) AS company, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat('Title ', CAST(c_custkey % 2 AS STRING)) END AS title,
       CASE c_custkey % 5 WHEN 0 THEN '2019/03/15' WHEN 1 THEN 'Oct 2020' WHEN 2 THEN 'soon' WHEN 3 THEN '2018' ELSE NULL END AS started,
       CASE c_custkey % 4 WHEN 0 THEN 'Present' WHEN 1 THEN '2022-13' WHEN 2 THEN 'September 2022' ELSE ' ' END AS ended,
       concat('University ', CAST(c_nationkey % 3 AS STRING)) AS school, concat('ats/', CAST(c_custkey AS STRING)) AS source_id, 'ats' AS source_type
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 100000000 + s_suppkey, s_suppkey, concat('Supplier ', CAST(s_suppkey AS STRING)),
       ARR(concat('e', CAST(s_suppkey AS STRING), '@mail.example.com'), concat('S', CAST(s_suppkey AS STRING), '@own.example.com'), CAST(NULL AS STRING)),
       ARR(concat('+1 555 01', lpad(CAST(s_suppkey % 100 AS STRING), 2, '0'), '0000'), CAST(NULL AS STRING)),
       concat('Town ', CAST(s_nationkey AS STRING)), NULL, CASE WHEN s_nationkey % 2 = 0 THEN 'japan' ELSE 'Nowhere land' END, concat(' https://link.example.com/s', CAST(s_suppkey AS STRING)),
       ARR(concat('https://o.example.com/', CAST(s_nationkey AS STRING))),
       ARR('Building', concat('Skill ', CAST(s_suppkey % 5 AS STRING)), 'Supply'), concat('company ', CAST(s_nationkey % 4 AS STRING)), concat('TITLE ', CAST(s_suppkey % 2 AS STRING)),
       'Sept. 2021', 'now', concat('UNIVERSITY ', CAST(s_nationkey % 3 AS STRING)), concat('notes/', CAST(s_suppkey AS STRING)), 'recruiter_notes'
FROM supplier
"""

DUCK_PROFILES = PROFILES.replace("ARR(", "list_value(").replace("AS STRING", "AS VARCHAR")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES.replace("ARR(", "array(").replace("FROM customer JOIN nation ON", "FROM {customer} customer JOIN {nation} nation ON").replace("JOIN region ON", "JOIN {region} region ON").replace("FROM supplier", "FROM {supplier} supplier"), **{t: read(spark, sf_dir, t) for t in ("customer", "nation", "region", "supplier")})


def derived_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw profiles of the derived records, with their group."""
    f = _flat(spark, sf_dir)
    null = F.lit(None).cast("string")
    return f.select(
        "ordinal",
        "grp",
        "full_name",
        "emails",
        "phones",
        F.struct("city", "region", "country").alias("location"),
        F.struct("linkedin", null.alias("github"), null.alias("portfolio"), "other").alias("links"),
        "skills",
        F.array(F.struct("company", "title", F.col("started").alias("start"), F.col("ended").alias("end"), null.alias("summary"))).alias("experience"),
        F.array(F.struct(F.col("school").alias("institution"), null.alias("degree"), null.alias("field_of_study"), F.col("started").alias("start"), null.alias("end"))).alias("education"),
        F.col("source_id").alias("_source_id"),
        F.col("source_type").alias("_source_type"),
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived_profiles(spark, sf_dir)
    return M.ranked(p, p.select("ordinal", F.col("grp").alias("cluster_id")))


_RANKED = f"""p AS ({DUCK_PROFILES}), r AS (
    SELECT *, grp AS cluster_id, CASE source_type WHEN 'ats' THEN 0.95::DOUBLE WHEN 'recruiter_notes' THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS weight,
           row_number() OVER (PARTITION BY grp ORDER BY CASE source_type WHEN 'ats' THEN 0.95::DOUBLE WHEN 'recruiter_notes' THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END DESC, ordinal) AS rank
    FROM p)"""


# --- the same rules in DuckDB ---------------------------------------------------------------------------------------


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_safe(x: str) -> str:
    return f"nullif({d_strip(x)}, '')"


def d_phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) < 7 OR length({d}) > 15 THEN NULL WHEN starts_with({d_strip(x)}, '+') THEN '+' || {d} WHEN length({d}) = 10 THEN '+1' || {d} WHEN length({d}) = 11 AND starts_with({d}, '1') THEN '+' || {d} END"


def d_month(x: str) -> str:
    cases = " ".join(f"WHEN '{f}' THEN {i}" for i, m in enumerate(N.MONTHS, 1) for f in dict.fromkeys((m, m[:3], *(["sept"] if i == 9 else []))))
    return f"CASE lower({x}) {cases} END"


def d_date(x: str) -> str:
    s = d_strip(x)
    numeric, first, last = r"'^([0-9]{4})[/\-.]([0-9]{1,2})([/\-.]([0-9]{1,2}))?$'", r"'^([A-Za-z]+)\.?\s+([0-9]{4})$'", r"'^([0-9]{4})\s+([A-Za-z]+)\.?$'"

    def written(year: str, month: str) -> str:
        return f"CASE WHEN TRY_CAST({year} AS INT) BETWEEN 1900 AND 2100 AND {month} BETWEEN 1 AND 12 THEN {year} || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') END"

    words = ", ".join(f"'{w}'" for w in N.PRESENT_WORDS)
    return f"""CASE WHEN lower({s}) IN ({words}) THEN 'Present'
        WHEN regexp_matches({s}, {numeric}) THEN {written(f"regexp_extract({s}, {numeric}, 1)", f"TRY_CAST(regexp_extract({s}, {numeric}, 2) AS INT)")}
        WHEN regexp_matches({s}, {first}) THEN {written(f"regexp_extract({s}, {first}, 2)", d_month(f"regexp_extract({s}, {first}, 1)"))}
        WHEN regexp_matches({s}, {last}) THEN {written(f"regexp_extract({s}, {last}, 1)", d_month(f"regexp_extract({s}, {last}, 2)"))}
        WHEN regexp_matches({s}, '^[0-9]{{4}}$') THEN {written(s, "1")} END"""


def d_country(x: str) -> str:
    names = " ".join("WHEN '{}' THEN '{}'".format(a.replace("'", "''"), c) for c, aliases in N.COUNTRY_ALIASES.items() for a in aliases)
    s = d_strip(x)
    return f"coalesce(CASE lower({s}) {names} END, CASE WHEN regexp_matches(upper({s}), '^[A-Z]{{2}}$') THEN upper({s}) END)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# --- coercion and sources -------------------------------------------------------------------------------------------


@query(f"SELECT ordinal, {d_safe('full_name')} AS full_name, {d_safe('region')} AS region, coalesce({d_safe('city')}, '') AS city FROM ({DUCK_PROFILES})")
def safe_str_trim(spark, sf_dir):
    return _flat(spark, sf_dir).select("ordinal", N.safe_str(F.col("full_name")).alias("full_name"), N.safe_str(F.col("region")).alias("region"), N.safe_str(F.col("city"), "").alias("city"))


@query(f"SELECT ordinal, {d_safe('''coalesce(nullif(region, ''), nullif(city, ''), nullif(country, ''))''')} AS picked FROM ({DUCK_PROFILES})")
def first_truthy_coalesce(spark, sf_dir):
    return _flat(spark, sf_dir).select("ordinal", N.safe_str(N.first_truthy(F.col("region"), F.col("city"), F.col("country"))).alias("picked"))


@query(f"SELECT ordinal, array_to_string(list_filter(list_transform(emails, lambda x: {d_strip('x')}), lambda x: x <> ''), '|') AS emails, array_to_string(list_filter(list_transform(skills, lambda x: {d_strip('x')}), lambda x: x <> ''), '|') AS skills FROM ({DUCK_PROFILES})")
def list_clean(spark, sf_dir):
    return _flat(spark, sf_dir).select("ordinal", *[F.array_join(N.clean_list(F.col(c)), "|").alias(c) for c in ("emails", "skills")])


_CONTACTS = r"""c AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS emails,
    list_distinct(regexp_extract_all(text, '\+?[0-9]{0,3} ?\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}')) AS phones FROM documents)"""


def _document_profiles(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_source_id"), F.col("text").alias("value"))
    return S.map_extracted(S.extract_contacts(docs)).withColumn("ordinal", F.col("_source_id").cast("long"))


@query(f"WITH {_CONTACTS} SELECT doc_id, array_to_string(list_sort(list_transform(emails, lambda x: {d_strip('x')})), '|') AS emails, array_to_string(list_sort(list_transform(phones, lambda x: {d_strip('x')})), '|') AS phones FROM c")
def extract_contacts(spark, sf_dir):
    p = _document_profiles(spark, sf_dir)
    return p.select(F.col("ordinal").alias("doc_id"), F.array_join(F.array_sort("emails"), "|").alias("emails"), F.array_join(F.array_sort("phones"), "|").alias("phones"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(coalesce(json_extract_string(props, '$.k'), '0') NOT IN ('0', '') AS BOOLEAN) AS truthy FROM events""")
def json_variant_scan(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), S._truthy(S._get(v, "k")).alias("truthy"))


_JSON_TEXT = "'{\"Full_Name\": \" ' || trim(full_name) || ' \", \"name\": \"x\", \"email_PRIMARY\": \"' || trim(emails[{i}]) || '\", \"location\": {\"cntry\": \"' || coalesce(country, '') || '\", \"country\": \"zz\"}, \"skills_list\": [\"' || skills[{i}] || '\", null, true], \"work_history\": [{\"employer\": \"' || company || '\", \"title\": \"' || title || '\", \"date_from\": null, \"start\": \"2020\"}, 5]}'"


@query(f"""SELECT source_id, {d_safe('full_name')} AS full_name, {d_safe('emails[1]')} AS email, coalesce({d_safe("nullif(country, '')")}, 'zz') AS country,
    array_to_string(list_filter([{d_strip('skills[1]')}, 'None', 'True'], lambda x: x <> ''), '|') AS skills, CAST({d_safe('title')} IS NOT NULL AS BIGINT) AS jobs, CASE WHEN {d_safe('title')} IS NOT NULL THEN '2020' END AS started
    FROM ({DUCK_PROFILES})""")
def json_documents(spark, sf_dir):
    f = _flat(spark, sf_dir)
    text = F.expr(_JSON_TEXT.replace("{i}", "0"))
    docs = f.select(F.col("source_id").alias("_source_id"), text.alias("value"))
    good, _ = S.map_json_documents(docs)
    return good.select(F.col("_source_id").alias("source_id"), "full_name", F.get("emails", F.lit(0)).alias("email"), "location.country", F.array_join("skills", "|").alias("skills"), F.size("experience").cast("long").alias("jobs"), F.get("experience", F.lit(0))["start"].alias("started"))


@query(f"""WITH p AS ({DUCK_PROFILES}) SELECT ordinal % 4 AS kind, CAST(count(*) AS BIGINT) AS n, CASE ordinal % 4 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'location is not an object' END AS reason
    FROM p WHERE ordinal % 4 < 3 GROUP BY ALL""")
def json_quarantine(spark, sf_dir):
    f = _flat(spark, sf_dir)
    kind = F.col("ordinal") % 4
    text = F.when(kind == 0, '{"name": ').when(kind == 1, "[1, 2]").when(kind == 2, '{"location": "here"}').otherwise('{"name": "x"}')
    _, bad = S.map_json_documents(f.select(F.concat_ws("/", kind.cast("string"), "ordinal").alias("_source_id"), text.alias("value")))
    return bad.groupBy(F.split("_source_id", "/")[0].cast("long").alias("kind"), "reason").agg(F.count("*").alias("n"))


@query(f"SELECT source_type, CAST(count(*) AS BIGINT) AS n, min(ordinal) AS first, max(ordinal) AS last, min(source_id) AS least FROM ({DUCK_PROFILES}) GROUP BY ALL")
def source_union(spark, sf_dir):
    p = derived_profiles(spark, sf_dir).drop("grp")
    parts = [p.filter(F.col("_source_type") == k) for k in reversed(S.KINDS)]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.groupBy(F.col("_source_type").alias("source_type")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min("_source_id").alias("least"))


# --- normalisers ----------------------------------------------------------------------------------------------------


@query(f"SELECT ordinal, phone, {d_phone('phone')} AS e164 FROM (SELECT ordinal, unnest(phones) AS phone FROM ({DUCK_PROFILES}))")
def phone_e164(spark, sf_dir):
    rows = _flat(spark, sf_dir).select("ordinal", F.explode("phones").alias("phone"))
    return rows.select("ordinal", "phone", N.try_phone(F.col("phone")).alias("e164"))


@query(f"""SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN phone IS NULL THEN 'blank' WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) < 7 THEN 'too few digits' END AS reason
    FROM (SELECT unnest(phones) AS phone FROM ({DUCK_PROFILES}))) GROUP BY ALL""")
def phone_reject_reasons(spark, sf_dir):
    rows = _flat(spark, sf_dir).select(F.explode("phones").alias("phone"))
    return rows.groupBy(N.phone_reject_reason(F.col("phone")).alias("reason")).agg(F.count("*").alias("n"))


_STYLES = ["%Y/%m/%d", "%b %Y", "%Y %B", "%Y.%m", "%Y", "%d/%Y"]
_SPARK_STYLES = ["yyyy/MM/dd", "MMM yyyy", "yyyy MMMM", "yyyy.MM", "yyyy", "dd/yyyy"]


@query("SELECT o_orderkey, raw, " + d_date("raw") + " AS month FROM (SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{s}')" for i, s in enumerate(_STYLES)) + " END AS raw FROM orders)")
def date_yyyy_mm(spark, sf_dir):
    day = F.col("o_orderdate")
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.date_format(day, s)) for i, s in enumerate(_SPARK_STYLES)])
    return read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("month", N.try_date(F.col("raw")))


@query("SELECT o_orderkey, " + d_date("raw") + " AS month FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' Present ' WHEN 1 THEN 'CURRENT' WHEN 2 THEN 'till date' WHEN 3 THEN 'To Date' WHEN 4 THEN 'ongoing' WHEN 5 THEN 'then' ELSE '' END AS raw FROM orders)")
def date_present_tokens(spark, sf_dir):
    words = [" Present ", "CURRENT", "till date", "To Date", "ongoing", "then", ""]
    return read(spark, sf_dir, "orders").select("o_orderkey", N.try_date(F.get(F.array(*map(F.lit, words)), (F.col("o_orderkey") % 7).cast("int"))).alias("month"))


@query(f"SELECT ordinal, country, {d_country('country')} AS code FROM ({DUCK_PROFILES})")
def country_iso2(spark, sf_dir):
    return _flat(spark, sf_dir).select("ordinal", "country", N.try_country(F.col("country")).alias("code"))


@query(f"SELECT ordinal, lower({d_strip('emails[1]')}) AS email_key FROM ({DUCK_PROFILES})")
def email_key(spark, sf_dir):
    return _flat(spark, sf_dir).select("ordinal", N.email_key(F.get("emails", F.lit(0))).alias("email_key"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0.95::DOUBLE WHEN 'click' THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM events")
def source_confidence(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", N.source_weight(F.col("event_type"), {"view": 0.95, "click": 0.75}).alias("weight"))


# --- linkage --------------------------------------------------------------------------------------------------------

_KEYS = f"""p AS ({DUCK_PROFILES}), k AS (
    SELECT DISTINCT ordinal, 'email' AS kind, lower({d_strip('e')}) AS key FROM (SELECT ordinal, unnest(emails) AS e FROM p) WHERE {d_strip('e')} <> ''
    UNION SELECT DISTINCT ordinal, 'phone', {d_phone('e')} FROM (SELECT ordinal, unnest(phones) AS e FROM p) WHERE {d_phone('e')} IS NOT NULL)"""
_COMPONENTS = _KEYS + """, e AS (SELECT DISTINCT a.ordinal AS a, b.first AS b FROM k a JOIN (SELECT kind, key, min(ordinal) AS first FROM k GROUP BY ALL) b USING (kind, key)),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT ordinal AS a, ordinal AS b FROM p UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
    comp AS (SELECT a AS ordinal, min(b) AS cluster_id FROM reach GROUP BY a)"""


@query(f"WITH {_KEYS} SELECT * FROM k")
def match_keys(spark, sf_dir):
    return L.match_keys(derived_profiles(spark, sf_dir))


@query(f"WITH {_KEYS} SELECT a.ordinal, min(b.first) AS first FROM k a JOIN (SELECT kind, key, min(ordinal) AS first FROM k GROUP BY ALL) b USING (kind, key) GROUP BY ALL")
def key_overlap(spark, sf_dir):
    return L.key_overlap(L.match_keys(derived_profiles(spark, sf_dir)))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT ordinal, cluster_id FROM comp")
def link_components(spark, sf_dir):
    return L.link(derived_profiles(spark, sf_dir), "transitive")


# The single pass itself, one record after the other in every component at once: ``held`` lists (key, cluster).
_GREEDY = _COMPONENTS + """, rec AS (SELECT c.cluster_id AS comp, c.ordinal, coalesce(list(k.kind || ':' || k.key) FILTER (k.key IS NOT NULL), []) AS keys, row_number() OVER (PARTITION BY c.cluster_id ORDER BY c.ordinal) AS n
        FROM comp c LEFT JOIN k ON c.ordinal = k.ordinal GROUP BY c.cluster_id, c.ordinal),
    walk AS (SELECT comp, n, ordinal, ordinal AS cluster_id, list_transform(keys, lambda x: {'key': x, 'c': ordinal}) AS held FROM rec WHERE n = 1
        UNION ALL SELECT comp, n, ordinal, joins, list_concat(held, list_transform(keys, lambda x: {'key': x, 'c': joins})) FROM (
            SELECT rec.comp, rec.n, rec.ordinal, rec.keys, walk.held, coalesce(list_min(list_transform(list_filter(walk.held, lambda h: list_contains(rec.keys, h.key)), lambda h: h.c)), rec.ordinal) AS joins
            FROM walk JOIN rec ON rec.comp = walk.comp AND rec.n = walk.n + 1)),
    greedy AS (SELECT ordinal, cluster_id FROM walk)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT ordinal, cluster_id FROM greedy")
def link_greedy(spark, sf_dir):
    return L.link(derived_profiles(spark, sf_dir), "greedy")


@query(f"""WITH RECURSIVE {_CONTACTS}, k AS (SELECT doc_id, lower(unnest(emails)) AS key FROM c UNION SELECT doc_id, {d_phone('x')} FROM (SELECT doc_id, unnest(phones) AS x FROM c)),
    s AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (key) WHERE key IS NOT NULL), reach AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a)
    SELECT a AS doc_id, min(b) AS cluster_id FROM reach GROUP BY a""")
def link_documents(spark, sf_dir):
    return L.link(_document_profiles(spark, sf_dir), "transitive").select(F.col("ordinal").alias("doc_id"), "cluster_id")


@query(f"""WITH {_KEYS} SELECT ordinal, 'cand-' || left(sha256(array_to_string(list_sort(list(DISTINCT key)), '|')), 12) AS candidate_id FROM k GROUP BY ordinal""")
def entity_id(spark, sf_dir):
    keys = L.match_keys(derived_profiles(spark, sf_dir)).groupBy("ordinal").agg(F.collect_set("key").alias("keys"))
    return keys.select("ordinal", M.entity_id(F.col("keys"), F.array().cast("array<string>")).alias("candidate_id"))


# --- merge ----------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN i IS NULL THEN c WHEN c IS NULL THEN i WHEN lower(c) = lower(i) THEN c WHEN iw > cw THEN i ELSE c END AS value,
    CASE WHEN i IS NULL THEN cw WHEN c IS NULL THEN iw WHEN lower(c) = lower(i) THEN cw WHEN iw > cw THEN iw ELSE cw END AS weight,
    CASE WHEN i IS NULL THEN NULL WHEN c IS NULL THEN 'initial_write' WHEN lower(c) = lower(i) THEN NULL WHEN iw > cw THEN 'confidence_override' ELSE 'confidence_held' END AS method,
    CASE WHEN i IS NULL THEN NULL WHEN c IS NULL THEN i WHEN lower(c) = lower(i) THEN NULL WHEN iw > cw THEN i ELSE c END AS logged
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(event_type) ELSE 'held ' || event_type END AS c, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS i, 0.7::DOUBLE + (event_id % 3) / 10.0::DOUBLE AS cw, 0.8::DOUBLE AS iw FROM events)""")
def resolve_case(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN upper(event_type) ELSE concat('held ', event_type) END AS c", "CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(' ', event_type, ' ') END AS i", "0.7D + (event_id % 3) / 10.0D AS cw", "0.8D AS iw")
    return e.select("event_id", *[c.alias(k) for k, c in M.resolve_scalar(F.col("c"), F.col("cw"), F.col("i"), F.col("iw")).items()])


@query(f"WITH {_RANKED} SELECT DISTINCT cluster_id, first_value({d_safe('full_name')}) OVER (PARTITION BY cluster_id ORDER BY rank) AS full_name FROM r")
def resolve_scalar_name(spark, sf_dir):
    p = _ranked(spark, sf_dir)
    _, winner = M.merge_scalar(p, N.safe_str(F.col("full_name")), "full_name", "full_name")
    return p.groupBy("cluster_id").agg(winner.alias("full_name"))


@query(f"""WITH {_RANKED}, x AS (SELECT cluster_id, rank, unnest(emails) AS e, generate_subscripts(emails, 1) AS pos FROM r), y AS (SELECT *, lower({d_strip('e')}) AS key FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS n FROM y WHERE key <> '')
    SELECT cluster_id, string_agg(key, '|' ORDER BY rank, pos) AS emails FROM z WHERE n = 1 GROUP BY ALL""")
def contact_union(spark, sf_dir):
    _, items = M.merge_contacts(_ranked(spark, sf_dir), "emails", N.email_key)
    return items.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "text"))), lambda x: x["text"]), "|").alias("emails"))


@query(f"""WITH {_RANKED}, x AS (SELECT cluster_id, rank, unnest(other) AS o, generate_subscripts(other, 1) AS pos FROM r), y AS (SELECT *, {d_strip('o')} AS v FROM x), n AS (SELECT cluster_id, count(*) AS records FROM r GROUP BY ALL),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, v ORDER BY rank, pos) AS n FROM y WHERE v <> '')
    SELECT cluster_id, string_agg(v, '|' ORDER BY rank, pos) AS other FROM z JOIN n USING (cluster_id) WHERE z.n = 1 OR records = 1 GROUP BY ALL""")
def links_other_union(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", F.array_join("links.other", "|").alias("other"))


def _merged(spark, sf_dir) -> DataFrame:
    p = derived_profiles(spark, sf_dir)
    return M.merge(p, p.select("ordinal", F.col("grp").alias("cluster_id")))


@query(f"""WITH {_RANKED}, x AS (SELECT cluster_id, rank, weight, source_type, unnest(skills) AS s, generate_subscripts(skills, 1) AS pos FROM r), y AS (SELECT *, {d_strip('s')} AS name, lower({d_strip('s')}) AS key FROM x WHERE {d_strip('s')} <> ''),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key, source_type ORDER BY rank, pos) AS n FROM y)
    SELECT cluster_id, arg_min(name, rank * 1000 + pos) AS name, max(weight) AS confidence, string_agg(source_type, '|' ORDER BY rank, pos) AS sources FROM z WHERE n = 1 GROUP BY cluster_id, key""")
def skill_merge(spark, sf_dir):
    _, items = M.merge_skills(_ranked(spark, sf_dir))
    return items.select("cluster_id", "skill.name", "skill.confidence", F.array_join("skill.sources", "|").alias("sources"))


_JOBS = f"""{_RANKED}, x AS (SELECT cluster_id, rank, {d_safe('company')} AS company, {d_safe('title')} AS title, coalesce({d_date('started')}, {d_safe('started')}, '') AS started, coalesce({d_date('ended')}, {d_safe('ended')}) AS ended FROM r),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(company), lower(title) ORDER BY rank) AS n FROM x WHERE company IS NOT NULL AND title IS NOT NULL)"""


@query(f"WITH {_JOBS} SELECT cluster_id, company, title, started, ended FROM z WHERE n = 1")
def experience_dedupe(spark, sf_dir):
    _, items = M.merge_entries(_ranked(spark, sf_dir), "experience")
    return items.select("cluster_id", "experience.company", "experience.title", F.col("experience.start").alias("started"), F.col("experience.end").alias("ended"))


@query(f"""WITH {_JOBS} SELECT cluster_id, rank, 'initial_write' AS method, company || ' / ' || title || ' (' || started || ' → ' || coalesce(ended, 'Present') || ')' AS value FROM z
    UNION ALL SELECT cluster_id, rank, 'duplicate_confirmed', company || ' / ' || title FROM z WHERE n > 1""")
def experience_confirmed(spark, sf_dir):
    events, _ = M.merge_entries(_ranked(spark, sf_dir), "experience")
    return events.select("cluster_id", F.col("rank").cast("long").alias("rank"), "method", "value")


@query(f"""WITH {_RANKED}, z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(school) ORDER BY rank) AS n FROM r)
    SELECT cluster_id, {d_safe('school')} AS institution, coalesce({d_date('started')}, {d_safe('started')}) AS started FROM z WHERE n = 1""")
def education_dedupe(spark, sf_dir):
    _, items = M.merge_entries(_ranked(spark, sf_dir), "education")
    return items.select("cluster_id", "education.institution", F.col("education.start").alias("started"))


@query(f"""WITH {_RANKED} SELECT cluster_id, arg_min(c, rank) FILTER (c IS NOT NULL) AS city, arg_min(g, rank) FILTER (g IS NOT NULL) AS region, arg_min(n, rank) FILTER (n IS NOT NULL) AS country
    FROM (SELECT cluster_id, rank, {d_safe('city')} AS c, {d_safe('region')} AS g, upper(coalesce({d_country('country')}, {d_safe('country')})) AS n FROM r) GROUP BY ALL""")
def location_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", "location.city", "location.region", "location.country")


@query(f"WITH {_RANKED} SELECT cluster_id, round(max(weight), 4) AS overall_confidence FROM r GROUP BY ALL")
def overall_confidence(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", "overall_confidence")


@query(f"WITH {_RANKED} SELECT cluster_id, string_agg(source_id, '|' ORDER BY rank) AS sources FROM r GROUP BY ALL")
def lineage_sources(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", F.array_join("raw_sources", "|").alias("sources"))


def _scalar_log(stage: int, field: str, value: str, pos: int = 0, first: str | None = None) -> str:
    """Audit rows of a scalar field: the first value is written, later ones that differ but for case are held."""
    return f"""SELECT cluster_id, rank, {stage} AS stage, 0 AS phase, {pos} AS pos, '{field}' AS field, source_type AS source, CASE WHEN n = 1 THEN 'initial_write' ELSE 'confidence_held' END AS method, CASE WHEN n = 1 THEN raw ELSE winner END AS value
        FROM (SELECT *, first_value(v) OVER w AS winner, row_number() OVER w AS n FROM (SELECT cluster_id, rank, source_type, {value} AS v, {first or value} AS raw FROM g) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY cluster_id ORDER BY rank)) WHERE n = 1 OR lower(v) <> lower(winner)"""


def _contact_log(stage: int, field: str, key: str) -> str:
    return f"""SELECT cluster_id, rank, {stage}, 0, pos - 1, '{field}', source_type, 'array_union', e FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS n
        FROM (SELECT *, {key} AS key FROM (SELECT cluster_id, rank, source_type, unnest({field}) AS e, generate_subscripts({field}, 1) AS pos FROM g)) WHERE key <> '') WHERE n = 1"""


_RAW_COUNTRY = f"coalesce({d_country('country')}, {d_safe('country')})"
_JOB = "company || ' / ' || title"
# ``g``: the ranked records, and whether a record is the first of its cluster that has a location.
_LOG = f"""{_RANKED}, g AS (SELECT *, rank = min(CASE WHEN coalesce({d_safe('city')}, {d_safe('region')}, {d_safe('country')}) IS NOT NULL THEN rank END) OVER (PARTITION BY cluster_id) AS first_place FROM r),
    skill AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS n, first_value(name) OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS spelt, row_number() OVER (PARTITION BY cluster_id, key, source_type ORDER BY rank, pos) AS by_source
        FROM (SELECT *, {d_strip('s')} AS name, lower({d_strip('s')}) AS key FROM (SELECT cluster_id, rank, source_type, unnest(skills) AS s, generate_subscripts(skills, 1) AS pos FROM g)) WHERE name <> ''),
    job AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(company), lower(title) ORDER BY rank) AS n
        FROM (SELECT cluster_id, rank, source_type, {d_safe('company')} AS company, {d_safe('title')} AS title, coalesce({d_date('started')}, {d_safe('started')}, '') AS started, coalesce({d_date('ended')}, {d_safe('ended')}) AS ended FROM g) WHERE company IS NOT NULL AND title IS NOT NULL),
    school AS (SELECT cluster_id, rank, source_type, school, row_number() OVER (PARTITION BY cluster_id, lower(school) ORDER BY rank) AS n FROM g),
    log AS ({_scalar_log(0, 'full_name', d_safe('full_name'))}
        UNION ALL {_contact_log(1, 'emails', f"lower({d_strip('e')})")} UNION ALL {_contact_log(2, 'phones', d_phone('e'))}
        UNION ALL SELECT cluster_id, rank, 3, 0, pos - 1, 'skills[' || spelt || ']', source_type, CASE WHEN n = 1 THEN 'initial_write' ELSE 'skill_source_added' END, spelt FROM skill WHERE by_source = 1
        UNION ALL SELECT cluster_id, rank, 4, 0, 0, 'experience[' || company || '|' || title || ']', source_type, 'initial_write', {_JOB} || ' (' || started || ' → ' || coalesce(ended, 'Present') || ')' FROM job
        UNION ALL SELECT cluster_id, rank, 4, 1, 0, 'experience[' || company || '|' || title || ']', source_type, 'duplicate_confirmed', {_JOB} FROM job WHERE n > 1
        UNION ALL SELECT cluster_id, rank, 5, 0, 0, 'education[' || school || ']', source_type, 'initial_write', school FROM school
        UNION ALL SELECT cluster_id, rank, 5, 1, 0, 'education[' || school || ']', source_type, 'duplicate_confirmed', school FROM school WHERE n > 1
        UNION ALL {_scalar_log(6, 'location.city', d_safe('city'), 0)} UNION ALL {_scalar_log(6, 'location.region', d_safe('region'), 1)}
        UNION ALL {_scalar_log(6, 'location.country', f'upper({_RAW_COUNTRY})', 2, f'CASE WHEN first_place THEN {_RAW_COUNTRY} ELSE upper({_RAW_COUNTRY}) END')}
        UNION ALL {_scalar_log(7, 'links.linkedin', d_safe('linkedin'))})"""


@query(f"WITH {_LOG} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY rank, stage, phase, pos) - 1 AS place, field, source, method, value FROM log")
def provenance_log(spark, sf_dir):
    """All audit rows of all stages, with their places in the entity's log."""
    rows = _merged(spark, sf_dir).select("cluster_id", F.posexplode("provenance").alias("place", "e"))
    return rows.select("cluster_id", F.col("place").cast("long").alias("place"), "e.*")


@query(f"WITH {_JOBS} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY rank) - 1 AS place, company, title FROM z WHERE n = 1")
def experience_order(spark, sf_dir):
    rows = _merged(spark, sf_dir).select("cluster_id", F.posexplode("experience").alias("place", "e"))
    return rows.select("cluster_id", F.col("place").cast("long").alias("place"), "e.company", "e.title")


# --- validation -----------------------------------------------------------------------------------------------------


def _rough(spark, sf_dir) -> DataFrame:
    """Entities that break rules and are not normalised."""
    f, n = _flat(spark, sf_dir), F.col("ordinal")
    null = F.lit(None).cast("string")
    audit = F.struct(F.lit("full_name").alias("field"), F.when(n % 9 != 0, F.col("source_type")).alias("source"), F.lit("initial_write").alias("method"), F.col("full_name").alias("value"))
    return f.select(
        F.when(n % 6 != 0, F.col("source_id")).alias("candidate_id"),
        F.concat("emails", "emails").alias("emails"),
        "phones",
        F.when(n % 4 != 0, F.struct("city", "region", "country")).alias("location"),
        F.transform("skills", lambda x: F.struct(F.when(x != "BUILDING", x).alias("name"), F.when(n % 5 == 0, 1.5).otherwise(0.5).alias("confidence"), F.array("source_type").alias("sources"))).alias("skills"),
        F.array(F.struct(F.concat(F.lit(" "), "company").alias("company"), F.when(n % 7 != 0, F.col("title")).alias("title"), F.lit("2020-01").alias("start"), null.alias("end"), null.alias("summary"))).alias("experience"),
        F.array(F.struct(F.when(n % 8 != 0, F.concat("school", F.lit("  "))).alias("institution"), null.alias("degree"), null.alias("field_of_study"), null.alias("start"), null.alias("end"))).alias("education"),
        F.when(n % 3 == 0, -0.5).when(n % 3 == 1, 1.0).alias("overall_confidence"),
        F.array(audit).alias("provenance"),
    )


_PROBLEMS = {
    "candidate_id is missing": "ordinal % 6 = 0",
    "overall_confidence is not between 0 and 1": "ordinal % 3 <> 1",
    "a skill has no name": "list_contains(skills, 'BUILDING')",
    "a skill''s confidence is not between 0 and 1": "ordinal % 5 = 0 AND len(skills) > 0",
    "a job has no company, title or start": "ordinal % 7 = 0",
    "a school has no name": "ordinal % 8 = 0",
    "an audit row is incomplete": "ordinal % 9 = 0",
}


@query(" UNION ALL ".join(f"SELECT CASE WHEN ordinal % 6 <> 0 THEN source_id END AS candidate_id, '{problem}' AS problem FROM ({DUCK_PROFILES}) WHERE {rule}" for problem, rule in _PROBLEMS.items()))
def validate_problems(spark, sf_dir):
    return V.problems(_rough(spark, sf_dir))


@query(f"""SELECT CASE WHEN ordinal % 6 <> 0 THEN source_id END AS candidate_id, CASE WHEN ordinal % 4 <> 0 THEN upper({d_strip('country')}) END AS country, CAST(len(list_distinct(emails)) + CAST(list_contains(list_transform(emails, lambda x: x IS NULL), true) AS INT) AS BIGINT) AS emails,
    array_to_string(list_transform(list_filter(skills, lambda x: x <> 'BUILDING'), lambda x: {d_strip('x')}), '|') AS skills, company, CASE WHEN ordinal % 8 <> 0 THEN school END AS institution FROM ({DUCK_PROFILES})""")
def validate_normalised(spark, sf_dir):
    names = F.filter(F.transform("skills", lambda x: x["name"]), lambda x: x.isNotNull())
    return V.normalised(_rough(spark, sf_dir)).select("candidate_id", "location.country", F.size("emails").cast("long").alias("emails"), F.array_join(names, "|").alias("skills"), F.col("experience")[0]["company"].alias("company"), F.col("education")[0]["institution"].alias("institution"))


# --- projection -----------------------------------------------------------------------------------------------------


def _entities(spark, sf_dir) -> DataFrame:
    return _merged(spark, sf_dir)


def _project(df: DataFrame, *fields) -> DataFrame:
    specs = [dict(zip(("from", "path", "on_missing", "format"), f, strict=False)) for f in fields]
    return projection.project_struct(df, {"fields": specs}, keep=["cluster_id"])


_EMAILS = f"""x AS (SELECT cluster_id, rank, unnest(emails) AS e, generate_subscripts(emails, 1) AS pos FROM r), y AS (SELECT *, lower({d_strip('e')}) AS key FROM x WHERE {d_strip('e')} <> ''),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS n FROM y), m AS (SELECT cluster_id, list(key ORDER BY rank, pos) AS emails FROM z WHERE n = 1 GROUP BY ALL)"""
_SKILLS = f"""sx AS (SELECT cluster_id, rank, unnest(skills) AS s, generate_subscripts(skills, 1) AS pos FROM r), sy AS (SELECT *, {d_strip('s')} AS name FROM sx WHERE {d_strip('s')} <> ''),
    sz AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(name) ORDER BY rank, pos) AS n FROM sy), sm AS (SELECT cluster_id, list(name ORDER BY rank, pos) AS names FROM sz WHERE n = 1 GROUP BY ALL)"""


@query(f"WITH {_RANKED} SELECT cluster_id, first(CASE WHEN rank = 1 THEN {d_safe('full_name')} END ORDER BY rank) AS name, arg_min(c, rank) FILTER (c IS NOT NULL) AS city FROM (SELECT *, {d_safe('city')} AS c FROM r) GROUP BY ALL")
def proj_scalar_nested(spark, sf_dir):
    got = _project(_entities(spark, sf_dir), ("full_name", "who.name", "null"), ("location.city", "where.city", "null"))
    return got.select("cluster_id", "who.name", "where.city")


@query(f"WITH {_RANKED}, {_EMAILS} SELECT cluster_id, emails[1] AS first, emails[4] AS fourth FROM m")
def proj_index(spark, sf_dir):
    return _project(_entities(spark, sf_dir), ("emails[0]", "first", "null"), ("emails[3]", "fourth", "null")).select("cluster_id", "first", "fourth")


@query(f"WITH {_RANKED}, {_EMAILS} SELECT cluster_id, emails[-1] AS last, emails[-4] AS far FROM m")
def proj_negative_index(spark, sf_dir):
    return _project(_entities(spark, sf_dir), ("emails[-1]", "last", "null"), ("emails[-4]", "far", "null")).select("cluster_id", "last", "far")


@query(f"WITH {_RANKED}, {_SKILLS}, {_EMAILS} SELECT cluster_id, array_to_string(names, '|') AS names, array_to_string(emails, '|') AS emails FROM sm JOIN m USING (cluster_id)")
def proj_wildcard(spark, sf_dir):
    """A field of every item, and whole items."""
    got = _project(_entities(spark, sf_dir), ("skills[].name", "names", "null"), ("emails[]", "emails", "null"))
    return got.select("cluster_id", F.array_join("names", "|").alias("names"), F.array_join("emails", "|").alias("emails"))


@query(f"""WITH {_RANKED}, {_EMAILS} SELECT cluster_id, '{{"fourth": ' || coalesce('"' || emails[4] || '"', 'null') || ', "gone": null}}' AS json FROM m""")
def proj_on_missing_null(spark, sf_dir):
    fields = [{"from": "emails[3]", "path": "fourth", "on_missing": "null"}, {"from": "no.such", "path": "gone", "on_missing": "null"}]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


@query(f"""WITH {_RANKED}, {_EMAILS} SELECT cluster_id, '{{"first": "' || emails[1] || '"' || coalesce(', "more": {{"fourth": "' || emails[4] || '"}}', '') || ', "github": null}}' AS json FROM m""")
def proj_on_missing_omit(spark, sf_dir):
    fields = [{"from": s, "path": p, "on_missing": "omit"} for s, p in (("emails[0]", "first"), ("emails[3]", "more.fourth"), ("links.github", "github"))]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


@query(f"""WITH {_RANKED}, {_EMAILS} SELECT cluster_id, '{{"first": "' || emails[1] || '", "github": null}}' AS json FROM m""")
def proj_on_missing_error(spark, sf_dir):
    """A present null is not missing, so nothing is raised."""
    fields = [{"from": s, "path": p, "on_missing": "error"} for s, p in (("emails[0]", "first"), ("links.github", "github"))]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


@query(f"""WITH {_RANKED}, {_EMAILS} SELECT cluster_id, '{{"contact": ' || CASE WHEN emails[4] IS NULL THEN '"' || emails[1] || '"' ELSE '{{"fourth": "' || emails[4] || '"}}' END || ', "who": "' || emails[1] || '"}}' AS json FROM m""")
def proj_nested_overwrite(spark, sf_dir):
    """An object takes the place of a value where its path is present, and a value that of an object."""
    writes = (("emails[0]", "contact", "null"), ("emails[3]", "contact.fourth", "omit"), ("full_name", "who.name", "null"), ("emails[0]", "who", "null"))
    fields = [{"from": s, "path": p, "on_missing": m} for s, p, m in writes]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


@query(f"""WITH {_RANKED}, {_EMAILS}, l AS (SELECT cluster_id, arg_min(c, rank) FILTER (c IS NOT NULL) AS city, arg_min(g, rank) FILTER (g IS NOT NULL) AS region, arg_min(n, rank) FILTER (n IS NOT NULL) AS country
        FROM (SELECT cluster_id, rank, {d_safe('city')} AS c, {d_safe('region')} AS g, upper({_RAW_COUNTRY}) AS n FROM r) GROUP BY ALL)
    SELECT cluster_id, '{{"place": {{' || CASE WHEN coalesce(city, region, country) IS NULL THEN '' ELSE '"city": ' || coalesce('"' || city || '"', 'null') || ', "region": ' || coalesce('"' || region || '"', 'null') || ', "country": ' || coalesce('"' || country || '"', 'null') || ', ' END || '"mail": "' || emails[1] || '"}}}}' AS json FROM l JOIN m USING (cluster_id)""")
def proj_write_into_object(spark, sf_dir):
    fields = [{"from": s, "path": p, "on_missing": "null"} for s, p in (("location", "place"), ("emails[0]", "place.mail"))]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


@query(f"""WITH {_RANKED} SELECT DISTINCT cluster_id, '{{"gone": null}}' AS json FROM r""")
def proj_unknown_format(spark, sf_dir):
    """An unknown format raises only where its path is present."""
    fields = [{"from": "no.such", "path": "gone", "on_missing": "null", "format": "nope"}, {"from": "emails[99]", "path": "far", "on_missing": "omit", "format": "nope"}]
    return projection.project_json(_entities(spark, sf_dir), {"fields": fields}, keep=["cluster_id"])


def _format(name: str, column: str, table: str, key: str):
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        value, _ = FORMATS[name](df[column], df.schema[column].dataType)
        return df.select(key, value.alias("out"))

    run.__name__ = f"fmt_{name}"
    return run


_FORMAT_SQL = {
    "uppercase": ("p_name", "part", "p_partkey", "upper(p_name)"),
    "lowercase": ("p_type", "part", "p_partkey", "lower(p_type)"),
    "titlecase": ("p_type", "part", "p_partkey", r"array_to_string(list_transform(regexp_extract_all(lower(p_type), '\p{L}+|\P{L}+'), lambda t: upper(t[1]) || t[2:]), '')"),
    "strip": ("props", "events", "event_id", d_strip("props")),
}
for _name, (_column, _table, _key, _sql) in _FORMAT_SQL.items():
    query(f"SELECT {_key}, {_sql} AS out FROM {_table}")(_format(_name, _column, _table, _key))


def _list_format(name: str):
    def run(spark, sf_dir):
        df = _flat(spark, sf_dir)
        value, _ = FORMATS[name](df["emails"], df.schema["emails"].dataType)
        return df.select("ordinal", value.alias("out"))

    run.__name__ = f"fmt_{name}"
    return run


for _name, _sql in {"join_comma": "array_to_string(list_filter(emails, lambda x: x IS NOT NULL), ', ')", "join_newline": "array_to_string(list_filter(emails, lambda x: x IS NOT NULL), chr(10))", "first": "emails[1]", "count": "CAST(len(emails) AS BIGINT)"}.items():
    query(f"SELECT ordinal, {_sql} AS out FROM ({DUCK_PROFILES})")(_list_format(_name))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Present' ELSE strftime(o_orderdate, '%Y-%m') END AS month, '+1' || lpad(CAST(2000000000 + o_orderkey AS VARCHAR), 10, '0') AS phone, CASE o_orderkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'ES' ELSE 'ZZ' END AS country FROM orders")
def fmt_strict_normalisers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS cluster_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'now' ELSE date_format(o_orderdate, 'yyyy/MM/dd') END AS d", "CAST(2000000000 + o_orderkey AS STRING) AS p", "CASE o_orderkey % 3 WHEN 0 THEN 'america' WHEN 1 THEN 'España' ELSE 'zz' END AS c")
    got = _project(o, ("d", "month", "error", "yyyy-mm"), ("p", "phone", "error", "e164"), ("c", "country", "error", "iso-alpha2"))
    return got.select(F.col("cluster_id").alias("o_orderkey"), "month", "phone", "country")


# --- the whole run --------------------------------------------------------------------------------------------------

CONFIG = {
    "flags": {"include_overall_confidence": True},
    "fields": [
        {"from": "candidate_id", "path": "id", "on_missing": "error"},
        {"from": "full_name", "path": "name", "on_missing": "null", "format": "titlecase"},
        {"from": "emails[0]", "path": "contact.email", "on_missing": "null", "format": "lowercase"},
        {"from": "phones[0]", "path": "contact.phone", "on_missing": "omit", "format": "e164"},
        {"from": "skills[].name", "path": "skill_count", "on_missing": "null", "format": "count"},
    ],
}

_PHONES = f"""px AS (SELECT cluster_id, rank, unnest(phones) AS e, generate_subscripts(phones, 1) AS pos FROM r), py AS (SELECT *, {d_phone('e')} AS key FROM px WHERE {d_phone('e')} IS NOT NULL),
    pz AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY rank, pos) AS n FROM py), pm AS (SELECT cluster_id, list(key ORDER BY rank, pos) AS phones FROM pz WHERE n = 1 GROUP BY ALL)"""
_LINKED = """, r AS (SELECT p.*, l.cluster_id, CASE source_type WHEN 'ats' THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS weight, row_number() OVER (PARTITION BY l.cluster_id ORDER BY CASE source_type WHEN 'ats' THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END DESC, ordinal) AS rank FROM p JOIN {} l USING (ordinal))"""
_TITLE = r"array_to_string(list_transform(regexp_extract_all(lower(x), '\p{L}+|\P{L}+'), lambda t: upper(t[1]) || t[2:]), '')"
_RUN_SQL = f"""{_EMAILS}, {_PHONES}, {_SKILLS}, h AS (SELECT cluster_id, {d_safe('full_name')} AS x, weight FROM r WHERE rank = 1)
    SELECT cluster_id, '{{"id": "cand-' || left(sha256(array_to_string(list_sort(list_distinct(list_concat(emails, coalesce(phones, [])))), '|')), 12) || '", "name": "' || {_TITLE} || '", "contact": {{"email": "' || emails[1] || '"' || coalesce(', "phone": "' || phones[1] || '"', '') || '}}, "skill_count": ' || len(names) || ', "overall_confidence": ' || weight || '}}' AS json
    FROM h JOIN m USING (cluster_id) LEFT JOIN pm USING (cluster_id) JOIN sm USING (cluster_id)"""
_PIPELINE_SQL = f"WITH RECURSIVE {_COMPONENTS}{_LINKED.format('comp')}, {_RUN_SQL}"


@query(_PIPELINE_SQL)
def pipeline_json(spark, sf_dir):
    return pipeline.run(derived_profiles(spark, sf_dir).drop("grp"), CONFIG, all_candidates=True, linkage="transitive")


@query(_PIPELINE_SQL + " ORDER BY cluster_id LIMIT 1")
def first_candidate(spark, sf_dir):
    return pipeline.run(derived_profiles(spark, sf_dir).drop("grp"), CONFIG, linkage="transitive")


@query(f"WITH RECURSIVE {_GREEDY}{_LINKED.format('greedy')}, {_RUN_SQL}")
def all_candidates(spark, sf_dir):
    """The default, greedy linkage, over all entities."""
    return pipeline.run(derived_profiles(spark, sf_dir).drop("grp"), CONFIG, all_candidates=True)

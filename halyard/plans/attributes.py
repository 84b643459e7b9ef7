"""Attribute queries: orders as data sets with text values, nested items and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import attributes as A
from halyard.functions import display, text
from halyard.operators import dictionaries as R
from halyard.registry import query
from halyard.shared import shared_folder
from halyard.sources import archive
from halyard.sources import elements as E
from halyard.streaming import progress

from .common import table
from .scalars import KEY, uid_sql


def _of(values: list, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)


_VALUES_SQL = "(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['12', '7'] WHEN 3 THEN ['x', '3'] ELSE [CAST(o_custkey AS VARCHAR), '2.5'] END)"


@query(
    "getters",
    f"""SELECT o_orderkey, array_to_string(nullif(v, []), '\\') AS as_text, coalesce(TRY_CAST(v[1] AS INT), -1) AS as_int, TRY_CAST(v[1] AS DOUBLE) AS as_double,
        CASE WHEN len(v) > 0 AND len(list_filter(v, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 THEN list_sum(list_transform(v, lambda x: TRY_CAST(x AS DOUBLE))) ELSE 0.5 END AS doubles, coalesce(len(nullif(v, [])), 1) AS texts FROM (SELECT o_orderkey, {_VALUES_SQL} AS v FROM orders)""",
)
def getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of an attribute that may be absent, empty, or no number."""
    k = F.col("o_orderkey") % 5
    v = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("12"), F.lit("7"))).when(k == 3, F.array(F.lit("x"), F.lit("3"))).when(k == 4, F.array(F.col("o_custkey").cast("string"), F.lit("2.5")))
    doubles = A.numbers_of(v, "double", F.array(F.lit(0.5)))
    total = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", A.text_of(v).alias("as_text"), A.number_of(v, "int", -1).alias("as_int"), A.number_of(v, "double").alias("as_double"), total.alias("doubles"), F.size(A.texts_of(v, F.array(F.lit("-")))).alias("texts")
    )


@query(
    "modality_lookup",
    "WITH i AS (SELECT o_orderkey, (['CT', '', NULL])[CAST(o_orderkey % 3 AS INT) + 1] AS a, (['MR', ' '])[CAST(o_custkey % 2 AS INT) + 1] AS b FROM orders) SELECT o_orderkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'OT') AS modality FROM i",
)
def modality_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute of an item, else of the data sets around it."""
    item, parent = (F.struct(c.alias("modality")) for c in (_of(["CT", "", None], F.col("o_orderkey") % 3), _of(["MR", " "], F.col("o_custkey") % 2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", A.nearest("modality", item, parent, F.struct(F.lit("OT").alias("modality"))).alias("modality"))


@query(
    "shown_values",
    "SELECT o_orderkey, o_orderstatus || '\\' || o_orderpriority AS texts, o_orderkey % 7 || ', ' || o_custkey AS numbers, strftime(o_orderdate, '%b %-d, %Y') AS day, strftime(o_orderdate + INTERVAL (o_custkey * 61) SECOND, '%b %-d, %Y, %-I:%M:%S %p') AS moment FROM orders",
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as display texts."""
    moment = F.col("o_orderdate") + F.make_interval(secs=F.col("o_custkey") * 61)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        A.shown(F.array("o_orderstatus", "o_orderpriority")).alias("texts"),
        A.shown(F.array(F.col("o_orderkey") % 7, F.col("o_custkey")), ", ").alias("numbers"),
        A.medium_date(F.col("o_orderdate")).alias("day"),
        A.medium_datetime(moment).alias("moment"),
    )


@query(
    "xml_datetime",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_ms(o_orderdate) - CASE WHEN o_orderkey % 3 = 1 THEN 7200000 ELSE 0 END END AS ms FROM orders",
)
def xml_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of XML text with and without a zone; a date alone is none."""
    k, base = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    t = A.xml_datetime(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit(" "), base, F.lit("+02:00"))).otherwise(F.concat(base, F.lit(".000Z"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(t).alias("ms"))


_MONTHS = "datediff('month', birth, day) - CASE WHEN extract(day FROM day) < extract(day FROM birth) THEN 1 ELSE 0 END"


@query(
    "patient_age",
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (['033Y', ' '])[CAST(o_custkey % 2 AS INT) + 1] END AS known, CASE WHEN o_orderkey % 9 > 0 THEN DATE '1989-03-15' + CAST(o_custkey * 17 % 900 AS INT) END AS birth,
          coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 40 END, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 80 END) AS day FROM orders),
        m AS (SELECT *, {_MONTHS} AS m FROM o)
        SELECT o_orderkey, coalesce(nullif(trim(known), ''), CASE WHEN m >= 24 THEN printf('%03dY', m // 12) WHEN m >= 2 THEN printf('%03dM', m) ELSE printf('%03dD', datediff('day', birth, day)) END) AS age FROM m""",
)
def patient_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age that is stated, else the one at the first known day."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    birth = F.when(k % 9 > 0, F.date_add(F.lit("1989-03-15").cast("date"), (c * 17 % 900).cast("int")))
    days = [F.when(k % 3 == 0, day), F.when(k % 3 == 1, F.date_add(day, 40)), F.when(c % 2 == 0, F.date_add(day, 80))]
    age = A.patient_age(F.when(k % 4 == 0, _of(["033Y", " "], c % 2)), birth, days)
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"))


@query(
    "patient_pairs",
    "SELECT id || coalesce(issuer, '') AS patient, count(*) AS patients FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 12 AS VARCHAR) END AS issuer FROM customer) GROUP BY 1",
)
def patient_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients are pairs of identifier and issuer; how many pairs share a display key."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 12).cast("string")).alias("issuer")).distinct()
    return pairs.groupBy(A.patient_key(F.col("id"), F.col("issuer")).alias("patient")).agg(F.count(F.lit(1)).alias("patients"))


@query(
    "viewer_messages",
    """WITH m AS (SELECT event_id, (['warn', 'WARNING', 'Err', 'error', 'info', NULL, 'x'])[CAST(event_id % 7 AS INT) + 1] AS l, (['dicom_web', ' DICOM_WEB ', 'dicom', NULL, '?'])[CAST(event_id % 5 AS INT) + 1] AS q, event_type, user_id FROM events)
       SELECT event_id, '[' || CASE WHEN lower(l) IN ('warn', 'warning') THEN 'Warning' WHEN lower(l) IN ('err', 'error') THEN 'Error' ELSE 'Info' END || '] ' || event_type || ': user ' || user_id AS message, CASE WHEN upper(trim(q)) = 'DICOM_WEB' THEN 'DICOM_WEB' ELSE 'DICOM' END AS mode FROM m""",
)
def viewer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of any spelling, display texts, and query modes."""
    k = F.col("event_id")
    level = A.severity(_of(["warn", "WARNING", "Err", "error", "info", None, "x"], k % 7))
    message = A.viewer_message(level, F.col("event_type"), F.concat(F.lit("user "), F.col("user_id")))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"), A.query_mode(_of(["dicom_web", " DICOM_WEB ", "dicom", None, "?"], k % 5)).alias("mode"))


@query(
    "region_sides",
    """WITH r AS (SELECT p_partkey, p_type, (['L', 'U', '', NULL])[CAST(p_partkey % 4 AS INT) + 1] AS f, (['R', 'U', NULL])[CAST(p_size % 3 AS INT) + 1] AS i, CASE p_size % 4 WHEN 0 THEN ['UPPER', 'LEFT'] WHEN 1 THEN ['UPPER'] WHEN 2 THEN [] ELSE NULL END AS m FROM part)
       SELECT p_partkey, coalesce(coalesce(f, i) NOT IN ('U', ''), false) OR coalesce(list_contains(m, 'LEFT'), false) AS paired, p_type || CASE WHEN len(m) > 0 THEN ' (' || array_to_string(m, ', ') || ')' ELSE '' END AS region FROM r""",
)
def region_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a region has a side, and its text with modifiers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.when(s % 4 == 0, F.array(F.lit("UPPER"), F.lit("LEFT"))).when(s % 4 == 1, F.array(F.lit("UPPER"))).when(s % 4 == 2, F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", A.paired(_of(["L", "U", "", None], k % 4), _of(["R", "U", None], s % 3), m).alias("paired"), A.region_text(F.col("p_type"), m).alias("region"))


@query(
    "localised_labels",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND n_nationkey % 2 = 0 THEN lower(n_name) ELSE coalesce(n_name, '?') END AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + c_custkey % 4",
)
def localised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the asked language where there is one, else in the default language, else a placeholder."""
    n = table(spark, sf_dir, "nation")
    labels = n.select(F.col("n_nationkey").alias("code"), F.lit("en").alias("lang"), F.col("n_name").alias("label")).union(n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("de"), F.lower("n_name")))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + F.col("c_custkey") % 4).alias("wanted"), F.when(F.col("c_custkey") % 3 == 0, "de").otherwise("en").alias("lang"))
    return R.localised(c, "wanted", "lang", labels, "en", "?").select("c_custkey", "label")


@query(
    "progress_texts",
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '0 % (0 remaining)' ELSE (100 * (o_custkey % 7 % (o_custkey % 5 + 1)) // (o_custkey % 5)) || ' % (' || (o_custkey % 5 - o_custkey % 7 % (o_custkey % 5 + 1)) || ' remaining)' END AS shown FROM orders",
)
def progress_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_custkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", A.progress_text(F.col("o_custkey") % 7 % (total + 1), total).alias("shown"))


@query(
    "paths",
    "SELECT o_orderkey, 'in/' || o_orderstatus || '/' || replace(o_orderpriority, '-', '_') || '/.dcm' AS path, 'a.b/c' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' || lpad(CAST(o_custkey % 90 AS VARCHAR), CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 3 END, '0') END || '.png' AS frame FROM orders",
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from templates, and of frames."""
    named = A.path_template("in/{status}/{priority}/{absent}.dcm", {"status": F.col("o_orderstatus"), "priority": F.replace("o_orderpriority", F.lit("-"), F.lit("/"))})
    frame = A.frame_path(F.lit("a.b/c.png"), F.col("o_custkey") % 90, _of([1, 90, 100], F.col("o_orderkey") % 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", named.alias("path"), frame.alias("frame"))


@query(
    "code_stream_fragments",
    "SELECT p_partkey, i AS fragment, i * 100 AS start, least(100, n - i * 100) AS length, least(100, n - i * 100) + least(100, n - i * 100) % 2 AS padded FROM (SELECT p_partkey, p_size * 7 AS n, unnest(range(0, CAST(ceil(p_size * 7 / 100.0) AS BIGINT))) AS i FROM part)",
)
def code_stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(A.fragments((F.col("p_size") * 7).cast("long"), 100)).alias("fragment", "f"))
    return p.select("p_partkey", F.col("fragment").cast("long").alias("fragment"), "f.*")


_SEED = "'study/' || o_orderkey"


@query(
    "required_attributes",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ISO_IR 100' ELSE 'ISO_IR 192' END AS character_set, CASE WHEN o_orderkey % 3 = 0 THEN '1.2.' || o_orderkey ELSE {uid_sql(_SEED)} END AS study, '20240102' AS creation_date, '030405' AS creation_time FROM orders",
)
def required_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    got = A.required(F.when(k % 2 == 0, "ISO_IR 100").otherwise(" "), {"study": F.when(k % 3 == 0, F.concat(F.lit("1.2."), k))}, k, KEY, "2024-01-02 03:04:05")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in got.items()))


@query(
    "pseudonymise_tree",
    f"""SELECT o_orderkey, {uid_sql("'1.' || o_orderkey")} AS study, '1.9' AS other, string_agg({uid_sql("'2.' || l_partkey")}, ',' ORDER BY l_partkey, l_linenumber) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def pseudonymise_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of a data set replaced at every depth, others kept; the same identifier has one pseudonym everywhere."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct("l_partkey", "l_linenumber", F.concat(F.lit("2."), F.col("l_partkey")).alias("ReferencedSOPInstanceUID"))
    inner = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    tree = inner.select("o_orderkey", F.struct(F.concat(F.lit("1."), F.col("o_orderkey")).alias("StudyInstanceUID"), F.lit("1.9").alias("SOPClassUID"), F.array(F.struct("items")).alias("series")).alias("d"))
    tree = tree.withColumn("d", A.pseudonymise(F.col("d"), tree.schema["d"].dataType, KEY))
    shown = F.array_join(F.transform(F.col("d.series")[0]["items"], lambda x: x["ReferencedSOPInstanceUID"]), ",")
    return tree.select("o_orderkey", F.col("d.StudyInstanceUID").alias("study"), F.col("d.SOPClassUID").alias("other"), shown.alias("items"))


@query(
    "sequence_items",
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'a=' || p_size || ',b=2' END AS codes, CASE WHEN p_size % 3 = 0 THEN '2,3' WHEN p_size % 3 = 1 THEN '1,3' ELSE '1,2' END AS without, CASE WHEN p_size % 3 = 0 THEN '9,2,3' WHEN p_size % 3 = 1 THEN '1,9,3' ELSE '1,2,9' END AS replaced FROM part",
)
def sequence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a code sequence, and sequences with an item removed or replaced."""
    s = F.col("p_size")
    codes = F.when(s % 4 > 0, F.array(F.struct(F.lit("a").alias("CodeValue"), s.cast("string").alias("CodeMeaning")), F.struct(F.lit("b").alias("CodeValue"), F.lit("2").alias("CodeMeaning"))))
    shown = F.transform(A.macro(codes, value="CodeValue", meaning="CodeMeaning"), lambda x: F.concat(x["value"], F.lit("="), x["meaning"]))
    numbers, join = F.array(F.lit(1), F.lit(2), F.lit(3)), lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(shown, ",").alias("codes"), join(A.without_item(numbers, s % 3)).alias("without"), join(A.with_item(numbers, s % 3, F.lit(9))).alias("replaced"))


@query(
    "authorised_nodes",
    "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AS allowed, c_acctbal > 0 AND c_nationkey > 2 AND c_custkey % 2 = 0 AS readable FROM customer",
)
def authorised_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a list, with and without a host; images that can be decoded."""
    allowed = A.authorised(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), [("BUILDING", None), ("MACHINERY", "3")])
    return table(spark, sf_dir, "customer").select("c_custkey", allowed.alias("allowed"), A.decodable(F.col("c_acctbal"), F.col("c_nationkey") - 2, F.col("c_custkey") % 2 == 0).alias("readable"))


@query(
    "masks_by_station",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'default' WHEN c_nationkey < 10 THEN 'mask ' || c_nationkey ELSE 'default' END AS mask FROM customer",
)
def masks_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station's mask, else the one for all others."""
    masks = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("code"), F.concat(F.lit("mask "), F.col("n_nationkey")).alias("label"))
    masks = masks.union(spark.createDataFrame([("*", "default")], "code string, label string"))
    c = table(spark, sf_dir, "customer").withColumn("station", F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey").cast("string")))
    return R.look_up_or(c, "station", masks, "*").select("c_custkey", F.col("label").alias("mask"))


@query("content_digest", "SELECT p_type, count(*) AS images, count(DISTINCT sha256(p_brand || p_size)) AS contents, max(sha256(p_brand || p_size)) AS last FROM part GROUP BY 1")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of contents: how many differ."""
    digest = F.sha2(F.concat("p_brand", "p_size").cast("binary"), 256)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("images"), F.count_distinct(digest).alias("contents"), F.max(digest).alias("last"))


_CT = "1.2.840.10008.5.1.4.1.1.2"
_PLACES = "{PatientID,slice,-1}/{Modality,upper}/{SOPInstanceUID}.dcm"


def archive_of_customers(spark: SparkSession, sf_dir: str) -> str:
    """Writes a file for each customer: odd keys with implicit representations, each third without file meta information, names in two items of a sequence."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    uid = F.concat(F.lit("1.2."), k)
    parts = {}
    for explicit in (True, False):
        e = lambda name, value, explicit=explicit: E.element(name, value, explicit)
        inner = [E.element("PatientID", F.concat(k.cast("string"), F.lit(f"-{n}")), explicit) for n in (1, 2)]
        data = [e("SpecificCharacterSet", F.lit("ISO_IR 192")), e("SOPClassUID", F.lit(_CT)), e("SOPInstanceUID", uid), e("Modality", F.lit("ct")), e("PatientName", F.col("c_name")), e("PatientID", k)]
        data += [F.when(k % 2 == 0, E.items("OtherPatientIDsSequence", inner, explicit, True)).otherwise(E.items("OtherPatientIDsSequence", inner, explicit, False))]
        data += [e("Rows", k % 512), e("WindowCenter", F.concat(k % 90, F.lit("\\"), k % 7)), e("PixelData", F.lit(bytes(64)))]
        whole = F.concat(*data)
        syntax = E.EXPLICIT if explicit else E.IMPLICIT
        parts[explicit] = F.when(k % 3 > 0, E.file_bytes(F.lit(_CT), uid, syntax, whole)).otherwise(whole)
    content = F.when(k % 4 < 2, parts[True]).otherwise(parts[False])
    names = A.path_template(_PLACES, {"PatientID": k, "Modality": F.lit("ct"), "SOPInstanceUID": uid})
    archive.register(spark)
    folder = shared_folder(spark, "archive")
    c.select(names.alias("name"), content.alias("content")).write.format("archive").mode("append").save(folder)
    return folder


def _below(path: Column) -> Column:
    return F.substring_index(path, "/", -3)


@query(
    "send_list",
    f"""SELECT '1.2.' || c_custkey AS iuid, '{_CT}' AS cuid, CASE WHEN c_custkey % 4 < 2 THEN '{"1.2.840.10008.1.2.1"}' ELSE '{"1.2.840.10008.1.2"}' END AS tsuid,
        CASE WHEN c_custkey % 3 > 0 THEN 132 + 12 + 14 + 8 + 26 + 8 + (length('1.2.' || c_custkey) + 1) // 2 * 2 + 8 + CASE WHEN c_custkey % 4 < 2 THEN 20 ELSE 18 END ELSE 0 END AS position,
        right(CAST(c_custkey AS VARCHAR), 1) || '/CT/1.2.' || c_custkey || '.dcm' AS path FROM customer""",
)
def send_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sender needs of each file of an archive: identifiers and transfer syntax from the file meta information, or from the data set's head where there is
    none, where the data set starts, and the path."""
    files = spark.read.format("archive").load(archive_of_customers(spark, sf_dir))
    return files.where("error IS NULL").select(F.col("instance_uid").alias("iuid"), F.col("class_uid").alias("cuid"), F.col("syntax").alias("tsuid"), "position", _below(F.col("path")).alias("path"))


@query(
    "archive_tags",
    """SELECT 'ct' AS modality, c_name AS name, c_custkey % 512 AS n_rows, c_custkey || '-1,' || c_custkey || '-2' AS others, CAST(c_custkey % 90 AS DOUBLE) AS center, 2 AS centers FROM customer""",
)
def archive_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of an archive's files: text, numbers, several values, and a sequence's items, of either form and syntax; pixels are not read."""
    wanted = "Modality string, PatientName string, Rows int, OtherPatientIDsSequence array<struct<PatientID:string>>, WindowCenter array<double>, error string"
    files = spark.read.format("archive").schema(wanted).load(archive_of_customers(spark, sf_dir)).where("error IS NULL")
    others = F.array_join(F.transform("OtherPatientIDsSequence", lambda x: x["PatientID"]), ",")
    return files.select(F.col("Modality").alias("modality"), F.col("PatientName").alias("name"), F.col("Rows").alias("n_rows"), others.alias("others"), F.col("WindowCenter")[0].alias("center"), F.size("WindowCenter").alias("centers"))


@query(
    "path_formats",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') || '/' || upper(o_orderstatus) || '-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '/' || (o_custkey + 5) || '/' || md5(o_orderpriority) || '/' || right(o_orderpriority, 3) || '/' ||
       lpad(hex(CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT)), 8, '0') || '/2024-02-03' AS path FROM orders""",
)
def path_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with dates, numbers, digests and parts of attributes."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    values = {"day": day, "status": F.col("o_orderstatus"), "customer": F.col("o_custkey"), "priority": F.col("o_orderpriority"), "key": F.col("o_orderkey")}
    pattern = "{day,date,yyyy/MM/dd}/{status,upper}-{customer,number,000000000}/{customer,offset,5}/{priority,md5}/{priority,slice,-3}/{key,hash}/{now,date,yyyy-MM-dd}"
    return table(spark, sf_dir, "orders").select("o_orderkey", A.path_template(pattern, values, F.lit("2024-02-03 10:00:00")).alias("path"))


@query(
    "dimse_counts",
    """WITH s AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'failed' ELSE 'completed' END AS s FROM lineitem), c AS (SELECT l_orderkey, count(*) FILTER (s = 'completed') AS c, count(*) FILTER (s = 'failed') AS f, count(*) FILTER (s = 'warning') AS w, greatest(8 - count(*), 1) - 1 AS r FROM s GROUP BY 1)
       SELECT l_orderkey, concat_ws(', ', CASE WHEN f > 0 THEN f || ' of ' || (c + f + w + r) || ' failed' END, CASE WHEN r > 0 THEN r || ' remaining' END, CASE WHEN w > 0 THEN w || ' with warnings' END) AS message FROM c""",
)
def dimse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers counted by their status codes, as a message."""
    code = _of([0xB000, 0xA700, 0x0000, 0x0000], F.col("l_linenumber") % 4)
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", progress.dimse_status(code).alias("status"))
    c = t.groupBy("l_orderkey").agg(*progress.counters("status", 8))
    return c.select("l_orderkey", progress.message(F.col("completed"), F.col("failed"), F.col("warning"), F.col("remaining")).alias("message"))


@query("instance_keys", "SELECT l_orderkey, l_linenumber, '1.2.' || l_orderkey || CASE WHEN l_linenumber < 4 THEN '?' || l_linenumber ELSE '' END AS key FROM lineitem")
def instance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.instance_key(F.concat(F.lit("1.2."), F.col("l_orderkey")), number).alias("key"))


@query(
    "windows_of_both",
    "SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_size % 3 > 0 THEN ['pr ' || p_size] ELSE [] END, CASE WHEN p_partkey % 2 = 0 THEN ['a', 'b'] ELSE [] END), ',') AS windows FROM part",
)
def windows_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation state's windows, then the image's; overlays go together in the same way."""
    state = F.when(F.col("p_size") % 3 > 0, F.array(F.concat(F.lit("pr "), F.col("p_size"))))
    image = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.in_turn(state, image), ",").alias("windows"))


@query(
    "presentation_states",
    """WITH u AS (SELECT p_partkey, p_partkey % 14 AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN 'BASIC_GRAYSCALE' WHEN n IN (2, 3, 4) THEN 'COLOR_BASED' WHEN n = 5 THEN 'SPECIALIZED' WHEN n = 8 THEN 'ADVANCED_BLENDING' WHEN n = 12 THEN 'ADVANCED_LUT' WHEN n BETWEEN 6 AND 11 THEN 'VOLUMETRIC' END AS grouped FROM u""",
)
def presentation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of presentation states by their class."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("1.2.840.10008.5.1.4.1.1.11."), F.col("p_partkey") % 14).alias("uid"))
    return p.join(R.presentation_states(spark), "uid", "left").select("p_partkey", F.col("group").alias("grouped"))


@query(
    "patients_in_order",
    "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS position FROM customer",
)
def patients_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by name, as bytes."""
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("position"))


@query(
    "metadata_model",
    "SELECT p_partkey, '1.2.840.10008.1.2' || CASE WHEN p_size % 2 = 0 THEN '.1' ELSE '' END AS syntax, p_name AS description, greatest(p_size, 0) AS n_rows, CASE WHEN p_size % 20 BETWEEN 1 AND 16 THEN p_size % 20 WHEN p_size % 20 = 0 THEN 1 ELSE 16 END AS bits FROM part",
)
def metadata_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as one column of file meta information, data set and descriptor."""
    s = F.col("p_size")
    syntax = F.concat(F.lit("1.2.840.10008.1.2"), F.when(s % 2 == 0, ".1").otherwise(""))
    none = F.lit(None).cast("int")
    descriptor = display.image_descriptor(s, s, none, none, F.lit(16), s % 20, none)
    m = A.metadata(F.struct(syntax.alias("transfer_syntax")), F.struct(F.col("p_name").alias("description"), s.alias("rows")), descriptor)
    t = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return t.select("p_partkey", F.col("m.transfer_syntax").alias("syntax"), F.col("m.dataset.description").alias("description"), F.col("m.descriptor.n_rows").alias("n_rows"), F.col("m.descriptor.bits_stored").alias("bits"))

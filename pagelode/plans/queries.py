"""The registered queries over rendered corpora, each with the SQL that says what it must give.

Every query parses the rendered bytes; the SQL never sees a PDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.operators import search
from pagelode.operators.edits import apply_edits, check_values
from pagelode.operators.exports import safe_text
from pagelode.operators.relations import parse, relation
from pagelode.plans import reports, rules
from pagelode.sources import corpus
from pagelode.sources.lazy import deep_diagnostics, lazy_reports, parse_lazy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


DEFECTS = """
WITH rule(kind, rule_id, severity) AS (VALUES
  (1, 'object.missing_reference', 'error'), (2, 'xref.invalid_offset', 'error'), (2, 'object.missing_reference', 'error'),
  (3, 'stream.decode_failed', 'error'), (4, 'content.unknown_operator', 'warning'), (5, 'stream.length_mismatch', 'warning'),
  (6, 'page.missing_mediabox', 'warning'), (7, 'content.unbalanced_graphics_state', 'warning'))
"""


@registered(DEFECTS + "SELECT rule_id, severity, count(*) AS n FROM customer JOIN rule ON c_custkey % 8 = kind GROUP BY ALL")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fires over the corpus."""
    return rules.findings(corpus.customers(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@registered(DEFECTS + """
SELECT c_custkey AS doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  CAST(0 AS BIGINT) AS info, CAST(count(*) FILTER (severity = 'error') > 0 AS INTEGER) AS exit_code
FROM customer JOIN rule ON c_custkey % 8 = kind GROUP BY ALL""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity and the exit code of each document that has findings."""
    return rules.summarize(rules.finding_rows(corpus.customers(spark, sf_dir)))


@registered("""
SELECT c_custkey AS doc_id, '1.4' AS pdf_version, CAST(1 AS BIGINT) AS page_count, CAST(5 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER) - CAST(c_custkey % 8 = 2 AS INTEGER) AS INTEGER) AS object_count,
  CAST(1 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER) AS INTEGER) AS stream_count, CAST(6 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER) AS INTEGER) AS xref_entry_count, '1 0 R' AS root, false AS encrypted, CAST(0 AS INTEGER) AS incremental_update_count
FROM customer""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = relation(parse(corpus.customers(spark, sf_dir), "metadata"), "metadata")
    return meta.select("doc_id", "pdf_version", "page_count", "object_count", "stream_count", "xref_entry_count", "root", "encrypted", "incremental_update_count")


@registered("""
SELECT DISTINCT l_partkey AS doc_id, 100 + l_suppkey AS obj, CAST(0 AS INTEGER) AS gen FROM lineitem WHERE (100 + l_suppkey) % 3 <> 0""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_references(corpus.linked(spark, sf_dir))


@registered("SELECT l_orderkey AS doc_id, count(*) AS pages, count(*) AS page_count FROM lineitem GROUP BY 1")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found by walking the tree, beside what the root's count says."""
    parsed = parse(corpus.order_pages(spark, sf_dir), "metadata", "pages")
    return parsed.select("doc_id", F.size("pages").cast("long").alias("pages"), F.col("metadata.page_count").alias("page_count"))


@registered("""
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS INTEGER) AS page,
  CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 100 END::DOUBLE AS width, CASE WHEN l_linenumber % 2 = 1 THEN 70 ELSE 50 END::DOUBLE AS height, CAST(90 AS INTEGER) AS rotation
FROM lineitem""")
def pages_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and rotation of every page, its own or inherited."""
    pages = relation(parse(corpus.order_pages(spark, sf_dir), "pages"), "pages")
    return pages.select("doc_id", "page", "media_box.width", "media_box.height", "rotation")


TYPED = """
WITH k(event_type, number) AS (VALUES ('click', 10), ('error', 11), ('purchase', 12), ('signup', 13), ('view', 14)),
e AS (SELECT user_id AS doc_id, coalesce(number, 15) AS obj, ts, event_id FROM events LEFT JOIN k USING (event_type)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, obj ORDER BY ts DESC, event_id DESC) AS back FROM e)
"""


@registered(TYPED + "SELECT doc_id, CAST(obj AS BIGINT) AS obj, CAST(event_id AS DOUBLE) AS event FROM n WHERE back = 1")
def newest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of objects that incremental updates write again the newest version."""
    nodes = relation(parse(corpus.revisions(spark, sf_dir), "nodes"), "nodes")
    return nodes.filter("key = 'Event' and depth = 1").select("doc_id", "obj", F.col("num").alias("event"))


@registered("SELECT user_id AS doc_id, CAST(count(*) AS INTEGER) AS updates, CAST(6 + count(DISTINCT event_type) AS INTEGER) AS entries FROM events GROUP BY 1")
def incremental_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update sections, and entries that are left once newer ones have won."""
    meta = relation(parse(corpus.revisions(spark, sf_dir), "metadata"), "metadata")
    return meta.select("doc_id", F.col("incremental_update_count").alias("updates"), F.col("xref_entry_count").alias("entries"))


@registered("SELECT p_partkey AS doc_id, p_name AS name, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, CAST(6 AS BIGINT) AS container FROM part")
def object_stream_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside object streams, behind whatever filters."""
    parsed = parse(corpus.object_streams(spark, sf_dir), "nodes")
    own = F.filter("nodes", lambda n: (n["depth"] == 1) & n["container"].isNotNull())
    value = lambda key, column: F.get(F.filter("own", lambda n: n["key"] == key), 0)[column]
    members = parsed.select("doc_id", own.alias("own")).filter(F.size("own") > 0)
    return members.select("doc_id", value("Name", "str").alias("name"), value("Brand", "str").alias("brand"), value("Size", "num").alias("size"), F.array_max("own.container").alias("container"))


@registered("""
SELECT p_partkey AS doc_id, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'AHx' WHEN 3 THEN 'ASCII85Decode,Fl' ELSE 'RunLengthDecode' END AS filters,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 3 THEN 'decoded,decoded' ELSE 'decoded' END AS status,
  CAST(length('20 0 21 ' || (length(a) + 1) || ' ' || a || ' ' || b) AS BIGINT) AS decoded_length
FROM (SELECT *, '<< /Name (' || p_name || ') /Brand (' || p_brand || ') >>' AS a, '<< /Size ' || p_size || ' >>' AS b FROM part)""")
def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of each object stream, how each went, and how long the decoded bytes are."""
    streams = relation(parse(corpus.object_streams(spark, sf_dir), "streams"), "streams").filter("obj = 6")
    return streams.select("doc_id", F.array_join("filters", ",").alias("filters"), F.array_join("steps.status", ",").alias("status"), "decoded_length")


OPS = """
WITH k(event_type, name) AS (VALUES ('click', 'q'), ('error', 'ZZ'), ('purchase', 'BT'), ('signup', 'ET'), ('view', 'Q')),
o AS (SELECT user_id AS doc_id, event_id, coalesce(name, 'ZZ') AS name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i FROM events LEFT JOIN k USING (event_type))
"""


@registered(OPS + "SELECT doc_id, i, name, CAST(event_id AS VARCHAR) AS operands, name <> 'ZZ' AS known FROM o")
def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of content streams with their operands."""
    ops = relation(parse(corpus.event_content(spark, sf_dir), "operators"), "operators")
    from pagelode.functions.content import OPERATORS

    return ops.select("doc_id", "i", "name", F.array_join("operands", " ").alias("operands"), F.col("name").isin(*OPERATORS).alias("known"))


@registered(OPS + """
, d AS (SELECT *, sum(CASE name WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s,
  last_value(CASE WHEN name IN ('BT', 'ET') THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM o),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low,
  max(i) OVER (PARTITION BY doc_id) AS last, least(0, min(s) OVER (PARTITION BY doc_id)) AS floor FROM d),
w AS (
  SELECT doc_id, 'content.unknown_operator' AS rule_id FROM m WHERE name = 'ZZ'
  UNION ALL SELECT doc_id, 'content.nested_text_object' FROM m WHERE name = 'BT' AND t = 'BT'
  UNION ALL SELECT doc_id, 'content.unmatched_text_end' FROM m WHERE name = 'ET' AND coalesce(t, 'ET') = 'ET'
  UNION ALL SELECT doc_id, 'content.unmatched_graphics_restore' FROM m WHERE name = 'Q' AND s < coalesce(low, 0)
  UNION ALL SELECT doc_id, 'content.unclosed_text_object' FROM m WHERE i = last AND CASE WHEN name IN ('BT', 'ET') THEN name ELSE t END = 'BT'
  UNION ALL SELECT doc_id, 'content.unbalanced_graphics_state' FROM m WHERE i = last AND s > floor)
SELECT doc_id, rule_id, count(*) AS n FROM w GROUP BY ALL""")
def content_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with content streams, by rule."""
    warned = relation(parse(corpus.event_content(spark, sf_dir), "page_warnings"), "page_warnings")
    return warned.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


@registered("""
WITH u AS (SELECT n_regionkey AS r, unnest([n_nationkey, n_nationkey + 1]) AS k FROM nation)
SELECT DISTINCT CAST(r AS BIGINT) AS doc_id, 'page.missing_font_resource' AS rule_id, 'N' || k AS name FROM u WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r AND n_nationkey = k)
UNION ALL
SELECT DISTINCT CAST(r AS BIGINT), 'page.missing_xobject_resource', 'X' || k FROM u WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r AND n_nationkey = k AND k % 2 = 1)""")
def missing_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts and XObjects that content uses and resources don't define."""
    found = rules.findings(corpus.nations(spark, sf_dir)).filter(F.col("rule_id").startswith("page.missing_"))
    return found.select("doc_id", "rule_id", F.regexp_extract("message", r"/(\w+),", 1).alias("name"))


@registered("""
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(count(*) AS INTEGER) AS fonts, CAST(count(*) FILTER (n_nationkey % 2 = 1) AS INTEGER) AS xobjects, CAST(count(*) FILTER (n_nationkey % 2 = 1) AS INTEGER) AS images, CAST(1 AS INTEGER) AS contents
FROM nation GROUP BY 1""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(parse(corpus.nations(spark, sf_dir), "pages"), "pages").select("doc_id", "fonts", "xobjects", "images", "contents")


@registered("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '.' || c_mktsegment || '.c' || c_custkey AS name, CASE WHEN c_custkey % 2 = 1 THEN 'Tx' ELSE 'Btn' END AS field_type
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal form fields with their qualified names."""
    return relation(parse(corpus.forms(spark, sf_dir), "fields"), "fields").select("doc_id", "name", "field_type")


@registered("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name || '.' || c_mktsegment || '.c' || c_custkey), 'build') GROUP BY 1""")
def form_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = relation(parse(corpus.forms(spark, sf_dir), "fields"), "fields")
    return search.search_fields(fields, " BUILD ").groupBy("doc_id").agg(F.count("*").alias("n"))


RECTS = """
WITH a AS (SELECT l_suppkey AS doc_id, l_orderkey, l_linenumber AS n, l_quantity AS q, l_returnflag AS f,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) + 9 AS BIGINT) AS obj FROM lineitem)
"""


@registered(RECTS + """
SELECT doc_id, CAST(1 AS INTEGER) AS page, obj, CASE f WHEN 'R' THEN '/Link' ELSE '/Text' END AS subtype, CAST(n AS VARCHAR) AS flags, 'order ' || l_orderkey AS contents, '[4 item(s)]' AS rect FROM a""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(parse(corpus.annotated(spark, sf_dir), "annotations"), "annotations")
    return rows.select("doc_id", "page", "obj", "subtype", "flags", "contents", "rect")


@registered(RECTS + "SELECT doc_id, count(*) AS n FROM a WHERE contains('order ' || l_orderkey, 'order 7') GROUP BY 1")
def annotation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(parse(corpus.annotated(spark, sf_dir), "annotations"), "annotations")
    return search.search_annotations(rows, "Order 7").groupBy("doc_id").agg(F.count("*").alias("n"))


@registered(RECTS + """
, p AS (SELECT s_suppkey AS doc_id, CAST(s_suppkey % 30 AS DOUBLE) AS x, CAST(s_suppkey % 40 AS DOUBLE) AS y FROM supplier)
SELECT doc_id, x, y, arg_min(obj, (q * 2 * q, obj)) AS obj, min(q * 2 * q)::DOUBLE AS area FROM a JOIN p USING (doc_id) WHERE x BETWEEN n AND n + q AND y BETWEEN n AND n + 2 * q GROUP BY ALL""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a point on each document's page the smallest annotation rectangle that holds it."""
    s = corpus.table(spark, sf_dir, "supplier")
    points = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("s_suppkey") % 30).cast("double").alias("x"), (F.col("s_suppkey") % 40).cast("double").alias("y"))
    found = search.hit_test_annotations(parse(corpus.annotated(spark, sf_dir), "annotations"), points)
    return found.select("doc_id", "x", "y", "obj", F.round("area", 6).alias("area"))


@registered("SELECT s_suppkey AS doc_id, CAST(30 + i AS BIGINT) AS obj, '/Type /Extra' AS summary FROM supplier, range(5) t(i) WHERE i < s_suppkey % 5")
def orphaned_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the structure tree doesn't reach."""
    tree = relation(parse(corpus.suppliers(spark, sf_dir), "tree"), "tree")
    last = tree.filter("kind = 'orphaned_objects'").select("doc_id", F.col("path").alias("up"))
    return tree.join(last, "doc_id").filter((F.size("path") == 2) & (F.slice("path", 1, 1) == F.col("up"))).select("doc_id", "obj", "summary")


@registered("""
SELECT s_suppkey AS doc_id, CAST(20 + CASE WHEN s_suppkey % 5 > 0 THEN 1 + 2 * (s_suppkey % 5) ELSE 0 END AS BIGINT) - 3 AS nodes FROM supplier""")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the structure tree; extra objects count twice, as entries and as orphans."""
    return parse(corpus.suppliers(spark, sf_dir), "tree").select("doc_id", F.size("tree").cast("long").alias("nodes"))


@registered("SELECT s_suppkey AS doc_id, s_suppkey % 5 AS n FROM supplier WHERE s_suppkey % 5 > 0")
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes with all the words sought in them or above them."""
    tree = relation(parse(corpus.suppliers(spark, sf_dir), "tree"), "tree")
    return search.search_tree(tree, "extra ORPHANED").groupBy("doc_id").agg(F.count("*").alias("n"))


@registered("SELECT s_suppkey AS doc_id, CAST(30 + i AS BIGINT) AS obj, 'N,Name,Type' AS keys, s_name AS name, CAST(s_nationkey AS DOUBLE) AS n FROM supplier, range(5) t(i) WHERE i < s_suppkey % 5")
def object_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shredded dictionaries put together again by key."""
    nodes = relation(parse(corpus.suppliers(spark, sf_dir), "nodes"), "nodes").filter("obj >= 30 and depth = 1")
    value = lambda key, column: F.max(F.when(F.col("key") == key, F.col(column)))
    return nodes.groupBy("doc_id", "obj").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"), value("Name", "str").alias("name"), value("N", "num").alias("n"))


@registered("SELECT s_suppkey AS doc_id, CAST(5 + s_suppkey % 5 AS INTEGER) AS n_objects, CAST(s_suppkey AS DOUBLE) AS count, '/Edited' AS marked FROM supplier")
def edit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scalar edits of each document, read back from the bytes written."""
    docs = corpus.suppliers(spark, sf_dir)
    keys = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    edit = lambda n, obj, key, value: keys.select("doc_id", F.lit(n).alias("ord"), F.lit(obj).cast("long").alias("obj"), F.lit(0).alias("gen"), F.array(F.lit(key)).alias("path"), value.cast("string").alias("value"), F.lit(None).cast("string").alias("stream_text"))
    done = apply_edits(docs, edit(0, 2, "Count", F.col("doc_id")).unionByName(edit(1, 5, "BaseFont", F.lit("/Edited"))))
    nodes = relation(parse(done.select("doc_id", "content"), "nodes"), "nodes").filter("depth = 1")
    read = nodes.groupBy("doc_id").agg(F.max(F.when((F.col("obj") == 2) & (F.col("key") == "Count"), F.col("num"))).alias("count"), F.max(F.when((F.col("obj") == 5) & (F.col("key") == "BaseFont"), F.col("summary"))).alias("marked"))
    return done.select("doc_id", "n_objects").join(read, "doc_id")


# What the report of a document with each defect says after its head.
REPORTED = """
WITH reported(kind, title, lines, steps) AS (VALUES
  (0, NULL, [], ['- No diagnostics were emitted. Keep this report with the fixture for regression tracking.']),
  (1, 'Errors', ['- Object `99 0 R`: Referenced object 99 0 R was not found among parsed indirect objects'], ['- Check whether 99 0 R is absent, hidden in an object stream, or omitted from the xref table']),
  (2, 'Errors', ['- Object `5 0 R`: Xref entry for object 5 0 R points to byte 330, but that offset does not contain the expected object header Byte offset `330`.', '- Object `5 0 R`: Referenced object 5 0 R was not found among parsed indirect objects'], ['- Dump object 5 0 R and compare the xref offset against the raw file bytes', '- Check whether 5 0 R is absent, hidden in an object stream, or omitted from the xref table']),
  (3, 'Errors', ['- Object `6 0 R`: Stream 6 0 R filter /FlateDecode could not be decoded: Error -3 while decompressing data: incorrect header check Byte offset `446`.'], ['- Dump stream 6 0 R and verify the /Filter chain and encoded bytes']),
  (4, 'Warnings', ['- Page `1`: Object `3 0 R`: Page 1 content stream: Unknown or unsupported content stream operator `ZZ` at content byte range 21..23'], ['- Check whether the content stream contains a typo, unsupported extension, or corrupted operator bytes']),
  (5, 'Warnings', ['- Object `6 0 R`: Stream 6 0 R declares /Length 80, but 5 byte(s) were found before endstream Byte offset `426`.'], ['- Regenerate or inspect stream 6 0 R and verify the writer''s /Length calculation']),
  (6, 'Warnings', ['- Page `1`: Object `3 0 R`: Page 1 (3 0 R) has no /MediaBox and does not inherit one Byte offset `123`.'], ['- Add /MediaBox to the page or an ancestor /Pages node']),
  (7, 'Warnings', ['- Page `1`: Object `3 0 R`: Page 1 content stream: Content stream ended with 1 unmatched q graphics state save operator(s)'], ['- Add matching Q operators or inspect whether the content stream was truncated']))
"""


@registered(REPORTED + """
SELECT c_custkey AS doc_id, '## PDF Debug Report' || chr(10) || chr(10) || 'File: `' || c_custkey || '`' || chr(10) || 'PDF version: 1.4' || chr(10) || 'Pages: 1' || chr(10) || 'Encrypted: no' || chr(10) || 'Linearized: no' || chr(10)
  || 'Incremental updates: 0' || chr(10) || 'Objects: ' || (5 + CAST(kind IN (3, 5) AS INTEGER) - CAST(kind = 2 AS INTEGER)) || chr(10) || 'Streams: ' || (1 + CAST(kind IN (3, 5) AS INTEGER)) || chr(10) || chr(10)
  || coalesce('### ' || title || chr(10) || chr(10) || array_to_string(lines, chr(10)) || chr(10) || chr(10), '')
  || '### Suggested Next Steps' || chr(10) || chr(10) || array_to_string(steps, chr(10)) || chr(10) AS report
FROM customer JOIN reported ON c_custkey % 8 = kind""")
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reports of all documents, with and without findings."""
    return reports.markdown_reports(rules.finding_rows(corpus.customers(spark, sf_dir)))


@registered(DEFECTS + """
SELECT c_custkey AS doc_id, '0.1.0' AS schema_version, count(*) FILTER (severity = 'error') AS errors, count(kind) AS findings, min(rule_id) AS first_rule FROM customer LEFT JOIN rule ON c_custkey % 8 = kind GROUP BY 1""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports, read back."""
    texts = reports.json_reports(rules.finding_rows(corpus.customers(spark, sf_dir)))
    shape = "schema_version string, diagnostics struct<errors:long>, findings array<struct<rule_id:string>>"
    back = texts.select("doc_id", F.from_json("report", shape).alias("r"))
    return back.select("doc_id", "r.schema_version", "r.diagnostics.errors", F.size("r.findings").cast("long").alias("findings"), F.array_min("r.findings.rule_id").alias("first_rule"))


@registered("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, CAST(ceil(length(coalesce(text, '')) / 200.0) AS BIGINT) AS runs FROM documents")
def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each document, put together again from the runs its page shows; a null text has none."""
    parsed = parse(corpus.texts(spark, sf_dir), "text_runs")
    return parsed.select("doc_id", F.md5(F.array_join("text_runs.text", "").cast("binary")).alias("text_md5"), F.size("text_runs").cast("long").alias("runs"))


@registered("""
WITH u AS (SELECT CAST(n_regionkey AS BIGINT) AS r, unnest([n_nationkey, n_nationkey + 1]) AS k FROM nation)
SELECT r AS doc_id, count(*) FILTER (own) AS images, count(*) FILTER (NOT own) AS missing FROM
  (SELECT r, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r AND n_nationkey = k AND k % 2 = 1) AS own FROM u) GROUP BY 1""")
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that pages paint, and names they paint that no resource has."""
    parsed = parse(corpus.nations(spark, sf_dir), "page_objects", "page_object_warnings")
    images = F.size(F.filter("page_objects", lambda o: o["kind"] == "image")).cast("long")
    return parsed.select("doc_id", images.alias("images"), F.size("page_object_warnings").cast("long").alias("missing"))


@registered("""
SELECT p_partkey AS doc_id, '1.4' AS pdf_version, CAST(1 AS BIGINT) AS page_count, CAST(6 AS INTEGER) AS object_count, CAST(7 AS INTEGER) AS xref_entry_count, '1 0 R' AS root, false AS has_object_stream FROM part""")
def lazy_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the head, the tail and the table say without parsing any stream; members of object streams don't count."""
    got = parse_lazy(corpus.object_streams(spark, sf_dir), "metadata").select("doc_id", "metadata.*")
    return got.select("doc_id", "pdf_version", "page_count", "object_count", "xref_entry_count", "root", "has_object_stream")


@registered("""
SELECT rule_id, count(*) AS n FROM (
  SELECT 'lazy.deep_diagnostics_deferred' AS rule_id FROM customer
  UNION ALL SELECT 'lazy.page_link_missing_from_xref' FROM customer WHERE c_custkey % 8 = 1
  UNION ALL SELECT 'lazy.object_parse_failed' FROM customer WHERE false) GROUP BY 1""")
def lazy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the fast rules, which read no stream."""
    got = parse_lazy(corpus.customers(spark, sf_dir), "findings")
    return got.select(F.explode("findings.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


@registered("SELECT l_orderkey AS doc_id, count(*) AS pages, true AS same FROM lineitem GROUP BY 1")
def lazy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by ranges are the pages of the full parse."""
    docs = corpus.order_pages(spark, sf_dir)
    lazy = parse_lazy(docs, "pages").select("doc_id", F.col("pages").alias("lazily"))
    return lazy.join(parse(docs, "pages"), "doc_id").select("doc_id", F.size("lazily").cast("long").alias("pages"), (F.col("lazily") == F.col("pages")).alias("same"))


@registered("""
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS width, CAST(1 AS INTEGER) AS height, false AS renderable, CAST(2 AS BIGINT) AS missing_keys FROM region""")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image streams, whether their samples can be shown, and required keys they lack."""
    parsed = parse(corpus.nations(spark, sf_dir), "images", "streams")
    missing = F.aggregate("streams", F.lit(0).cast("long"), lambda n, s: n + F.size(s["image_missing"]))
    return parsed.select("doc_id", F.explode("images").alias("i"), missing.alias("missing_keys")).select("doc_id", "i.width", "i.height", "i.renderable", "missing_keys")


FAULTS = """
WITH rule(kind, rule_id, severity, n) AS (VALUES
  (0, 'page_tree.missing_catalog', 'error', 1), (1, 'page_tree.invalid_catalog_reference', 'error', 1), (2, 'page_tree.missing_pages', 'error', 1),
  (3, 'page_tree.invalid_pages_reference', 'error', 1), (4, 'page_tree.cyclic_reference', 'error', 1), (5, 'page_tree.missing_node', 'error', 1),
  (5, 'object.missing_reference', 'error', 1), (6, 'page_tree.node_not_dictionary', 'error', 1), (7, 'page_tree.pages_without_kids', 'error', 1),
  (8, 'page_tree.invalid_kid_reference', 'error', 1), (9, 'page_tree.invalid_node_type', 'error', 1), (10, 'document.encryption_detected', 'warning', 1),
  (11, 'document.object_stream_detected', 'info', 1), (12, 'document.xref_stream_detected', 'info', 1), (13, 'stream.unsupported_filter', 'warning', 1),
  (14, 'image.missing_required_key', 'warning', 3), (15, 'document.incremental_updates_detected', 'info', 1), (16, 'parse.warning', 'warning', 1))
"""
LAZY_FAULTS = """
WITH rule(kind, rule_id, severity) AS (VALUES
  (0, 'lazy.page_tree.root_missing', 'warning'), (0, 'lazy.root_missing', 'error'), (1, 'lazy.page_tree.pages_missing', 'warning'), (2, 'lazy.page_tree.pages_missing', 'warning'),
  (3, 'lazy.page_tree.pages_missing', 'warning'), (4, 'lazy.page_tree.cycle', 'warning'), (5, 'lazy.page_tree.object_unavailable', 'warning'),
  (6, 'lazy.page_tree.non_dictionary', 'warning'), (7, 'lazy.page_tree.kids_missing', 'warning'), (8, 'lazy.page_tree.invalid_kid', 'warning'),
  (9, 'lazy.page_tree.unexpected_type', 'warning'), (10, 'document.encryption_detected', 'warning'), (15, 'document.incremental_updates_detected', 'info'),
  (16, 'lazy.header_missing', 'warning'), (17, 'lazy.page_tree.depth_limit', 'warning'))
, f AS (SELECT c_custkey AS doc_id, rule_id, severity FROM customer JOIN rule ON c_custkey % 18 = kind
  UNION ALL SELECT c_custkey, 'lazy.deep_diagnostics_deferred', 'info' FROM customer)
"""


@registered(FAULTS + "SELECT c_custkey AS doc_id, rule_id, severity, CAST(n AS BIGINT) AS n FROM customer JOIN rule ON c_custkey % 18 = kind")
def faults_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents with one fault each of the page tree, the document, its streams or its head."""
    return rules.findings(corpus.faulty(spark, sf_dir)).groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@registered(LAZY_FAULTS + "SELECT doc_id, rule_id, severity FROM f")
def lazy_faults_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the fast rules, those of the page index among them."""
    got = parse_lazy(corpus.faulty(spark, sf_dir), "findings")
    return got.select("doc_id", F.inline("findings")).select("doc_id", "rule_id", "severity")


@registered(LAZY_FAULTS + """
SELECT doc_id, 'lazy_fast_diagnostics' AS report_kind, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info,
  CAST(6 AS INTEGER) AS deferred, 'Scope: fast diagnostics only' AS scope, CAST(5 + CAST(doc_id % 18 = 0 AS INTEGER) + CAST(doc_id % 18 NOT IN (11, 12, 13, 14, 15) AS INTEGER) AS INTEGER) AS sections
FROM f GROUP BY doc_id""")
def lazy_report_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy reports, read back: counts by severity from the JSON, scope and sections from the Markdown."""
    made = lazy_reports(corpus.faulty(spark, sf_dir))
    shape = "report_kind string, diagnostics struct<errors:long,warnings:long,info:long>, deferred_deep_diagnostics array<string>"
    back = made.select("doc_id", "markdown", F.from_json("report", shape).alias("r"))
    return back.select("doc_id", "r.report_kind", "r.diagnostics.*", F.size("r.deferred_deep_diagnostics").alias("deferred"), F.regexp_extract("markdown", "(?m)^(Scope: .*)$", 1).alias("scope"), F.regexp_count("markdown", F.lit("(?m)^### ")).alias("sections"))


@registered(LAZY_FAULTS + "SELECT doc_id, min(rule_id) AS rule_id FROM f WHERE rule_id LIKE 'lazy.page_tree.%' OR rule_id = 'lazy.header_missing' GROUP BY 1")
def lazy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening and the page walk of a lazy document warn of."""
    return parse_lazy(corpus.faulty(spark, sf_dir), "notes").select("doc_id", F.inline("notes")).select("doc_id", "rule_id")


@registered(ORACLES["content_warnings"].replace("SELECT doc_id, rule_id, count(*) AS n FROM w", "SELECT doc_id, 'lazy.deep.' || rule_id AS rule_id, count(*) AS n FROM w"))
def deep_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep diagnostics of the first page of each document, by rule."""
    docs = corpus.event_content(spark, sf_dir)
    targets = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit("page").alias("kind"), F.lit(1).alias("number"), F.lit(0).alias("gen")).distinct()
    found = deep_diagnostics(docs, targets).select("doc_id", F.inline("findings"))
    return found.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


@registered("""
SELECT s_suppkey AS doc_id, 'object' AS scope, 'Object 2 0 R' AS target, '1' AS referenced, false AS partial FROM supplier
UNION ALL SELECT s_suppkey, 'stream', 'Stream 4 0 R', NULL, false FROM supplier""")
def deep_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep diagnostics of a page tree node and of a content stream of each document."""
    docs = corpus.suppliers(spark, sf_dir)
    keys = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    ask = lambda kind, number: keys.select("doc_id", F.lit(kind).alias("kind"), F.lit(number).alias("number"), F.lit(0).alias("gen"))
    got = deep_diagnostics(docs, ask("object", 2).unionByName(ask("stream", 4)))
    referenced = F.get(F.filter("details", lambda d: d["name"] == "Referenced objects"), 0)["value"]
    return got.select("doc_id", "scope", "target", referenced.alias("referenced"), "partial")


@registered(OPS + """
, t AS (SELECT doc_id, string_agg(event_id || ' ' || name, chr(10) ORDER BY i) AS content FROM o GROUP BY 1)
SELECT doc_id, CAST(length(content) AS BIGINT) AS actual_length, CAST(length(content) AS BIGINT) AS decoded_length, content AS preview, CAST(0 AS INTEGER) AS warnings, true AS can_export FROM t""")
def lazy_stream_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content streams read by ranges, with their previews."""
    views = parse_lazy(corpus.event_content(spark, sf_dir), "stream_views").select("doc_id", F.inline("stream_views"))
    return views.select("doc_id", "actual_length", "decoded_length", F.col("decoded_preview").cast("string").alias("preview"), F.size("warnings").alias("warnings"), (F.col("can_export_raw") & F.col("can_export_decoded")).alias("can_export"))


@registered("SELECT c_custkey AS doc_id, CAST(11 AS INTEGER) AS nodes, 'lazy open, ' || (6 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER)) || ' xref entrie(s), ' || (5 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER)) || ' in-use object(s)' AS summary FROM customer WHERE c_custkey % 8 NOT IN (3, 5)"
            " UNION ALL SELECT c_custkey, 12, 'lazy open, 7 xref entrie(s), 6 in-use object(s)' FROM customer WHERE c_custkey % 8 IN (3, 5)")
def lazy_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first look at each document: trailer, catalog and entries."""
    got = parse_lazy(corpus.customers(spark, sf_dir), "tree")
    return got.select("doc_id", F.size("tree").alias("nodes"), F.col("tree")[0]["summary"].alias("summary"))


@registered("""
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, '/X' || n_nationkey || ' Image' AS label, CAST(6 AS BIGINT) AS obj FROM nation WHERE n_nationkey % 2 = 1""")
def page_link_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages that a search finds by label or number."""
    links = relation(parse(corpus.nations(spark, sf_dir), "page_links"), "page_links")
    return search.search_page_links(links, " image 6 0 ").select("doc_id", "label", "obj")


@registered(RECTS + """
, w AS (SELECT doc_id, obj, n::DOUBLE AS x, q FROM a)
SELECT doc_id, obj, round(x / 200 * 100, 9) AS "left", round(100 - (x + 2 * q) / 200 * 100, 9) AS top, round(greatest(1, q / 200 * 100), 9)::DOUBLE AS width, round(greatest(1, 2 * q / 200 * 100), 9)::DOUBLE AS height FROM w""")
def annotation_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where annotations lie on their page, in per cent from the top left."""
    parsed = parse(corpus.annotated(spark, sf_dir), "annotations", "pages").select("doc_id", "pages", F.explode("annotations").alias("a"))
    place = search.overlay(F.col("a"), F.get(F.filter("pages", lambda p: p["page"] == F.col("a.page")), 0)["media_box"])
    rows = parsed.select("doc_id", "a.obj", place.alias("p"))
    return rows.select("doc_id", "obj", F.round("p.left", 9).alias("left"), F.round("p.top", 9).alias("top"), F.round("p.width", 9).alias("width"), F.round("p.height", 9).alias("height"))


@registered(RECTS + "SELECT doc_id, obj, 'order ' || l_orderkey AS contents FROM a WHERE obj BETWEEN 20 AND 29")
def annotation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each document's list of annotations: ten from the eleventh."""
    rows = relation(parse(corpus.annotated(spark, sf_dir), "annotations"), "annotations")
    return search.window(rows, ["doc_id"], "ord", 10, 10).select("doc_id", "obj", "contents")


@registered("SELECT s_suppkey AS doc_id, '1,0,0,0,0,0' AS path FROM supplier")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first node of each document's tree stands that stands for its font."""
    tree = relation(parse(corpus.suppliers(spark, sf_dir), "tree"), "tree")
    return search.find_path(tree, 5, 0).select("doc_id", F.array_join("path", ",").alias("path"))


@registered(OPS + "SELECT doc_id, kind, count(*) AS n FROM o, (VALUES ('keyword'), ('number')) k(kind) GROUP BY ALL")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of content streams by kind."""
    tokens = relation(parse(corpus.event_content(spark, sf_dir), "tokens"), "tokens")
    return tokens.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@registered("""
WITH r AS (SELECT user_id, event_type || '.PDF' AS path, max(ts) AS opened_at FROM events WHERE event_type <> 'view' GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY opened_at DESC, path) AS INTEGER) AS place FROM r)
SELECT user_id, path, place FROM p WHERE place <= 3""")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each user opened last; what is no PDF doesn't count."""
    events = corpus.table(spark, sf_dir, "events")
    opened = events.select("user_id", F.concat("event_type", F.when(F.col("event_type") == "view", ".txt").otherwise(".PDF")).alias("path"), F.col("ts").alias("opened_at"))
    return search.recent_files(opened, ["user_id"], 3).select("user_id", "path", "place")


@registered("""
WITH t AS (SELECT doc_id, substr(repeat(chr(1), doc_id % 40) || coalesce(text, ''), 1, 8192) AS s, least(doc_id % 40, 8192) AS odd FROM documents)
SELECT doc_id, odd > 24 OR odd > 0.02 * length(s) AS is_binary FROM t""")
def binary_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which previews are no text; each document's text is led in by some control characters."""
    docs = corpus.table(spark, sf_dir, "documents")
    text = F.concat(F.repeat(F.lit(chr(1)), (F.col("doc_id") % 40).cast("int")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", search.looks_binary(text).alias("is_binary"))


@registered("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT n_regionkey, 'N' || unnest([n_nationkey, n_nationkey + 1]) AS k FROM nation) GROUP BY 1")
def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts that a page has or uses, each once."""
    checks = relation(parse(corpus.nations(spark, sf_dir), "page_checks"), "page_checks")
    return checks.select("doc_id", F.array_join(F.sort_array(search.merged(F.col("fonts"), F.col("fonts_used"))), ",").alias("names"))


@registered("""
SELECT s_suppkey AS doc_id, CAST(4 AS INTEGER) AS object_count, s_suppkey % 5 = 0 AS linearized, CASE WHEN s_suppkey % 5 <> 2 THEN '1 0 R' END AS root,
  CAST(CASE s_suppkey % 5 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS warnings FROM supplier""")
def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found without a usable table, by scanning for sections or for objects."""
    meta = relation(parse(corpus.damaged(spark, sf_dir), "metadata"), "metadata")
    return meta.select("doc_id", "object_count", "linearized", "root", F.col("parse_warning_count").alias("warnings"))


@registered("""
SELECT c_custkey AS doc_id, CAST(5 + CAST(c_custkey % 8 IN (3, 5) AS INTEGER) - CAST(c_custkey % 8 = 2 AS INTEGER) AS INTEGER) AS object_count,
  CASE WHEN c_custkey % 8 = 2 THEN 'Skipped 1 in-use xref object(s) whose offsets did not resolve to the expected object' END AS warning FROM customer""")
def skipped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading mode that skips entries whose offsets fail."""
    parsed = parse(corpus.customers(spark, sf_dir), "metadata", "warnings", gui=True)
    return parsed.select("doc_id", "metadata.object_count", F.get("warnings", 0)["message"].alias("warning"))


@registered("""
SELECT p_partkey AS doc_id, '1 0 R' AS root, true AS has_xref_stream, true AS has_object_stream, 'P' || p_partkey AS font, CAST(1 AS BIGINT) AS page_count FROM part""")
def xref_stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose table is a stream, or a stream beside a classic table."""
    parsed = parse(corpus.compressed(spark, sf_dir), "metadata", "nodes")
    font = F.get(F.filter("nodes", lambda n: (n["key"] == "BaseFont") & (n["container"] == 6)), 0)["str"]
    return parsed.select("doc_id", "metadata.root", "metadata.has_xref_stream", "metadata.has_object_stream", font.alias("font"), "metadata.page_count")


@registered("""
SELECT p_partkey AS doc_id, CAST(5 AS BIGINT) AS obj, CAST(6 AS BIGINT) AS container, 'Dictionary' AS value_type, '/Type /Font, /Subtype /Type1' AS summary, CAST(-1 AS BIGINT) AS stream_length FROM part
UNION ALL SELECT p_partkey, 6, -1, 'Dictionary', '/Type /ObjStm, stream ' || (49 + length('P' || p_partkey)) || ' byte(s)', 49 + length('P' || p_partkey) FROM part""")
def lazy_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects looked up by their entries, one of them inside an object stream."""
    rows = parse_lazy(corpus.compressed(spark, sf_dir), "objects").select("doc_id", F.inline("objects")).filter("obj in (5, 6)")
    return rows.select("doc_id", "obj", F.coalesce("container", F.lit(-1).cast("long")).alias("container"), "value_type", "summary", F.coalesce("stream_length", F.lit(-1).cast("long")).alias("stream_length"))


@registered("SELECT c_custkey AS doc_id, '(' || c_name || ')' AS creator, 'A B' AS marked FROM customer")
def info_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text strings in three encodings, and names with escapes."""
    parsed = parse(corpus.titled(spark, sf_dir), "metadata", "nodes")
    marked = F.get(F.filter("nodes", lambda n: n["key"] == "Marked"), 0)["str"]
    return parsed.select("doc_id", F.col("metadata.info_summary")["Creator"].alias("creator"), marked.alias("marked"))


@registered("""
WITH p AS (SELECT s_suppkey AS doc_id, CAST(s_suppkey % 30 AS DOUBLE) AS x, CAST(s_suppkey % 40 AS DOUBLE) AS y, CAST(s_nationkey + 1 AS DOUBLE) AS w FROM supplier)
SELECT doc_id, 'page-1-xobject-1' AS id, 'image' AS kind, x AS llx, y AS lly, x + w AS urx, y + 2 * w AS ury, CAST(NULL AS VARCHAR) AS parent FROM p
UNION ALL SELECT doc_id, 'page-1-path-2', 'path', x, y, x + w, y + 2 * w, NULL FROM p
UNION ALL SELECT doc_id, 'page-1-xobject-3', 'form', x + 3, y + 4, x + 103, y + 104, NULL FROM p
UNION ALL SELECT doc_id, 'page-1-path-4', 'path', x + 3, y + 4, x + 13, y + 14, '/Fm1 8 0 R' FROM p""")
def painted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where images, paths and what forms draw lie on the page; resources come from the page's parent."""
    shown = relation(parse(corpus.painted(spark, sf_dir), "page_objects"), "page_objects")
    parent = F.get(F.filter("properties", lambda p: p["name"] == "Parent form"), 0)["value"]
    return shown.select("doc_id", "id", "kind", "llx", "lly", "urx", "ury", parent.alias("parent"))


@registered("""
SELECT p_partkey AS doc_id, 'A€C' AS text, CAST(p_partkey % 50 AS DOUBLE) AS llx, round(p_partkey % 50 + (2.1 - (p_partkey % 100) / 1000) * p_size, 6)::DOUBLE AS urx, 7.0::DOUBLE AS lly, 7.0 + p_size::DOUBLE AS ury, '/WinAnsiEncoding with Differences' AS encoding, '/Widths from FirstChar 65' AS widths FROM part""")
def text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of shown text from glyph widths, kerning and size, and its encoding."""
    shown = relation(parse(corpus.measured(spark, sf_dir), "page_objects"), "page_objects")
    told = lambda name: F.get(F.filter("properties", lambda p: p["name"] == name), 0)["value"]
    return shown.select("doc_id", "text", "llx", F.round("urx", 6).alias("urx"), "lly", "ury", told("Encoding source").alias("encoding"), told("Width source").alias("widths"))


@registered("""
SELECT s_suppkey AS doc_id, CAST(3 AS BIGINT) AS obj, 'dictionary' AS object_type, 'Contents,Parent,Resources,Type' AS keys, '2,4,5' AS refs, CAST(-1 AS BIGINT) AS decoded_length FROM supplier
UNION ALL SELECT s_suppkey, 4, 'stream', 'Length', '', 23 FROM supplier""")
def object_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a single object is, holds and names."""
    rows = relation(parse(corpus.suppliers(spark, sf_dir), "inspections"), "inspections").filter("obj in (3, 4)")
    return rows.select("doc_id", "obj", "object_type", F.array_join(F.sort_array("keys"), ",").alias("keys"), F.array_join(F.transform("references", lambda r: r["obj"].cast("string")), ",").alias("refs"), F.coalesce("decoded_length", F.lit(-1).cast("long")).alias("decoded_length"))


@registered("""
SELECT s_suppkey AS doc_id, '5 0 obj' || chr(10) || '<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>' || chr(10) || 'endobj' AS raw, 'BT /F1 12 Tf (Hi) Tj ET' AS decoded,
  '00000000  42 54 20 2f 46 31 20 31  32 20 54 66 20 28 48 69  BT /F1 12 Tf (Hi' || chr(10) || '00000010  29 20 54 6a 20 45 54                              ) Tj ET' || chr(10) AS hex FROM supplier""")
def object_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text of an object, and a stream in hex and decoded."""
    parsed = parse(corpus.suppliers(spark, sf_dir), "previews")
    of = lambda obj: F.get(F.filter("previews", lambda p: p["obj"] == obj), 0)
    return parsed.select("doc_id", of(5)["raw"].alias("raw"), of(4)["decoded"].alias("decoded"), of(4)["hex"].alias("hex"))


@registered(OPS + """
SELECT doc_id, name, CASE name WHEN 'q' THEN 'Save graphics state' WHEN 'Q' THEN 'Restore graphics state' WHEN 'BT' THEN 'Begin a text object' WHEN 'ET' THEN 'End a text object' ELSE 'Unknown PDF content stream operator' END AS explanation,
  count(*) AS n, CAST(count(*) AS BIGINT) AS operands FROM o GROUP BY ALL""")
def content_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of content streams with what they do."""
    rows = relation(parse(corpus.event_content(spark, sf_dir), "content_views"), "content_views")
    return rows.groupBy("doc_id", "name", "explanation").agg(F.count("*").alias("n"), F.sum("operands").alias("operands"))


@registered("SELECT doc_id, 'BT (doc ' || doc_id || ') Tj ET' AS content, 'FlateDecode' AS filters, true AS same_length FROM documents")
def stream_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contents for compressed streams, read back from the bytes written."""
    docs = corpus.texts(spark, sf_dir)
    keys = corpus.table(spark, sf_dir, "documents").select("doc_id")
    new = F.concat(F.lit("BT (doc "), F.col("doc_id").cast("string"), F.lit(") Tj ET"))
    edits = keys.select("doc_id", F.lit(0).alias("ord"), F.lit(4).cast("long").alias("obj"), F.lit(0).alias("gen"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("value"), new.alias("stream_text"))
    parsed = parse(apply_edits(docs, edits).select("doc_id", "content"), "stream_bytes", "streams")
    own = lambda part: F.get(F.filter(part, lambda x: x["obj"] == 4), 0)
    return parsed.select("doc_id", own("stream_bytes")["decoded"].cast("string").alias("content"), F.array_join(own("streams")["filters"], ",").alias("filters"), (own("streams")["declared_length"] == own("streams")["actual_length"]).alias("same_length"))


@registered("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 4 = 3 THEN 'image/jpeg' ELSE 'image/png' END AS media, CASE WHEN n_nationkey % 4 = 3 THEN 'passthrough' ELSE '' END AS status,
  CASE n_nationkey % 4 WHEN 0 THEN printf('%02X%02X%02X', n_nationkey, n_nationkey, n_nationkey) WHEN 1 THEN printf('%02X%02X%02X', n_nationkey, 2 * n_nationkey, 3 * n_nationkey)
    WHEN 2 THEN printf('%02X%02X%02X', 255 - least(255, n_nationkey + 200), 255 - least(255, 2 * n_nationkey + 200), 255 - least(255, 3 * n_nationkey + 200)) END AS rgb FROM nation""")
def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as they can be shown: RGB samples of three colour spaces, JPEG data as it stands."""
    parsed = parse(corpus.pictures(spark, sf_dir), "image_previews", "streams")
    status = F.array_join(F.get(F.filter("streams", lambda s: s["obj"] == 6), 0)["steps"]["status"], ",")
    return parsed.select("doc_id", F.explode("image_previews").alias("i"), status.alias("status")).select("doc_id", "i.media", "status", F.hex("i.rgb").alias("rgb"))


@registered("SELECT c_custkey AS doc_id, regexp_replace(c_name || ' /' || c_mktsegment, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM customer")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from any text."""
    c = corpus.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"), safe_text(F.concat("c_name", F.lit(" /"), "c_mktsegment")).alias("name"))


@registered("""
WITH v AS (SELECT c_custkey, c_name, c_custkey % 7 AS k FROM customer)
SELECT c_custkey AS doc_id, CASE k WHEN 0 THEN 'Number' WHEN 1 THEN 'String' WHEN 2 THEN 'Name' END AS type, CASE WHEN k > 2 THEN true ELSE false END AS refused FROM v""")
def edit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values an edit may write: numbers, strings and names, one at a time."""
    key, name = F.col("c_custkey"), F.col("c_name")
    made = F.array(key.cast("string"), F.concat(F.lit("("), name, F.lit(")")), F.concat(F.lit("/N"), key), F.concat(F.lit("["), key, F.lit("]")), F.concat(key, F.lit(" 0 R")), F.lit("true"), F.concat(key, F.lit(" "), key))
    rows = corpus.table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.get(made, (key % 7).cast("int")).alias("value"))
    checked = check_values(rows.select("value").distinct())
    return rows.join(checked, "value").select("doc_id", "type", F.col("error").isNotNull().alias("refused"))


@registered("""
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(256 AS BIGINT) AS xref_children, CAST(8 AS INTEGER) AS next_steps, CAST(12 AS INTEGER) AS findings, 'More xref objects' AS last_lazy_node, CAST(1 AS INTEGER) AS stream_limits FROM region""")
def limited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of trees, reports and fast checks, on documents beyond them."""
    docs = corpus.wide(spark, sf_dir)
    parsed = parse(docs, "tree").select("doc_id", F.size(F.filter("tree", lambda n: n["summary"].startswith("offset "))).cast("long").alias("xref_children"))
    rows = rules.finding_rows(docs)
    made = reports.markdown_reports(rows).join(rows.select("doc_id", F.size(F.filter("found", lambda f: f["rule_id"] == "page.missing_mediabox")).alias("findings")), "doc_id")
    steps = F.regexp_count(F.substring_index("report", "### Suggested Next Steps", -1), F.lit("(?m)^- ")).alias("next_steps")
    lazy = parse_lazy(docs, "tree", "findings").select("doc_id", F.element_at("tree", -1)["label"].alias("last_lazy_node"), F.size(F.filter("findings", lambda f: f["rule_id"] == "lazy.fast_stream_metadata_limit")).alias("stream_limits"))
    return parsed.join(made.select("doc_id", "findings", steps), "doc_id").join(lazy, "doc_id").select("doc_id", "xref_children", "next_steps", "findings", "last_lazy_node", "stream_limits")


@registered("""
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, true AS partial, 'Only the first 4 content stream(s) were analyzed for this page; 596 additional stream(s) were skipped.' AS limitation FROM region""")
def deep_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep diagnostics of a page with more content streams than they look at."""
    targets = corpus.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("page").alias("kind"), F.lit(1).alias("number"), F.lit(0).alias("gen"))
    got = deep_diagnostics(corpus.wide(spark, sf_dir), targets)
    return got.select("doc_id", "partial", F.element_at("limitations", -1).alias("limitation"))


@registered("""
SELECT s_suppkey AS doc_id, CAST(2 AS INTEGER) AS enrichments, 'Scope: fast diagnostics plus selected target enrichments' AS scope, '#### Object 1 0 R (object),#### Page 1 (page)' AS titles FROM supplier""")
def enriched_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy reports with deep diagnostics of chosen targets; targets that aren't there are left out."""
    keys = corpus.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    ask = lambda kind, number: keys.select("doc_id", F.lit(kind).alias("kind"), F.lit(number).alias("number"), F.lit(0).alias("gen"))
    made = lazy_reports(corpus.suppliers(spark, sf_dir), ask("page", 1).unionByName(ask("object", 1)).unionByName(ask("object", 999)))
    back = F.from_json("report", "enrichments array<struct<scope:string>>")["enrichments"]
    return made.select("doc_id", F.size(back).alias("enrichments"), F.regexp_extract("markdown", "(?m)^(Scope: .*)$", 1).alias("scope"), F.array_join(F.regexp_extract_all("markdown", F.lit("(?m)^(#### .*)$"), F.lit(1)), ",").alias("titles"))


@registered("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, kind, n FROM nation, (VALUES ('comment', 1::BIGINT), ('array_start', 1), ('number', 2), ('string', 1), ('hex_string', 1), ('array_end', 1), ('dictionary_start', 1), ('name', 2), ('keyword', 2), ('dictionary_end', 1), ('other', 2)) t(kind, n)""")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of token that content streams have."""
    tokens = relation(parse(corpus.odd_content(spark, sf_dir), "tokens"), "tokens")
    return tokens.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@registered("""
WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '.' || c_mktsegment || '.c' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lower(name)) - 1 AS INTEGER) AS ord FROM f""")
def ordered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each form field in its document's list."""
    return relation(parse(corpus.forms(spark, sf_dir), "fields"), "fields").select("doc_id", "name", "ord")


@registered(RECTS + "SELECT doc_id, obj, CAST(obj - 10 AS INTEGER) AS ord FROM a")
def ordered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each annotation in its document's list."""
    return relation(parse(corpus.annotated(spark, sf_dir), "annotations"), "annotations").select("doc_id", "obj", "ord")

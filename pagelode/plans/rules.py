"""Diagnostics: each rule is an expression over the array columns that parse() gives a document.

The findings of a document are put together inside its row and exploded once at
the end, so no rule needs a shuffle. All findings have COLUMNS; ord sorts those of
a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.content import CHECKS, OPERATORS
from pagelode.operators.relations import parse

COLUMNS = ["doc_id", "ord", "rule_id", "severity", "message", "obj", "gen", "page", "byte_offset", "suggested_next_step"]
PARTS = ("metadata", "warnings", "xref", "index", "targets", "streams", "tree_problems", "page_checks", "page_warnings")

# Severity, message and next step of each rule; {} are columns.
TEXTS = {
    "parse.warning": ("warning", "{message}", "Open the file in inspect mode and verify the PDF header, xref table, and trailer"),
    "document.encryption_detected": ("warning", "The trailer contains /Encrypt; encrypted content may not be inspectable without credentials", "Reproduce with an unencrypted fixture when possible, or provide credentials to downstream tools"),
    "document.incremental_updates_detected": ("info", "Detected {incremental_update_count} incremental update section(s)", "Check whether the issue reproduces before and after the incremental update section"),
    "document.object_stream_detected": ("info", "Object stream detected; Milestone 1 reports it but does not decompress object streams", "Use a later parser milestone or an external decompressor to inspect compressed object members"),
    "document.xref_stream_detected": ("info", "Xref stream detected; Milestone 1 reports it but targets classic xref tables", "Save or regenerate a classic-xref fixture when possible, or inspect with a parser that expands xref streams"),
    "xref.invalid_offset": ("error", "Xref entry for object {ref} points to byte {byte_offset}, but that offset does not contain the expected object header", "Dump object {ref} and compare the xref offset against the raw file bytes"),
    "object.missing_reference": ("error", "Referenced object {ref} was not found among parsed indirect objects", "Check whether {ref} is absent, hidden in an object stream, or omitted from the xref table"),
    "stream.length_mismatch": ("warning", "Stream {ref} declares /Length {declared_length}, but {actual_length} byte(s) were found before endstream", "Regenerate or inspect stream {ref} and verify the writer's /Length calculation"),
    "stream.decode_failed": ("error", "Stream {ref} filter /{filter} could not be decoded: {issue}", "Dump stream {ref} and verify the /Filter chain and encoded bytes"),
    "stream.unsupported_filter": ("warning", "Stream {ref} filter /{filter} could not be decoded: {issue}", "Dump stream {ref} and verify the /Filter chain and encoded bytes"),
    "image.missing_required_key": ("warning", "Image stream {ref} is missing /{missing}", "Verify the image XObject dictionary written by the PDF generator"),
    "page_tree.missing_catalog": ("error", "Trailer does not contain a /Root catalog reference", "Verify the trailer dictionary and root catalog object"),
    "page_tree.invalid_catalog_reference": ("error", "Root catalog reference {ref} does not resolve to a dictionary", "Check the trailer /Root entry and referenced object"),
    "page_tree.missing_pages": ("error", "Catalog {ref} does not contain /Pages", "Verify that the catalog points to a valid page tree root"),
    "page_tree.invalid_pages_reference": ("error", "Catalog {ref} has /Pages that is not an object reference", "Write /Pages as an indirect reference to a /Pages dictionary"),
    "page_tree.cyclic_reference": ("error", "Page tree cycle detected at {ref}", "Break the cycle in the /Kids or /Parent references"),
    "page_tree.missing_node": ("error", "Page tree node {ref} is missing", "Verify the page tree /Kids array and xref entries"),
    "page_tree.node_not_dictionary": ("error", "Page tree node {ref} is not a dictionary", "Replace the node with a valid /Pages or /Page dictionary"),
    "page_tree.pages_without_kids": ("error", "/Pages node {ref} does not contain a /Kids array", "Write a /Kids array containing page or page-tree references"),
    "page_tree.invalid_kid_reference": ("error", "/Pages node {ref} contains a /Kids entry that is not a reference", "Ensure every /Kids entry is an indirect object reference"),
    "page_tree.invalid_node_type": ("error", "Page tree node {ref} has unexpected /Type {detail}", "Ensure page tree nodes use /Type /Pages or /Type /Page"),
    "page.missing_mediabox": ("warning", "Page {page} ({ref}) has no /MediaBox and does not inherit one", "Add /MediaBox to the page or an ancestor /Pages node"),
    "page.missing_font_resource": ("warning", "Page {page} references font /{name}, but /{name} is not defined in page resources", "Check the page /Resources /Font dictionary and content stream Tf operators"),
    "page.missing_xobject_resource": ("warning", "Page {page} invokes XObject /{name}, but /{name} is not defined in page resources", "Check the page /Resources /XObject dictionary and Do operators"),
}
TEXTS |= {rule: ("warning", "Page {page} content stream: " + message, step) for rule, (message, step) in CHECKS.items()}


FINDING = "struct<ord:array<bigint>,rule_id:string,severity:string,message:string,obj:bigint,gen:int,page:int,byte_offset:bigint,suggested_next_step:string>"


def fill(template: str, values: dict[str, Column]) -> Column:
    """template with each {name} replaced by the value of that name; {ref} is obj and gen."""
    parts: list[Column] = []
    rest = template
    while rest:
        text, _, rest = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if rest:
            name, _, rest = rest.partition("}")
            ref = name == "ref" and F.concat_ws(" ", values["obj"], values["gen"], F.lit("R"))
            parts.append(ref if name == "ref" else F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit("{" + name + "}"))
    return F.concat(*parts) if parts else F.lit("")


def finding(values: dict[str, Column], rule: str | list[str], order: list[Column | int]) -> Column:
    """A FINDING of one rule, or of that of several which the value rule_id names."""
    has = lambda c, kind: values[c].cast(kind) if c in values else F.lit(None).cast(kind)
    if isinstance(rule, str):
        name, (severity, message, step) = F.lit(rule), TEXTS[rule]
        texts = F.lit(severity), fill(message, values), fill(step, values)
    else:
        name = values["rule_id"]
        pick = lambda i, make: F.coalesce(*[F.when(name == r, make(TEXTS[r][i])) for r in rule])
        texts = pick(0, F.lit), pick(1, lambda t: fill(t, values)), pick(2, lambda t: fill(t, values))
    return F.struct(
        F.array(*[F.lit(o).cast("long") if isinstance(o, int) else o.cast("long") for o in order]).alias("ord"), name.alias("rule_id"), texts[0].alias("severity"), texts[1].alias("message"),
        has("obj", "long").alias("obj"), has("gen", "int").alias("gen"), has("page", "int").alias("page"), has("byte_offset", "long").alias("byte_offset"), texts[2].alias("suggested_next_step"),
    )


def fields(x: Column, *names: str, **more: Column) -> dict[str, Column]:
    return {n: x[n] for n in names} | more


def document_rules() -> list[Column]:
    first = lambda kind: F.array_min(F.transform(F.filter("index", lambda o: o["type"] == kind), lambda o: F.struct(o["obj"].alias("obj"), o["gen"].alias("gen"))))
    meta, objstm, xref = F.col("metadata"), first("ObjStm"), first("XRef")
    flags = F.array(
        F.when(meta["encrypted"], finding({}, "document.encryption_detected", [1, 0])),
        F.when(meta["incremental_update_count"] > 0, finding(fields(meta, "incremental_update_count"), "document.incremental_updates_detected", [1, 1])),
        F.when(objstm.isNotNull(), finding(fields(objstm, "obj", "gen"), "document.object_stream_detected", [1, 2])),
        F.when(xref.isNotNull(), finding(fields(xref, "obj", "gen"), "document.xref_stream_detected", [1, 3])),
    )
    bad = F.filter("xref", lambda e: e["in_use"] & ~F.coalesce(e["valid_offset"], F.lit(True)))
    return [
        F.transform("warnings", lambda w: finding(fields(w, "message", "byte_offset"), "parse.warning", [0, w["ord"]])),
        F.filter(flags, lambda f: f.isNotNull()),
        F.transform(bad, lambda e: finding(fields(e, "obj", "gen", "byte_offset"), "xref.invalid_offset", [2, e["obj"], e["gen"]])),
    ]


def missing_targets() -> Column:
    """Targets that some value names and no object has, as structs of obj and gen.

    Both sides are texts, so that the set difference hashes them: it stays linear in a document's references.
    """
    text = lambda x: F.concat_ws(" ", x["obj"], x["gen"])
    left = F.array_except(F.transform("targets", text), F.transform("index", text))
    return F.transform(left, lambda t: F.struct(F.substring_index(t, " ", 1).cast("long").alias("obj"), F.substring_index(t, " ", -1).cast("int").alias("gen")))


def missing_references(docs: DataFrame) -> DataFrame:
    """doc_id, obj, gen of every target that some value names and no object has."""
    return parse(docs, "targets", "index").select("doc_id", F.inline(missing_targets()))


def stream_rules() -> list[Column]:
    at = lambda s: fields(s, "obj", "gen", "declared_length", "actual_length", byte_offset=s["raw_start"])
    key = lambda s: [4, s["obj"], s["gen"]]
    both = ["stream.decode_failed", "stream.unsupported_filter"]
    issue = lambda s: lambda x, k: finding(at(s) | fields(x, "filter", issue=x["message"], rule_id=F.when(x["kind"] == "failed", both[0]).otherwise(both[1])), both, [*key(s), 1, k])
    lacking = lambda s: lambda name, k: finding(at(s) | {"missing": name}, "image.missing_required_key", [*key(s), 2, k])
    return [
        F.transform(F.filter("streams", lambda s: s["declared_length"] != s["actual_length"]), lambda s: finding(at(s), "stream.length_mismatch", [*key(s), 0, 0])),
        F.flatten(F.transform("streams", lambda s: F.transform(s["issues"], issue(s)))),
        F.flatten(F.transform("streams", lambda s: F.transform(s["image_missing"], lacking(s)))),
    ]


def content_warnings(operators: DataFrame, by: list[str]) -> DataFrame:
    """by, i, rule_id, name, start, end, depth: what is wrong with streams of operators (by, i, name, start, end).

    Text objects follow from the last BT or ET before; the q depth is a running sum that can't
    sink below zero, which is the sum minus the least it has been so far.
    """
    order = W.partitionBy(*by).orderBy("i")
    known = F.col("name").isin(*OPERATORS)
    is_text = F.col("name").isin("BT", "ET")
    step = F.when(F.col("name") == "q", 1).when(F.col("name") == "Q", -1).otherwise(0)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = operators.select(*by, "i", "name", "start", "end", step.alias("step"))
    rows = rows.withColumns({"text": F.last(F.when(is_text, F.col("name")), True).over(before), "sum": F.sum("step").over(order)})
    rows = rows.withColumns({"least": F.least(F.coalesce(F.min("sum").over(before), F.lit(0)), F.lit(0))})
    every = W.partitionBy(*by)
    rows = rows.withColumns({"last": F.max("i").over(every), "lowest": F.least(F.min("sum").over(every), F.lit(0)), "open": F.coalesce(F.when(is_text, F.col("name")), F.col("text"))})
    at_end = F.col("i") == F.col("last")
    depth = F.col("sum") - F.col("lowest")
    found = F.array(
        F.when(~known, F.struct(F.lit("content.unknown_operator").alias("rule"), F.lit(0).alias("k"))),
        F.when((F.col("name") == "BT") & (F.col("text") == "BT"), F.struct(F.lit("content.nested_text_object").alias("rule"), F.lit(1).alias("k"))),
        F.when((F.col("name") == "ET") & (F.coalesce("text", F.lit("ET")) == "ET"), F.struct(F.lit("content.unmatched_text_end").alias("rule"), F.lit(1).alias("k"))),
        F.when((F.col("name") == "Q") & (F.col("sum") < F.col("least")), F.struct(F.lit("content.unmatched_graphics_restore").alias("rule"), F.lit(1).alias("k"))),
        F.when(at_end & (F.col("open") == "BT"), F.struct(F.lit("content.unclosed_text_object").alias("rule"), F.lit(2).alias("k"))),
        F.when(at_end & (depth > 0), F.struct(F.lit("content.unbalanced_graphics_state").alias("rule"), F.lit(3).alias("k"))),
    )
    return rows.select(*by, "i", "name", "start", "end", depth.alias("depth"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*by, "i", "name", "start", "end", "depth", "f.rule", "f.k")


def page_rules() -> list[Column]:
    tree = [rule for rule in TEXTS if rule.startswith("page_tree.")]
    place = ("page", "obj", "gen")
    lack = lambda p, rule, k, used, defined: F.transform(F.array_except(p[used], p[defined]), lambda n, i: finding(fields(p, *place, name=n), rule, [5, p["ord"], k, i, 0]))
    warned = lambda w: finding(fields(w, *place, "rule_id", "name", "start", "end", "depth"), list(CHECKS), [5, w["ord"], 1, w["i"] + F.when(w["k"] > 1, 1 << 40).otherwise(0), w["k"]])
    return [
        F.transform("tree_problems", lambda p: finding(fields(p, *place, "byte_offset", "detail", "rule_id"), tree, [5, p["ord"], 0, 0, 0])),
        F.transform(F.filter("page_checks", lambda p: ~p["has_media_box"]), lambda p: finding(fields(p, *place, "byte_offset"), "page.missing_mediabox", [5, p["ord"], 0, 0, 0])),
        F.transform("page_warnings", warned),
        F.flatten(F.transform("page_checks", lambda p: F.concat(lack(p, "page.missing_font_resource", 2, "fonts_used", "fonts"), lack(p, "page.missing_xobject_resource", 3, "xobjects_used", "xobjects")))),
    ]


def finding_rows(docs: DataFrame, gui: bool = False) -> DataFrame:
    """doc_id, metadata and found, all FINDINGs of the document in order: one row per document, no shuffle.

    A document that can't be parsed has no metadata and no findings.
    """
    missing = F.transform(missing_targets(), lambda t: finding(fields(t, "obj", "gen"), "object.missing_reference", [3, t["obj"], t["gen"]]))
    groups = [*document_rules(), missing, *stream_rules(), *page_rules()]
    found = F.concat(*[g.cast(f"array<{FINDING}>") for g in groups])
    empty = F.array().cast(f"array<{FINDING}>")
    return parse(docs, *PARTS, gui=gui).select("doc_id", "metadata", F.coalesce(F.array_sort(found), empty).alias("found"))


def findings(docs: DataFrame, gui: bool = False) -> DataFrame:
    """All findings of all rules: COLUMNS."""
    return finding_rows(docs, gui).select("doc_id", F.inline("found")).select(COLUMNS)


def summarize(rows: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, info and exit_code of each of finding_rows() that has findings."""
    count = lambda s: F.size(F.filter("found", lambda f: f["severity"] == s)).cast("long")
    counted = rows.filter(F.size("found") > 0).select("doc_id", count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("info"))
    return counted.withColumn("exit_code", (F.col("errors") > 0).cast("int"))

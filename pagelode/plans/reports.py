"""Reports of findings as JSON and Markdown, one text per document, made inside its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.1.0"
NEXT_STEPS = 8


def _count(severity: str):
    return F.size(F.filter("found", lambda f: f["severity"] == severity))


def json_reports(rows: DataFrame) -> DataFrame:
    """doc_id and report, a pretty JSON text, of rules.finding_rows(); documents that can't be parsed have none."""
    finding = lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"), f["message"].alias("message"), F.when(f["obj"].isNotNull(), F.struct(f["obj"].alias("object"), f["gen"].alias("generation"))).alias("object"), f["page"].alias("page"), f["byte_offset"].alias("byte_offset"), f["suggested_next_step"].alias("suggested_next_step"))
    counts = F.struct(_count("error").alias("errors"), _count("warning").alias("warnings"), _count("info").alias("info"))
    whole = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("metadata").alias("file"), counts.alias("diagnostics"), F.transform("found", finding).alias("findings"))
    return rows.filter("metadata is not null").select("doc_id", F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


# The lines of a Markdown report.
HEAD = (
    ("File: `", "file_name", "`"),
    ("PDF version: ", "pdf_version", ""),
    ("Pages: ", "page_count", ""),
    ("Encrypted: ", "encrypted", ""),
    ("Linearized: ", "linearized", ""),
    ("Incremental updates: ", "incremental_update_count", ""),
    ("Objects: ", "object_count", ""),
    ("Streams: ", "stream_count", ""),
)
NO_FINDINGS = "No diagnostics were emitted. Keep this report with the fixture for regression tracking."


def markdown_reports(rows: DataFrame) -> DataFrame:
    """doc_id and report, a Markdown text, of rules.finding_rows(): the file, the findings by severity, the first next steps."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["metadata"].dataType.fields}

    def shown(name: str):
        value = F.col(f"metadata.{name}")
        return F.when(value, "yes").otherwise("no") if kinds[name] == "boolean" else F.coalesce(value.cast("string"), F.lit("unknown"))

    head = F.concat(F.lit("## PDF Debug Report\n\n"), *[F.concat(F.lit(a), shown(name), F.lit(b + "\n")) for a, name, b in HEAD], F.lit("\n"))

    def line(f):
        page = F.when(f["page"].isNotNull(), F.concat(F.lit("Page `"), f["page"].cast("string"), F.lit("`: "))).otherwise("")
        ref = F.when(f["obj"].isNotNull(), F.concat(F.lit("Object `"), f["obj"].cast("string"), F.lit(" "), f["gen"].cast("string"), F.lit(" R`: "))).otherwise("")
        offset = F.when(f["byte_offset"].isNotNull(), F.concat(F.lit(" Byte offset `"), f["byte_offset"].cast("string"), F.lit("`."))).otherwise("")
        return F.concat(F.lit("- "), page, ref, f["message"], offset, F.lit("\n"))

    def section(title: str, severity: str):
        lines = F.transform(F.filter("found", lambda f: f["severity"] == severity), line)
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"### {title}\n\n"), F.array_join(lines, ""), F.lit("\n"))).otherwise("")

    steps = F.transform(F.slice("found", 1, NEXT_STEPS), lambda f: F.concat(F.lit("- "), f["suggested_next_step"], F.lit("\n")))
    tail = F.concat(F.lit("### Suggested Next Steps\n\n"), F.when(F.size(steps) > 0, F.array_join(steps, "")).otherwise(F.lit(f"- {NO_FINDINGS}\n")))
    text = F.concat(head, section("Errors", "error"), section("Warnings", "warning"), section("Info", "info"), tail)
    return rows.filter("metadata is not null").select("doc_id", text.alias("report"))

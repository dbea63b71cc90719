"""The registered reports over a small table, held against texts put together in plain Python."""

from pagelode.plans.queries import markdown_reports
from pagelode.sources.corpus import defective

CUSTOMERS = 19


def expected(key):
    """The report of customer key: file, findings by severity in the order of the rules, next steps."""
    kind, data = key % 8, defective(key)
    start = lambda mark: data.index(mark) + len(mark)
    stream = lambda: data.index(b"stream\n", start(b"6 0 obj")) + len(b"stream\n")
    moved = data.index(b"5 0 obj") + 7
    found = {
        0: [],
        1: [("Errors", "Object `99 0 R`: Referenced object 99 0 R was not found among parsed indirect objects", "Check whether 99 0 R is absent, hidden in an object stream, or omitted from the xref table")],
        2: [
            ("Errors", f"Object `5 0 R`: Xref entry for object 5 0 R points to byte {moved}, but that offset does not contain the expected object header Byte offset `{moved}`.", "Dump object 5 0 R and compare the xref offset against the raw file bytes"),
            ("Errors", "Object `5 0 R`: Referenced object 5 0 R was not found among parsed indirect objects", "Check whether 5 0 R is absent, hidden in an object stream, or omitted from the xref table"),
        ],
        3: [("Errors", f"Object `6 0 R`: Stream 6 0 R filter /FlateDecode could not be decoded: Error -3 while decompressing data: incorrect header check Byte offset `{stream() if kind == 3 else 0}`.", "Dump stream 6 0 R and verify the /Filter chain and encoded bytes")],
        4: [("Warnings", "Page `1`: Object `3 0 R`: Page 1 content stream: Unknown or unsupported content stream operator `ZZ` at content byte range 21..23", "Check whether the content stream contains a typo, unsupported extension, or corrupted operator bytes")],
        5: [("Warnings", f"Object `6 0 R`: Stream 6 0 R declares /Length 80, but 5 byte(s) were found before endstream Byte offset `{stream() if kind == 5 else 0}`.", "Regenerate or inspect stream 6 0 R and verify the writer's /Length calculation")],
        6: [("Warnings", f"Page `1`: Object `3 0 R`: Page 1 (3 0 R) has no /MediaBox and does not inherit one Byte offset `{data.index(b'3 0 obj')}`.", "Add /MediaBox to the page or an ancestor /Pages node")],
        7: [("Warnings", "Page `1`: Object `3 0 R`: Page 1 content stream: Content stream ended with 1 unmatched q graphics state save operator(s)", "Add matching Q operators or inspect whether the content stream was truncated")],
    }[kind]
    objects, streams = 5 + (kind in (3, 5)) - (kind == 2), 1 + (kind in (3, 5))
    lines = ["## PDF Debug Report", "", f"File: `{key}`", "PDF version: 1.4", "Pages: 1", "Encrypted: no", "Linearized: no", "Incremental updates: 0", f"Objects: {objects}", f"Streams: {streams}", ""]
    for title in ("Errors", "Warnings", "Info"):
        own = [f"- {text}" for section, text, _ in found if section == title]
        lines += [f"### {title}", "", *own, ""] if own else []
    steps = [f"- {step}" for *_, step in found] or ["- No diagnostics were emitted. Keep this report with the fixture for regression tracking."]
    return "\n".join([*lines, "### Suggested Next Steps", "", *steps, ""])


def test_markdown_reports_of_all_customers(spark, tmp_path):
    spark.range(CUSTOMERS).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["doc_id"]: r["report"] for r in markdown_reports(spark, str(tmp_path)).collect()}
    assert got == {key: expected(key) for key in range(CUSTOMERS)}
    assert sum("### Errors" in report for report in got.values()) == sum(key % 8 in (1, 2, 3) for key in range(CUSTOMERS))

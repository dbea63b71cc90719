"""Reports of lazily opened documents: fast findings, and the deep diagnostics that were asked for."""

from __future__ import annotations

import json

from pagelode.functions.deep import Enrichment
from pagelode.functions.lazy import LazyDocument, fast_findings
from pagelode.functions.values import reference_text

SCHEMA_VERSION = "0.1.0"
NEXT_STEPS = 8
# What a lazy report is and what it leaves out.
KIND, MODE = "lazy_fast_diagnostics", "lazy"
DEFERRED = ["stream decode validation", "content stream operator analysis", "precise page object extraction", "image/font deep validation", "page screenshots", "full report enrichment"]
# The standing lines of the Markdown text.
TITLE = "## PDF Lazy Debug Report"
NOTES = ("> Lazy report. Fast diagnostics only. Deep diagnostics deferred.", "> Lazy report. Fast diagnostics plus selected deep diagnostics enrichment.")
SCOPES = ("Scope: fast diagnostics only", "Scope: fast diagnostics plus selected target enrichments")
ABOUT = (
    "This report was generated from metadata-only lazy open data, lazy page metadata, and lazy fast diagnostics.",
    "It does not full-parse the PDF, scan all indirect objects, read all stream bytes, decode all streams, or extract page objects.",
    "Deep diagnostics are deferred and should be run on demand or against a smaller repro PDF.",
)
RAN = "The selected enrichment target(s) below were run on demand. Other unrequested deep diagnostics remain deferred."
NOTHING = "No lazy fast diagnostics findings were emitted. Keep this report with the fixture for regression tracking."
HEADINGS = (("Errors", "error"), ("Warnings", "warning"), ("Info", "info"))


def counts(findings: list[tuple]) -> dict:
    severities = [f[1] for f in findings]
    return {"errors": severities.count("error"), "warnings": severities.count("warning"), "info": severities.count("info")}


def _finding(f: tuple) -> dict:
    rule, severity, message, ref, page, offset, step = f
    target = {"object": ref[0], "generation": ref[1]} if ref else None
    return {"rule_id": rule, "severity": severity, "message": message, "object": target, "page": page, "byte_offset": offset, "suggested_next_step": step}


def report(doc: LazyDocument, name: str, extra: list[Enrichment] = ()) -> dict:
    findings = fast_findings(doc)
    enrichments = [
        {
            "scope": e.kind, "target": e.target, "page_number": e.page, "reference": {"object": e.ref[0], "generation": e.ref[1]} if e.ref else None, "partial": bool(e.limitations), "summary": e.summary,
            "diagnostics": counts(e.findings), "findings": [_finding(f) for f in e.findings], "warnings": e.warnings, "limitations": e.limitations, "details": [{"name": n, "value": v} for n, v in e.details],
        } for e in extra
    ]
    every = findings + [f for e in extra for f in e.findings]
    return {"schema_version": SCHEMA_VERSION, "report_kind": KIND, "open_mode": MODE, "file": doc.metadata(name), "diagnostics": counts(every), "findings": [_finding(f) for f in findings], "enrichments": enrichments, "deferred_deep_diagnostics": DEFERRED}


def as_json(made: dict) -> str:
    return json.dumps(made, indent=2, ensure_ascii=False)


def _listed(title: str, lines: list[str]) -> list[str]:
    return [title, "", *[f"- {x}" for x in lines], ""] if lines else []


def _sections(findings: list[dict], before: str = "") -> list[str]:
    out = []
    for title, severity in HEADINGS:
        lines = []
        for f in findings:
            if f["severity"] == severity:
                page = f"Page `{f['page']}`: " if f["page"] is not None else ""
                ref = f"Object `{reference_text((f['object']['object'], f['object']['generation']))}`: " if f["object"] else ""
                at = f" Byte offset `{f['byte_offset']}`." if f["byte_offset"] is not None else ""
                lines.append(f"{page}{ref}{f['message']}{at}")
        out += _listed(f"### {before}{title}", lines)
    return out


def as_markdown(made: dict) -> str:
    file, extra = made["file"], made["enrichments"]
    told = lambda x: "unknown" if x is None else "yes" if x is True else "no" if x is False else str(x)
    out = [TITLE, "", NOTES[bool(extra)], "", f"File: `{file['file_name']}`", f"File size: {file['file_size']} bytes", f"PDF version: {told(file['pdf_version'])}", "Open mode: `lazy`", SCOPES[bool(extra)]]
    out += [f"{label}: {told(file[key])}" for label, key in (("Pages", "page_count"), ("Encrypted", "encrypted"), ("Linearized", "linearized"), ("Incremental updates", "incremental_update_count"))]
    out += [f"{label}: {file[key] or 'none'}" for label, key in (("Root", "root"), ("Info", "info"))]
    out += [f"Xref entries: {file['xref_entry_count']}", f"Objects: {file['object_count']}", f"Streams: {file['stream_count']} (metadata only in lazy report)", ""]
    out += _listed("### Lazy Report Scope", list(ABOUT))
    out += ["### Deferred Deep Diagnostics", "", *([RAN, ""] if extra else []), *[f"- {x}" for x in made["deferred_deep_diagnostics"]], ""]
    if extra:
        out += ["### Deep Diagnostics Enrichment", ""]
    for e in extra:
        out += [f"#### {e['target']} ({e['scope']})", "", f"Partial: {told(e['partial'])}", "", e["summary"], ""]
        out += _listed("Details:", [f"{d['name']}: {d['value']}" for d in e["details"]]) + _listed("Warnings:", e["warnings"]) + _listed("Limitations:", e["limitations"])
        out += _sections(e["findings"], "Enrichment ")
    out += _listed("### Diagnostic Summary", [f"{title}: {made['diagnostics'][title.lower()]}" for title, _ in HEADINGS]) + _sections(made["findings"])
    out += _listed("### Suggested Next Steps", [f["suggested_next_step"] for f in made["findings"][:NEXT_STEPS]] or [NOTHING])
    return "\n".join(out[:-1]) + "\n"

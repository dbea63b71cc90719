"""Command line over single files: python -m pagelode.cli inspect|lazy-inspect|check|dump-object|dump-stream.

Exit codes: 0, 1 if a check finds an error or a stream can't be shown, 2 on failure.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pagelode.functions import deep, lazy_report, structure, views
from pagelode.functions.document import FULL_LIMIT, parse_document
from pagelode.functions.lazy import FileReader, LazyError, fast_findings, open_lazy
from pagelode.functions.values import reference_text

FINDING = ("rule_id", "severity", "message", "object", "page", "byte_offset", "suggested_next_step")


def _show(value) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def _full(path: str):
    """The parsed document and its bytes, or None where the file is over the full parse limit."""
    if os.path.getsize(path) > FULL_LIMIT:
        return None, None
    with open(path, "rb") as f:
        data = f.read()
    return parse_document(data), data


def _tree(nodes: list[structure.Node]) -> dict:
    made: dict[tuple, dict] = {}
    for n in nodes:
        made[n.path] = {"label": n.label, "kind": n.kind, "object": reference_text(n.ref) if n.ref else None, "summary": n.summary, "children": []}
        if n.path:
            made[n.path[:-1]]["children"].append(made[n.path])
    return made[()]


def inspect(args) -> int:
    doc, _ = _full(args.file)
    if doc is None:
        raise LazyError(f"file is over the full parse limit of {FULL_LIMIT} bytes")
    _show(_tree(structure.object_tree(doc)) if args.structure else doc.metadata(os.path.basename(args.file)))
    return 0


def lazy_inspect(args) -> int:
    doc = open_lazy(FileReader(args.file))
    if args.object:
        _show(views.inspect_object(doc.read_object(tuple(args.object)), decode=False))
    elif args.stream:
        made = doc.stream_view(tuple(args.stream))
        previews = {k: None if made[k] is None else made[k].decode("utf-8", "replace") for k in ("raw_preview", "decoded_preview")}
        _show(made | previews | {"hex_preview": views.hex_dump(made["raw_preview"])})
    elif args.deep_page is not None:
        _show(asdict(deep.deep_page(doc, args.deep_page)))
    elif args.deep_stream:
        _show(asdict(deep.deep_stream(doc, tuple(args.deep_stream))))
    elif args.deep_object:
        _show(asdict(deep.deep_object(doc, tuple(args.deep_object))))
    elif args.pages or args.page_list:
        pages = doc.page_index()
        _show([p._asdict() for p in pages] if args.pages else [{"page_number": p.number, "reference": reference_text(p.ref)} for p in pages])
    elif args.diagnostics:
        _show([dict(zip(FINDING, f, strict=True)) for f in fast_findings(doc)])
    elif args.structure:
        _show(_tree(doc.tree()))
    else:
        _show(doc.metadata(os.path.basename(args.file)))
    return 0


def check(args) -> int:
    """Full rules, or the fast ones with the enrichments asked for where the file is too large."""
    asked = bool(args.lazy_page or args.lazy_stream or args.lazy_object)
    if os.path.getsize(args.file) > FULL_LIMIT or asked:
        doc = open_lazy(FileReader(args.file))
        extra = [deep.deep_page(doc, p) for p in args.lazy_page or []]
        extra += [deep.deep_stream(doc, tuple(r)) for r in args.lazy_stream or []] + [deep.deep_object(doc, tuple(r)) for r in args.lazy_object or []]
        made = lazy_report.report(doc, os.path.basename(args.file), extra)
        text, markdown, errors = lazy_report.as_json(made), lazy_report.as_markdown(made), made["diagnostics"]["errors"]
    else:
        from pyspark.sql import SparkSession

        from pagelode.plans import reports, rules

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        with open(args.file, "rb") as f:
            docs = spark.createDataFrame([(1, os.path.basename(args.file), bytearray(f.read()))], "doc_id long, path string, content binary")
        rows = rules.finding_rows(docs).persist()
        text, markdown = (maker(rows).first()["report"] for maker in (reports.json_reports, reports.markdown_reports))
        errors = sum(f["severity"] == "error" for f in rows.first()["found"])
        rows.unpersist()
    for path, body in ((args.json, text), (args.markdown, markdown)):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
    if not args.json and not args.markdown:
        print(text)
    return int(errors > 0)


def dump_object(args) -> int:
    doc, data = _full(args.file)
    ref = (args.object, args.generation)
    found = doc.objects.get(ref) if doc else open_lazy(FileReader(args.file)).read_object(ref)
    if not found:
        raise LazyError(f"object {reference_text(ref)} was not found")
    if args.json:
        _show(views.inspect_object(found))
    else:
        raw = data[found.start : found.end] if data is not None else FileReader(args.file).read(found.start, found.end - found.start)
        sys.stdout.buffer.write(raw)
    return 0


def dump_stream(args) -> int:
    if sum(map(bool, (args.decoded, args.json, args.hex, args.content_json))) > 1:
        raise LazyError("choose only one of --decoded, --json, --hex, or --content-json")
    doc, _ = _full(args.file)
    ref = (args.object, args.generation)
    if doc is None:
        lazy = open_lazy(FileReader(args.file))
        found = lazy.read_object(ref)
        if found.stream:
            found.stream.raw = lazy.reader.read(found.stream.start, found.stream.end - found.stream.start)
    else:
        found = doc.objects.get(ref)
    if not found or not found.stream:
        raise LazyError(f"stream {reference_text(ref)} was not found")
    if args.json:
        _show(views.inspect_stream(found))
    elif args.hex:
        print(views.hex_dump(found.stream.raw), end="")
    elif args.content_json:
        try:
            _show(views.content_view(found))
        except views.NoContent as e:
            print(e, file=sys.stderr)
            return 1
    elif args.decoded:
        got = found.stream.decode()
        if got.issues:
            for name, kind, message in got.issues:
                print(f"stream {reference_text(ref)}: /{name} {kind}: {message}", file=sys.stderr)
            return 1
        with open(args.decoded, "wb") as f:
            f.write(got.data)
    else:
        sys.stdout.buffer.write(found.stream.raw)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagelode")
    commands = parser.add_subparsers(required=True)
    pair = {"nargs": 2, "type": int, "metavar": ("OBJECT", "GENERATION")}

    def command(name: str, run):
        p = commands.add_parser(name)
        p.add_argument("file")
        p.set_defaults(run=run)
        return p

    command("inspect", inspect).add_argument("--structure", action="store_true")
    lazy = command("lazy-inspect", lazy_inspect).add_mutually_exclusive_group()
    for flag in ("--structure", "--pages", "--page-list", "--diagnostics"):
        lazy.add_argument(flag, action="store_true")
    for flag in ("--object", "--stream", "--deep-stream", "--deep-object"):
        lazy.add_argument(flag, **pair)
    lazy.add_argument("--deep-page", type=int)
    p = command("check", check)
    p.add_argument("--json")
    p.add_argument("--markdown")
    p.add_argument("--lazy-page", type=int, action="append")
    p.add_argument("--lazy-stream", action="append", **pair)
    p.add_argument("--lazy-object", action="append", **pair)
    p = command("dump-object", dump_object)
    p.add_argument("object", type=int)
    p.add_argument("generation", type=int)
    p.add_argument("--json", action="store_true")
    p = command("dump-stream", dump_stream)
    p.add_argument("object", type=int)
    p.add_argument("generation", type=int)
    p.add_argument("--decoded")
    for flag in ("--json", "--hex", "--content-json"):
        p.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (LazyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""The commands from a shell: results as JSON on standard output; exit code 1 if validate finds issues, 2 and a line on standard error for errors."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import plots
from strandlake.operators.commands import Commands
from strandlake.session import local_session

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description="Registry of transcript structures on Spark")
    p.add_argument("--version", action="version", version=f"strandlake {VERSION}")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *needed: str, optional: tuple[str, ...] = (), fuzzy: bool = False, fmt: bool = False):
        c = commands.add_parser(name, help=about)
        for n in ("db", *needed):
            c.add_argument(f"--{n}", required=True)
        for n in optional:
            c.add_argument(f"--{n}")
        if fmt:
            c.add_argument("--format", choices=["gtf", "gff3"])
        if fuzzy:
            c.add_argument("--fuzzy-splice-tolerance", type=int, metavar="BP")
            c.add_argument("--fuzzy-end-tolerance", type=int, metavar="BP")
        return c

    command("init", "create a registry from a FASTA file and an annotation", "fasta", "assembly", "annotation", "annotation-name", optional=("contig-aliases",), fmt=True)
    command("annotation-add", "add another release of the annotation", "annotation", "annotation-name", fmt=True)
    command("add", "import one file, all or nothing", "input", "sample", "tool", "annotation-name", "output-gtf", "mapping", fuzzy=True, fmt=True)
    batch = command("batch", "import the files of a manifest", "manifest", "output-dir", fuzzy=True)
    batch.add_argument("--resume-completed", type=int, metavar="N", help="go on after N files of the manifest whose outputs are as they were written")
    several = command("multi-add", "import files of one tool", "tool", "annotation-name", "output-dir", fuzzy=True)
    several.add_argument("--input", required=True, nargs="+", metavar="PATH")
    several.add_argument("--samples", nargs="+", metavar="SAMPLE")
    command("export", "write the catalog", "catalog")
    command("validate", "check digests and keys")
    command("inspect", "what an identifier names").add_argument("identifier")
    command("plot", "draw the registry, or one gene's transcripts", "output", optional=("gene",))
    return p


def run(args: argparse.Namespace, c: Commands):
    """The command's result as plain values."""
    tolerance = {"splice": args.fuzzy_splice_tolerance, "end": args.fuzzy_end_tolerance} if "fuzzy_end_tolerance" in args else {}
    if args.command == "init":
        c.initialize(args.fasta, args.assembly, args.annotation, args.annotation_name, args.contig_aliases, args.format)
        row = c.registry.table("reference_context").first()
        return {"registry": args.db, "assembly": row.assembly, "fingerprint": row.fingerprint, "annotation": args.annotation_name}
    if args.command == "annotation-add":
        return {"annotation": args.annotation_name, "created": c.annotation_add(args.annotation, args.annotation_name, args.format)}
    if args.command == "add":
        out = c.import_file(args.input, args.sample, args.tool, args.annotation_name, args.format, **tolerance, gtf=args.output_gtf, mapping=args.mapping)
        return {**out, "output_gtf": args.output_gtf, "mapping": args.mapping}
    if args.command == "batch":
        return c.batch_file(args.manifest, args.output_dir, **tolerance, completed=args.resume_completed)
    if args.command == "multi-add":
        return c.multi_add(args.input, args.tool, args.annotation_name, args.output_dir, args.samples, **tolerance)
    if args.command == "export":
        c.export(args.catalog)
        return {"catalog": args.catalog, **c.summary()}
    if args.command == "validate":
        issues = [f"{r.problem}: {r.n}" for r in c.validate().orderBy("problem").collect()]  # a row a kind of problem
        return {"valid": not issues, "issues": issues, "summary": c.summary()}
    if args.command == "inspect":
        found = c.inspect(args.identifier)
        if not any(df.head(1) for df in found.values()):
            raise ValueError(f"nothing is named {args.identifier}")
        return {"identifier": args.identifier, **found}
    if args.gene:
        plots.gene(c, args.gene, args.output)
    else:
        plots.overview(c, args.output)
    return {"plot": args.output}


def write_json(found, out) -> None:
    """Values as JSON; the rows of a DataFrame are a list, written a partition at a time, however many there are."""
    if not isinstance(found, dict) or not any(isinstance(v, DataFrame) for v in found.values()):
        json.dump(found, out, indent=2, sort_keys=True, ensure_ascii=False, default=str)
        out.write("\n")
        return
    for k, (name, value) in enumerate(sorted(found.items())):
        out.write(f"{',' if k else '{'}\n  {json.dumps(name)}: ")
        if not isinstance(value, DataFrame):
            out.write(json.dumps(value, ensure_ascii=False))
            continue
        between = "["
        for row in value.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator():
            out.write(f"{between}\n    {row.row}")
            between = ","
        out.write("[]" if between == "[" else "\n  ]")
    out.write("\n}\n")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        found = run(args, Commands(local_session(), args.db))
        write_json(found, sys.stdout)
    except (ValueError, OSError, PySparkException, Py4JJavaError) as e:
        print(f"strandlake: error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 1 if args.command == "validate" and not found["valid"] else 0


if __name__ == "__main__":
    sys.exit(main())

"""Commands on a registry: create it, add annotations, import files singly or in batches, cluster, export, validate, plot."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import structure, text
from strandlake.session import released, stored
from strandlake.sinks import files
from strandlake.sources import annotation, tables

from . import artifacts, classify, registry, stateful
from .registry import Registry, RegistryError, numbered

ALGORITHM = "complete-linkage-v1"
#: Width of the position ranges that imports are numbered by.
RANGE = 1 << 20
ORDER = ["contig", "start", "end", "strand", "form_id", "transcript_id"]


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def fuzzy_options(splice: int | None, end: int | None) -> bool:
    if (splice is None) != (end is None):
        raise RegistryError("give both tolerances or neither")
    if splice is not None and min(splice, end) < 0:
        raise RegistryError("tolerances must not be negative")
    return splice is not None


def _alone(f):
    """A command that writes: no other writer from its first read to its last commit."""

    @wraps(f)
    def run(self, *args, **options):
        with self.registry.writing():
            return f(self, *args, **options)

    return run


class Commands:
    """The commands over one registry folder. A failed command leaves the registry as it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.registry = spark, Registry(spark, path)
        self.files = files.Files(spark, path)

    def _needed(self, name: str) -> DataFrame:
        df = self.registry.table(name)
        if df is None:
            raise RegistryError(f"the registry has no {name}")
        return df

    def _row(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    # -- reference and annotations

    @_alone
    def initialize(self, fasta: str, assembly: str, annotation_path: str, annotation_name: str, alias_path: str | None = None, fmt: str | None = None) -> None:
        if self.registry.table("reference_context") is not None:
            raise RegistryError("the registry exists")
        names = annotation.contigs(self.spark, fasta)
        alias = annotation.aliases(self.spark, alias_path, names) if alias_path else None
        new = {"reference_context": self._row("assembly string, fingerprint string", assembly, annotation.fingerprint(names)), "contig": names}
        if alias is not None:
            new["contig_alias"] = alias
        models = self._models(annotation_path, fmt, names, alias, annotation.fingerprint(names))
        added = self._annotation_tables(models, annotation_name, annotation_path)
        self.registry.commit(new | added)
        released(self.spark, added["structural_object"])

    @_alone
    def annotation_add(self, annotation_path: str, annotation_name: str, fmt: str | None = None) -> bool:
        """The same name with the same content changes nothing; with other content it is an error."""
        models = self._stored_models(annotation_path, fmt)
        old = self._needed("annotation_context").filter(F.col("name") == annotation_name).head(1)
        if old:
            if old[0].fingerprint != annotation.annotation_fingerprint(models):
                raise RegistryError(f"annotation {annotation_name} has other content")
            return False
        added = self._annotation_tables(models, annotation_name, annotation_path)
        self.registry.commit(added)
        released(self.spark, added["structural_object"])
        return True

    def _models(self, path, fmt, names, alias, fingerprint) -> DataFrame:
        fmt = fmt or annotation.detected_format(self.spark, path)
        models = annotation.resolved(annotation.transcripts(self.spark, path, fmt), names, alias)
        if not models.head(1):
            raise annotation.AnnotationError("no transcripts")
        df = structure.with_identity(structure.with_shape(models), fingerprint)
        return df.withColumns({"form_id": F.col("form.public_id"), "chain_id": F.col("splice_chain.public_id")})

    def _stored_models(self, path: str, fmt: str | None) -> DataFrame:
        context = self._needed("reference_context").first()
        return self._models(path, fmt, self._needed("contig"), self.registry.table("contig_alias"), context.fingerprint)

    def _annotation_tables(self, models: DataFrame, name: str, path: str) -> dict[str, DataFrame]:
        models = annotation.with_gene_names(models)
        context = self._row("name string, fingerprint string, input_checksum string, created_utc string", name, annotation.annotation_fingerprint(models), self.files.sha256(path), _now())
        cols = ["gene_id", "transcript_id", "contig", "strand", "start", "end", "exons", "attributes", "chain_id", "form_id"]
        return {"annotation_context": context, "structural_object": self.registry.new_structures(models), "reference_transcript": models.select(F.lit(name).alias("annotation_name"), *cols)}

    # -- imports

    @_alone
    def import_file(self, path: str, sample: str, tool: str, annotation_name: str, fmt: str | None = None, splice: int | None = None, end: int | None = None, gtf: str | None = None, mapping: str | None = None) -> dict:
        """Import a file once; the same annotation, sample, tool and checksum give the stored rows again."""
        fuzzy = fuzzy_options(splice, end)
        files.distinct_paths(self.files, [path], [p for p in (gtf, mapping) if p])
        out = self._import(path, sample, tool, annotation_name, fmt)
        if fuzzy and out["created"]:
            self.cluster(splice, end)
        self._outputs(out["import_id"], gtf, mapping)
        return out

    def _import(self, path, sample, tool, annotation_name, fmt) -> dict:
        checksum = self.files.sha256(path)
        import_id = text_digest(annotation_name, sample, tool, checksum)
        done = self.registry.table("import_manifest")
        if done is not None and (row := done.filter(F.col("import_id") == import_id).head(1)):
            return {"import_id": import_id, "created": False, "transcripts": row[0].transcripts}
        if not self._needed("annotation_context").filter(F.col("name") == annotation_name).head(1):
            raise RegistryError(f"no annotation {annotation_name}")
        kept = ["transcript_id", "gene_id", "contig", "strand", "start", "end", "exons", "source", "attributes", "form", "splice_chain", "form_id", "chain_id"]
        models = stored(self._stored_models(path, fmt).select(*kept), "import-models")
        reference = self._needed("reference_transcript").filter(F.col("annotation_name") == annotation_name)
        # exons and attributes are by far the most of a row, so the steps up to the commit go without them
        slim = models.select("transcript_id", F.col("transcript_id").alias("query_id"), "contig", "strand", "start", "end", "form_id")
        slim = stored(numbered(slim, [F.col("contig"), F.floor(F.col("start") / RANGE)], ORDER, "ordinal"), "import-numbers")  # numbers that a later step must not see change
        rows = classify.classified(slim, reference.select("gene_id", "transcript_id", "contig", "strand", "start", "end", "form_id")).drop("query_id")
        rows = stored(rows.withColumn("gene_candidates", F.array_join("gene_candidates", ",")), "import-rows")
        placed, loci = self._located(rows, import_id)
        n = models.count()
        manifest = self._row("import_id string, annotation_name string, sample string, tool string, input_checksum string, input string, transcripts bigint, created_utc string", import_id, annotation_name, sample, tool, checksum, path, n, _now())
        told = models.join(placed.select("transcript_id", "ordinal", "label", "output_gene_id", "output_transcript_id", "gene_candidates", "locus"), "transcript_id")
        told = told.withColumns({"import_id": F.lit(import_id), "annotation_name": F.lit(annotation_name), "sample": F.lit(sample), "tool": F.lit(tool)})
        cols = ["import_id", "ordinal", "annotation_name", "sample", "tool", "transcript_id", "gene_id", "contig", "strand", "start", "end", "exons", "source", "attributes", "form_id", "chain_id", "label", "output_gene_id", "output_transcript_id", "gene_candidates", "locus"]
        structures = self.registry.new_structures(models)
        self.registry.commit({"import_manifest": manifest, "structural_object": structures, "observation": told.select(*cols), "locus": loci})
        released(self.spark, models, slim, rows, structures)
        return {"import_id": import_id, "created": True, "transcripts": n}

    def _located(self, rows: DataFrame, import_id: str) -> tuple[DataFrame, DataFrame]:
        """Rows without a gene get a locus; a known transcript whose reference names no gene counts as a new locus."""
        status = F.when(F.col("label") == "known", "new_locus").otherwise(F.col("label"))
        lone = rows.filter("output_gene_id IS NULL").select("ordinal", "contig", "strand", status.alias("status"), F.when(status == "ambiguous_gene", F.col("gene_candidates")).otherwise("").alias("candidates"), "start", "end")
        known = self.registry.table("locus")
        last = 0 if known is None else known.agg(F.max("locus")).first()[0] or 0
        placed = stateful.allocated(lone, None if known is None else known.select("locus", "contig", "strand", "status", "candidates", "start", "end"), last)
        founders = placed.filter(F.col("locus") > last).groupBy("locus").agg(F.min_by(F.struct("contig", "strand", "status", "candidates", "start", "end"), "ordinal").alias("f"))
        name = text.accession(f"{structure.PREFIX}GL1.", F.col("locus"))
        out = rows.join(placed.select("ordinal", "locus"), "ordinal", "left").withColumn("output_gene_id", F.coalesce("output_gene_id", name))
        return out, founders.select("locus", name.alias("public_id"), "f.*", F.lit(import_id).alias("import_id"))

    @_alone
    def batch(self, manifest: DataFrame, folder: str, splice: int | None = None, end: int | None = None, completed: int | None = None) -> list[dict]:
        """Import a manifest's files in its order, cluster once, then write every file's outputs. Each import and each file's outputs are a commit.

        completed resumes a batch that was interrupted: its first so many files, and no others of it, must be imported, and what the ledger
        has of their outputs must be there as it was written. Outputs of theirs that show the current clusters are kept; the rest is written.
        """
        fuzzy = fuzzy_options(splice, end)
        prepared = []
        for r in manifest.orderBy("annotation_name", "sample", "tool", "input").collect():  # a list of files
            stem = self.stem(r.sample, r.tool, r.annotation_name, self.files.sha256(r.input))
            gtf, mapping = f"{folder}/{stem}.txid.gtf", f"{folder}/{stem}.mapping.tsv"
            files.distinct_paths(self.files, [r.input], [gtf, mapping])
            prepared.append((r, gtf, mapping))
        outputs = [p for _, gtf, mapping in prepared for p in (gtf, mapping)]
        files.distinct_paths(self.files, [r.input for r, *_ in prepared], outputs)
        if completed is not None:
            self._resumable([r for r, *_ in prepared], completed)
        done = [{**self._import(r.input, r.sample, r.tool, r.annotation_name, r.format), "input": r.input, "sample": r.sample, "tool": r.tool, "annotation_name": r.annotation_name, "output_gtf": gtf, "mapping": mapping} for r, gtf, mapping in prepared]
        if fuzzy:
            self.cluster(splice, end)
        kept = self._written() if completed is not None else set()
        for k, d in enumerate(done):
            paths = {(d["import_id"], self.files.resolved(d[x])) for x in ("output_gtf", "mapping")}
            d["written"] = k >= (completed or 0) or not paths <= kept
            if d["written"]:
                self._outputs(d["import_id"], d["output_gtf"], d["mapping"])
        return done

    def _resumable(self, rows: list, completed: int) -> None:
        """Raise unless the first `completed` files of a batch are what the registry holds of it, with their artifacts as they were written."""
        if not 0 <= completed <= len(rows):
            raise RegistryError(f"completed must be from 0 to {len(rows)}, not {completed}")
        ids = [text_digest(r.annotation_name, r.sample, r.tool, self.files.sha256(r.input)) for r in rows]
        old = self.registry.table("import_manifest")
        held = set() if old is None else {r.import_id for r in old.filter(F.col("import_id").isin(ids)).select("import_id").collect()}
        if held != set(ids[:completed]):
            raise RegistryError(f"the registry holds {len(held)} of the batch's files, and not just the first {completed}")
        if bad := artifacts.problems(self.spark, self._ledger().filter(F.col("import_id").isin(ids[:completed]))).orderBy("path").head(1):
            raise RegistryError(f"{bad[0].path} is {bad[0].problem}")

    def _run(self) -> str:
        """The current run of clusters, empty if there is none."""
        current = self.registry.table("fuzzy_current")
        return "" if current is None else current.first().run_id

    def _written(self) -> set[tuple[str, str]]:
        """Import and path of the outputs that show the current clusters: two a file."""
        return {(r.import_id, r.path) for r in self._ledger().filter(F.col("run_id") == self._run()).collect()}

    def batch_file(self, path: str, folder: str, **options) -> list[dict]:
        return self.batch(tables.batch_manifest(self.spark, path), folder, **options)

    def multi_add(self, inputs: list[str], tool: str, annotation_name: str, folder: str, samples: list[str] | None = None, **options) -> list[dict]:
        return self.batch(tables.inputs_manifest(self.spark, inputs, tool, annotation_name, samples), folder, **options)

    def stem(self, sample: str, tool: str, annotation_name: str, checksum: str) -> str:
        """A file name from provenance and ten digits of the checksum."""
        row = self._row("a string, b string, c string", sample, tool, annotation_name)
        return row.select(F.concat_ws(".", *[text.slug(F.col(c)) for c in "abc"], F.lit(checksum.split(":", 1)[1][:10])).alias("s")).first().s

    def _outputs(self, import_id: str, gtf: str | None, mapping: str | None) -> None:
        kinds = {self.files.resolved(p): kind for kind, p in (("gtf", gtf), ("mapping", mapping)) if p}
        if not kinds:
            return
        old = self._ledger().filter(F.col("path").isin(list(kinds))).select("path")
        if old.head(1):  # a file that is about to change is not an altered one
            self._recorded(import_id, kinds, old.withColumns({"bytes": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")}))
        rows = self.assignments(import_id)
        if gtf:
            files.write_gtf(rows, gtf)
        if mapping:
            files.write_mapping(rows, mapping)
        self._recorded(import_id, kinds, artifacts.digests(self.spark, list(kinds)))

    def _recorded(self, import_id: str, kinds: dict[str, str], found: DataFrame) -> None:
        """Append files (path, bytes, digest) to the ledger; the last entry of a path counts, and one without a digest takes it out."""
        kind = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])[F.col("path")]
        number = F.lit(self.registry.number()).cast("long")
        self.registry.commit({"artifact": found.select(F.lit(import_id).alias("import_id"), kind.alias("kind"), F.lit(self._run()).alias("run_id"), "path", "bytes", "digest", number.alias("at")).coalesce(1)})

    def _ledger(self) -> DataFrame:
        """The outputs as they were last written: one row a path."""
        rows = self.registry.table("artifact")
        if rows is None:
            return self.spark.createDataFrame([], artifacts.LEDGER)
        last = rows.groupBy("path").agg(F.max_by(F.struct("import_id", "kind", "run_id", "bytes", "digest"), "at").alias("x"))
        return last.select("x.import_id", "x.kind", "x.run_id", "path", "x.bytes", "x.digest").filter("digest IS NOT NULL")

    def lost_artifacts(self) -> DataFrame:
        """path and problem of all recorded outputs that are lost or altered."""
        return artifacts.problems(self.spark, self._ledger())

    # -- clusters

    @_alone
    def cluster(self, splice: int, end: int) -> bool:
        """Cluster all observed forms; a run over the same forms with the same tolerances is used again."""
        fuzzy_options(splice, end)
        seen = self._needed("observation").select(F.col("form_id").alias("public_id"))
        forms = self._needed("structural_object").join(seen, "public_id", "left_semi")
        lines = forms.orderBy("public_id").select(F.concat("public_id", F.lit("\t"), "full_digest", F.lit("\n")).alias("line"))
        print_ = "sha256:" + annotation.streamed_sha256(r.line for r in lines.toLocalIterator())
        run_id = text_digest(ALGORITHM, str(splice), str(end), print_)
        runs = self.registry.table("fuzzy_run")
        current = self._row("run_id string, covers bigint", run_id, self._needed("import_manifest").count())
        if runs is not None and runs.filter(F.col("run_id") == run_id).head(1):
            self.registry.commit({}, {"fuzzy_current": current})
            return False
        spans = F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        shaped = structure.with_shape(self._needed("observation").select("form_id", "contig", "strand", spans.alias("exons")))
        shaped = shaped.select("form_id", "contig", "strand", stateful.coordinates().alias("coordinates")).dropDuplicates(["form_id"])
        shaped = shaped.join(forms.select(F.col("public_id").alias("form_id"), "family"), "form_id")
        shaped = stored(shaped.select("form_id", "family", F.lit("").alias("assembly"), "contig", "strand", "coordinates"), "cluster-forms")
        made = stateful.clustered(shaped, splice, end)
        old = self.registry.table("fuzzy_cluster")
        last = 0 if old is None else old.agg(F.max("accession")).first()[0] or 0
        groups = made.groupBy("cluster").agg(F.array_sort(F.collect_list("form_id")).alias("members"), F.max("bridge_status").alias("_last"), F.min("bridge_status").alias("bridge_status"))
        found = stored(groups, "cluster-groups")  # clusters are made once
        groups = numbered(found, [F.substring("cluster", 1, 12)], ["cluster"], "accession", last)
        groups = groups.select("accession", text.accession(f"{structure.PREFIX}FC1.", F.col("accession")).alias("public_id"), F.lit(run_id).alias("run_id"), F.sha2(F.array_join("members", "\n"), 256).alias("signature"), "bridge_status", "members")
        run = self._row("run_id string, algorithm string, splice_tolerance int, end_tolerance int, input_fingerprint string, created_utc string", run_id, ALGORITHM, splice, end, print_, _now())
        members = groups.select("accession", F.explode("members").alias("form_id"))
        self.registry.commit({"fuzzy_run": run, "fuzzy_cluster": groups.drop("members"), "fuzzy_member": members}, {"fuzzy_current": current})
        released(self.spark, shaped, found)
        return True

    def observations(self) -> DataFrame:
        """All observations with the latest run's cluster; forms that came after it have none."""
        rows = self._needed("observation")
        current = self.registry.table("fuzzy_current")
        if current is None:
            return rows.withColumns({c: F.lit(None).cast("string") for c in ("fuzzy_cluster", "bridge_status")})
        run = current.first().run_id
        of = self._needed("fuzzy_cluster").filter(F.col("run_id") == run).select("accession", F.col("public_id").alias("fuzzy_cluster"), "bridge_status")
        return rows.join(self._needed("fuzzy_member").join(of, "accession").drop("accession"), "form_id", "left")

    def assignments(self, import_id: str) -> DataFrame:
        return self.observations().filter(F.col("import_id") == import_id)

    # -- reports

    def provenance(self) -> DataFrame:
        """Observations with the file, checksum, size and time of their import and the fingerprint of their annotation."""
        m = self._needed("import_manifest").select("import_id", "input", "input_checksum", "transcripts", F.col("created_utc").alias("imported_utc"))
        a = self._needed("annotation_context").select(F.col("name").alias("annotation_name"), F.col("fingerprint").alias("annotation_fingerprint"))
        return self.observations().join(m, "import_id").join(a, "annotation_name")

    def catalog(self) -> DataFrame:
        return registry.catalog(self._needed("observation").withColumn("splice_chain_id", F.col("chain_id")))

    def export(self, path: str) -> None:
        files.write_catalog(self.catalog(), path)

    def summary(self) -> dict:
        o = self._needed("observation")
        out = registry.summary(o).first().asDict()
        labels = {r.label: r["count"] for r in o.groupBy("label").count().collect()}
        loci = self.registry.table("locus")
        return {**out, "assembly": self._needed("reference_context").first().assembly, "imports": self._needed("import_manifest").count(), "loci": 0 if loci is None else loci.count(), "classifications": labels}

    def classify_only(self, path: str, annotation_name: str, out: str, fmt: str | None = None) -> None:
        """Labels of a file's transcripts as a table; nothing is stored and no locus is given."""
        reference = self._needed("reference_transcript").filter(F.col("annotation_name") == annotation_name)
        rows = classify.classified(self._stored_models(path, fmt).withColumn("query_id", F.col("transcript_id")), reference)
        rows = rows.withColumn("gene_candidates", F.array_join("gene_candidates", ","))
        files.write_table(rows, out, ["transcript_id"], {k: k for k in ("transcript_id", "form_id", "chain_id", "label", "output_gene_id", "output_transcript_id", "gene_candidates")})

    def validate(self) -> DataFrame:
        """Problems found: what and how many. Digests that do not follow from their JSON, keys without parent, repeated keys."""
        s, o, t = self._needed("structural_object"), self.registry.table("observation"), self._needed("reference_transcript")
        wrong = (F.sha2("canonical_json", 256) != F.col("full_digest")) | ~F.endswith("public_id", F.substring("full_digest", 1, structure.SHOWN))
        one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("problem"), "n")
        lone = lambda child, c, parent, k: child.filter(F.col(c).isNotNull()).join(parent.select(F.col(k).alias(c)), c, "left_anti")
        twice = lambda df, *k: df.groupBy(*k).count().filter("count > 1")
        names = self._needed("contig")
        found = [one(s.filter(F.coalesce(wrong, F.lit(True))), "digest"), one(twice(s, "public_id"), "repeated structure"), one(twice(self._needed("annotation_context"), "name"), "repeated annotation"), one(twice(t, "annotation_name", "transcript_id"), "repeated reference transcript")]
        keys = [("reference", t, c, p, k) for c, p, k in (("annotation_name", self._needed("annotation_context"), "name"), ("contig", names, "name"), ("form_id", s, "public_id"), ("chain_id", s, "public_id"))]
        if (alias := self.registry.table("contig_alias")) is not None:
            keys.append(("alias", alias, "primary", names, "name"))
        if o is not None:
            m, loci = self._needed("import_manifest"), self._needed("locus")
            found += [one(twice(o, "import_id", "transcript_id"), "repeated observation"), one(twice(m, "annotation_name", "sample", "tool", "input_checksum"), "repeated import"), one(twice(loci, "public_id"), "repeated locus")]
            keys += [("import", m, "annotation_name", self._needed("annotation_context"), "name"), ("locus", loci, "contig", names, "name")]
            keys += [("observation", o, c, p, k) for c, p, k in (("import_id", m, "import_id"), ("contig", names, "name"), ("form_id", s, "public_id"), ("chain_id", s, "public_id"), ("locus", loci, "locus"))]
        if (runs := self.registry.table("fuzzy_run")) is not None:
            c, f = self._needed("fuzzy_cluster"), self._needed("fuzzy_member")
            keys += [("cluster", c, "run_id", runs, "run_id"), ("member", f, "accession", c, "accession"), ("member", f, "form_id", s, "public_id")]
        found += [one(lone(child, c, parent, k), f"{name} without {c}") for name, child, c, parent, k in keys]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.filter("n > 0")

    def inspect(self, identifier: str) -> dict[str, DataFrame]:
        """Structures, loci, clusters and observations that an identifier names."""
        is_ = F.lit(identifier)
        o = self.observations()
        hit = F.array_contains(F.array("form_id", "chain_id", "output_transcript_id", "output_gene_id", "fuzzy_cluster"), is_)
        out = {"structural_object": self._needed("structural_object").filter(F.col("public_id") == is_), "observation": o.filter(F.coalesce(hit, F.lit(False))).orderBy("sample", "tool", "transcript_id")}
        for name in ("locus", "fuzzy_cluster"):
            if (df := self.registry.table(name)) is not None:
                out[name] = df.filter(F.col("public_id") == is_)
        if "fuzzy_cluster" in out:
            out["fuzzy_member"] = self._needed("fuzzy_member").join(out["fuzzy_cluster"].select("accession"), "accession", "left_semi").orderBy("form_id")
        return out


def text_digest(*parts: str) -> str:
    return annotation.streamed_sha256(parts, between="\x1f")[:24]

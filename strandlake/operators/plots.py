"""Plots of a registry as SVG: label counts, and the transcripts of one gene. Only one gene's tracks reach the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import text
from strandlake.sinks import files

from .commands import Commands
from .registry import RegistryError

LABELS = ["known", "novel_in_known_gene", "ambiguous_gene", "new_locus"]


def _words(x: float, y: float, words, size: int = 13, extra: str = "") -> str:
    return f'<text x="{x:g}" y="{y:g}" font-family="sans-serif" font-size="{size}"{extra}>{escape(str(words))}</text>'


def _box(x: float, y: float, w: float, h: float, fill: str, extra: str = "") -> str:
    return f'<rect x="{x:.2f}" y="{y:g}" width="{w:.2f}" height="{h:g}" fill="{fill}"{extra}/>'


def wrapped_items(prefix: str, items: list[str], width: int = 58) -> list[str]:
    """Items in lines of about `width` characters after a prefix; later lines are indented by as much. An item is never cut."""
    lines: list[str] = []
    for item in items:
        if lines and len(lines[-1]) + 3 + len(item) <= width:
            lines[-1] += f" · {item}"
        else:
            lines.append((" " * len(prefix) if lines else prefix) + item)
    return lines


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" role="img">'
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', head, f"<title>{escape(title)}</title>", _box(0, 0, width, height, "white"), *body, "</svg>", ""])


def overview(c: Commands, path: str) -> None:
    """A bar for each label, scaled to the greatest count."""
    s = c.summary()
    most = max([s["classifications"].get(k, 0) for k in LABELS] + [1])
    body = [_words(24, 34, "Registry overview", 22), _words(24, 58, f"{s['assembly']}: {s['imports']} imports, {s['forms']} exact forms")]
    for i, k in enumerate(LABELS):
        n, y = s["classifications"].get(k, 0), 84 + 40 * i
        body += [_words(24, y + 17, k), _box(200, y, 440, 24, "#e5e7eb"), _box(200, y, 440 * n / most, 24, "#1d4ed8"), _words(650, y + 17, n)]
    files.write_text(c.spark, path, _svg(740, 260, "Registry overview", body))


def resolved_gene(c: Commands, query: str) -> tuple[str, list[str], DataFrame, DataFrame]:
    """How a name was understood, gene ids, reference transcripts and observations.

    Identifiers of genes, outputs and loci come first, then a gene name of one gene, then the gene ids of
    inputs. Rows on more than one contig or strand are an error.
    """
    query = query.strip()
    if not query:
        raise RegistryError("empty gene")
    r, o, loci = c._needed("reference_transcript"), c.observations(), c.registry.table("locus")
    probes = [(r, "gene_id"), (o, "output_gene_id"), *([(loci, "public_id")] if loci is not None else [])]
    if any(df.filter(F.col(k) == query).select(k).head(1) for df, k in probes):
        how, genes, seen = "gene_id", [query], o.filter(F.col("output_gene_id") == query)
    else:
        named = r.filter(F.exists("attributes", lambda a: (a["key"] == "gene_name") & (a["value"] == query))).filter("gene_id IS NOT NULL")
        genes = sorted(x.gene_id for x in named.select("gene_id").distinct().limit(100).collect())
        if len(genes) > 1:
            raise RegistryError(f"gene name {query} fits several genes: {', '.join(genes)}")
        how, seen = "gene_name", o.filter(F.col("output_gene_id").isin(genes))
        if not genes:
            how, seen = "original_gene_id", o.filter(F.col("gene_id") == query)
            genes = sorted(x.output_gene_id for x in seen.select("output_gene_id").distinct().collect())
            if not genes:
                raise RegistryError(f"no gene {query}")
    refs = r.filter(F.col("gene_id").isin(genes))
    places = refs.select("contig", "strand").unionByName(seen.select("contig", "strand")).distinct().orderBy("contig", "strand").collect()
    if len(places) > 1:
        raise RegistryError(f"{query} lies in several places: " + ", ".join(f"{p.contig}({p.strand})" for p in places))
    if not places:
        raise RegistryError(f"{query} has no transcripts")
    return how, genes, refs, seen


def reference_tracks(refs: DataFrame) -> DataFrame:
    """One row a reference structure with the annotations that hold it."""
    spans = F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    keys = ["transcript_id", "form_id", "contig", "strand", "spans"]
    out = refs.withColumn("spans", spans).groupBy(*keys).agg(F.array_sort(F.collect_set("annotation_name")).alias("annotations"))
    return out.orderBy(F.col("spans")[0]["start"], F.element_at("spans", -1)["end"], "spans", "form_id", "transcript_id")


def observed_tracks(seen: DataFrame) -> DataFrame:
    """One row a form with what was observed of it; a form with two structures is an error."""
    spans = F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    sets = {"samples": "sample", "tools": "tool", "labels": "label", "annotations": "annotation_name", "output_ids": "output_transcript_id", "clusters": "fuzzy_cluster", "chains": "chain_id", "bridges": "bridge_status"}
    out = seen.withColumn("spans", spans).groupBy("form_id").agg(
        F.min("spans").alias("spans"), F.count_distinct("spans").alias("shapes"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct("sample", "tool", "transcript_id"))).alias("old_ids"), *[F.array_sort(F.collect_set(c)).alias(k) for k, c in sets.items()]
    )
    if bad := out.filter("shapes > 1").head(1):
        raise RegistryError(f"form {bad[0].form_id} has several structures")
    out = out.withColumn("hue", text.hue(F.coalesce(F.try_element_at("clusters", F.lit(1)), "form_id")))
    return out.orderBy(F.col("spans")[0]["start"], F.element_at("spans", -1)["end"], "spans", "form_id")


def gene(c: Commands, query: str, path: str) -> None:
    """Reference and observed transcripts on one axis; colours follow clusters, a dashed outline marks a bridge."""
    how, genes, refs, seen = resolved_gene(c, query)
    tracks = [("#475569", "", t.transcript_id, [*wrapped_items("form ", [t.form_id]), *wrapped_items("in ", t.annotations)], t.spans) for t in reference_tracks(refs).collect()]
    bridged = False
    for t in observed_tracks(seen).collect():
        bridge = "ambiguous_bridge" in t.bridges
        bridged |= bridge
        edge = ' stroke="#b91c1c" stroke-dasharray="3 2"' if bridge else ""
        about = [f"{t.n} seen: {', '.join(t.labels)}", *wrapped_items("samples ", t.samples), *wrapped_items("tools ", t.tools), *wrapped_items("input ids ", [x.transcript_id for x in t.old_ids])]
        about += [*wrapped_items("chain ", t.chains), *wrapped_items("cluster ", t.clusters)]
        tracks.append((f"hsl({t.hue},60%,45%)", edge, t.form_id, about, t.spans))
    low, high = min(t[4][0].start for t in tracks), max(t[4][-1].end for t in tracks)
    pad = max(1, round((high - low + 1) * 0.03))
    left, wide = 360, 640
    at = lambda p: left + wide * (p - low + pad) / (high - low + 1 + 2 * pad)
    place = refs.select("contig", "strand").unionByName(seen.select("contig", "strand")).first()
    body = [_words(20, 30, f"{query}: {', '.join(genes)}", 20), _words(20, 52, f"{place.contig}({place.strand}) {low}-{high}, found by {how}")]
    if bridged:
        body.append(_words(left, 52, "A dashed outline marks a form that fits several clusters.", 11, ' fill="#b91c1c"'))
    y = 80
    for colour, edge, name, about, spans in tracks:
        body += [_words(20, y + 10, name, 11), *[_words(20, y + 22 + 11 * i, line, 9, ' fill="#64748b" xml:space="preserve"') for i, line in enumerate(about)]]
        body.append(_box(at(spans[0].start), y + 7, at(spans[-1].end) - at(spans[0].start), 1, colour))
        body += [_box(at(x.start), y, max(1.0, at(x.end + 1) - at(x.start)), 15, colour, edge) for x in spans]
        y += 24 + 11 * len(about)
    y += 10
    body += [_box(left, y, wide, 1, "#111827")]
    body += [_words(at(low + (high - low) * k // 4), y + 18, low + (high - low) * k // 4, 10, ' text-anchor="middle"') for k in range(5)]
    files.write_text(c.spark, path, _svg(1020, y + 40, f"Transcripts of {query}", body))

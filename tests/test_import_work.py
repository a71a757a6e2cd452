"""What an import, a run of clusters and a resumed batch do only once, or without the widest columns."""

from strandlake import session
from strandlake.operators import classify, commands
from strandlake.plans import catalog_queries, registry_queries

DATA = "/root/testdata/sf0.001"


def test_imports_and_clusters(spark, monkeypatch):
    """Rows are classified without exons and attributes, and groups of clusters are stored before they are numbered and written."""
    monkeypatch.setattr(registry_queries, "_built", {})
    names, columns, classified = [], [], classify.classified
    monkeypatch.setattr(commands, "stored", lambda df, name: names.append(name) or session.stored(df, name))
    monkeypatch.setattr(classify, "classified", lambda queries, reference: columns.append({*queries.columns, *reference.columns}) or classified(queries, reference))
    r = catalog_queries.QUERIES["registry_clusters"](spark, DATA).first()
    assert r.observations == r.clustered > 0 and r.strays == 0
    assert "cluster-groups" in names
    assert len(columns) == 1 and not columns[0] & {"exons", "attributes", "form", "splice_chain"}


def test_resumed_batch_verifies_its_files_once(spark, monkeypatch):
    asked, lost = [], commands.Commands.lost_artifacts
    monkeypatch.setattr(commands.Commands, "lost_artifacts", lambda self: asked.append(1) or lost(self))
    rows = catalog_queries.QUERIES["resumed_batch"](spark, DATA).collect()
    assert len(rows) > 1 and all(r.lost == 0 for r in rows)
    assert len(asked) == 1

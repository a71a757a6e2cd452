import duckdb

from strandlake.operators import metrics, stateful
from strandlake.plans import catalog_queries

DATA = "/root/testdata/sf0.001"


def test_compatible_pairs_of_all_families(spark):
    """All pairs by brute force; a splice site and an end that are just near enough, and just too far."""
    schema = "form_id string, family string, assembly string, contig string, strand string, coordinates array<bigint>"
    multi = [[1000, 3000, 1500, 2000], [1400, 2600, 1600, 1900], [1000, 3000, 1601, 2000], [1401, 3000, 1500, 2000]]
    made = [(f"m{i}", "TF1", "a", "c", "+", x) for i, x in enumerate(multi)] + [(f"s{i}", "SE1", "a", "c", "+", [1000 + 300 * i, 3000]) for i in range(4)]
    forms = [tuple(r) for r in catalog_queries._forms(spark, DATA).dropDuplicates(["form_id"]).collect()]

    def pairs(rows):
        near = lambda x, y: all(abs(p - q) <= (400 if i < 2 else 100) for i, (p, q) in enumerate(zip(x, y)))
        return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:5] == b[1:5] and len(a[5]) == len(b[5]) and near(a[5], b[5])}

    got = {tuple(r) for r in stateful.compatible_pairs(spark.createDataFrame(made, schema), 100, 400).collect()}
    assert got == pairs(made) and ("m0", "m1") in got and ("m0", "m2") not in got and ("m0", "m3") not in got
    assert {tuple(r) for r in catalog_queries.QUERIES["compatible_forms_all"](spark, DATA).collect()} == pairs(forms)
    assert "TF1" in {r[1] for r in forms}


def test_compatible_forms_all_takes_forms_of_several_exons(spark, monkeypatch):
    rows = [(f"t{i}", "TF1", "a", "c", "+", [1000 + i, 3000, 1500, 2000]) for i in range(3)]
    schema = "form_id string, family string, assembly string, contig string, strand string, coordinates array<bigint>"
    monkeypatch.setattr(catalog_queries, "_forms", lambda spark, d: spark.createDataFrame(rows, schema))
    assert catalog_queries.QUERIES["compatible_forms_all"](spark, DATA).count() == 3


def by_sql(name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.execute(catalog_queries.SQL[name]).fetchall()


def test_end_errors_by_hand(spark):
    """The chain's last truth counts, both ends do, and rows of one exon or without a truth do not."""
    schema = "chain_id string, k long, tss long, tes long"
    truth = spark.createDataFrame([("a", 2, 100, 900), ("a", 1, 0, 0), ("b", 3, 500, 50), (None, 4, 1, 1)], schema)
    seen = spark.createDataFrame([("a", 9, 103, 890), ("b", 9, 500, 75), ("c", 9, 0, 0), (None, 9, 7, 7)], schema)
    assert tuple(metrics.end_errors(truth, seen, "k").first()) == (4, 6.5, 25)
    assert tuple(metrics.end_errors(truth, seen.filter("chain_id = 'c'"), "k").first()) == (0, None, None)


def test_chain_end_errors_by_sql(spark):
    assert [tuple(r) for r in catalog_queries.QUERIES["chain_end_errors"](spark, DATA).collect()] == by_sql("chain_end_errors")


def test_tools_and_reference_ids_by_sql(spark):
    """All observations of two tools, and all reference forms, not those of chosen numbers."""
    for name in ("tool_pairs", "inspect_reference_ids"):
        got = sorted(tuple(r) for r in catalog_queries.QUERIES[name](spark, DATA).collect())
        assert got and got == sorted(by_sql(name)), name

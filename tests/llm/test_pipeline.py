import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import toxicity
from strandlake.llm.common import documents
from strandlake.llm.queries import VOCABULARY, labels

from . import brute
from .test_near import close, shingles
from .test_operators import in_order

DATA = "/root/testdata/sf0.001"


def test_run_by_brute_force(spark):
    """All rows of the pipeline; toxicity's decisions come from the operator's own scores, which have a test of their own."""
    docs = documents(spark, DATA)
    model = toxicity.train(docs, labels(spark, DATA), toxicity.held_out_rows())
    passed = {r.doc_id: r for r in toxicity.scored(docs, model).collect() if r.score < toxicity.CUT}
    last = {}
    for i, r in passed.items():
        last[r.text or ""] = max(i, last.get(r.text or "", i))
    sets = {i: shingles(passed[i].text) for i in last.values()}
    left = set(brute.components(sets, lambda a, b: close(sets[a], sets[b])).values())
    assert len(docs.collect()) > len(passed) > len(last) > len(left)
    rows = [(i, len(brute.WORD.findall(passed[i].text or "")), passed[i].source) for i in left]
    taken = brute.taken(rows, in_order)
    t, want = Tokenizer.from_file(VOCABULARY), Counter()
    t.no_truncation()
    for i, size, _ in rows:
        for _ in range((2 * taken[i] + size) // (2 * size) if size else 0):
            ids = t.encode(passed[i].text, add_special_tokens=False).ids
            back = t.decode(ids, skip_special_tokens=False)
            want[i, b"".join(x.to_bytes(4, "little") for x in ids), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter((r.doc_id, bytes(r.ids), *r[2:]) for r in got.collect()) == want and max(want.values()) == 2

from collections import Counter

import corpus_pipeline
import pytest
from tidemark.llm import mixing, quality

from test_dedup import az
from test_near import brute
from test_packing_mixing import check_packed


def test_stages_against_brute_force(spark, small):
    """Each stage on what the last one kept, held against a plain version of it; then run() as a whole."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mixing", "packing"]

    weights, _ = quality.fit(docs)
    fine = []
    for r in docs.collect():
        _, at, x = quality.described(r.text or "")
        if not len(at) or 1 / (1 + 2.718281828459045 ** -(weights[at] @ x + weights[-1])) < quality.CUT:
            fine.append(r.doc_id)
    docs = stages["quality"](spark, docs, small).persist()
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(fine)

    last = {az(r.text): r.doc_id for r in sorted(docs.collect(), key=lambda r: r.doc_id)}
    docs = stages["exact"](spark, docs, small).persist()
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(last.values())

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    roots = brute([r.text for r in rows])[1]
    first = {}
    for r, k in zip(rows, roots, strict=True):
        first.setdefault(k, r.doc_id)
    docs = stages["near"](spark, docs, small).persist()
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(first.values())

    taken = {r.doc_id: r.taken // max(r["size"], 1) for r in mixing.mix(docs).collect()}
    docs = stages["mixing"](spark, docs, small).persist()
    times = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and times == Counter({k: v for k, v in taken.items() if v}) and set(times.values()) <= {1, 2}

    check_packed(stages["packing"](spark, docs, small).collect(), docs)
    whole = corpus_pipeline.run(spark, small).collect()
    check_packed(whole, docs)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_all_stages_over_odd_rows_and_none(spark, odd, empty, tmp_path, which):
    """From nulls, ties, repeats, long texts and clashing names to packed pieces; and from no rows to none."""
    table = odd if which == "odd" else empty
    table.select(*[c for c in table.columns if c != "m"]).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert bool(rows) == (which == "odd")
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = sorted(parts)
        assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and sum(n for _, n in parts) <= 1024

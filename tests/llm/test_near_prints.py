import random

import corpus_pipeline
from tidemark.llm import near, simhash

from test_near import brute


def test_near_stage_links_what_simhash_links(spark):
    """Texts of one fingerprint with few shingles in common meet; so do alike ones with unlike fingerprints, and chains of both kinds."""
    random.seed(5)
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    often, base = "one two three four five".split() * 200, fresh(60)
    prints = [" ".join(often + fresh(40)) for _ in range(3)]
    chain = " ".join(often + fresh(300))
    alike = chain.rsplit(" ", 10)[0] + " " + " ".join(fresh(10))
    other = [" ".join(base), " ".join([*base[:55], *fresh(3)]), " ".join(fresh(60))]
    docs = spark.createDataFrame(list(enumerate([*prints, chain, alike, *other])), "doc_id long, text string")
    by_print = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    roots = brute([r.text for r in docs.orderBy("doc_id").collect()])[1]
    assert len({by_print[k] for k in range(4)}) < 4 and len(set(roots[:4])) == 4  # linked by SimHash alone
    root = list(range(8))
    for of in (by_print, dict(enumerate(roots))):
        for k in range(8):
            for m in range(k):
                if of[k] == of[m]:
                    a, b = root[k], root[m]
                    root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r.doc_id: r.component_id for r in near.near_groups(docs).collect()} == dict(enumerate(root))
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted(set(root))

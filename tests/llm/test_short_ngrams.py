import random

import corpus_pipeline
from recurra.llm import quality_rules
from tests.llm.common import prose, table


def test_stuttered_text_is_rejected(spark):
    r = random.Random(25)
    stutter = " ".join(w for w in (f"th{k}nt" for k in range(30)) for _ in range(4))
    texts = [stutter, prose(r, 200), prose(r, 20_000)]
    docs = table(spark, texts)
    got = {x["doc_id"]: x for x in quality_rules.quality_measures(docs, limits=quality_rules.SHORT_LIMITS).collect()}
    assert got[0]["dup_5gram_share"] == 0 and got[0]["dup_3gram_share"] == 1 and not got[0]["base_failed"]
    assert [got[k]["kept"] for k in range(3)] == [False, True, True]
    assert sorted(x["doc_id"] for x in corpus_pipeline.rules(spark, docs, "").collect()) == [1, 2]

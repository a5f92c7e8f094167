import random

from recurra.llm import near_dup
from recurra.llm.scratch import Scratch
from tests.llm.common import prose, table


def test_all_texts_of_a_pivots_id_are_compared(spark):
    r = random.Random(23)
    texts = [prose(r, 60) for _ in range(6)]
    rows = [(1, t, "en", "s", 0) for t in texts] + [(10 + k, t + " end", "en", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, table(spark, ["x"]).schema).select("doc_id", "text")
    scratch = Scratch(spark, "repeated_ids")
    pairs = scratch.save(spark.createDataFrame([(1, 10 + k) for k in range(6)], "p long, u long"))
    got = {tuple(x) for x in near_dup.verify(pairs, docs, 4, 0.8, scratch).collect()}
    assert got == {(1, 10 + k) for k in range(6)}

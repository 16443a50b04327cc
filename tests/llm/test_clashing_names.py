"""Copies and near copies leave columns alone that are called as the helpers' own."""

from foreslate.llm.exact_dedup import without_copies
from foreslate.llm.jaccard_join import Measure, without_near_copies

OWN = ["__row_id", "__row_sha", "__kept_id", "__KEPT_SHA", "__id", "__stays", "__norm", "node", "n"]


def test_columns_keep_their_names_and_values(spark):
    texts = {1: "a b c d e f", 2: "a  b c d e f", 3: "x y z u v w", 4: None}
    rows = [(i, t, *[f"{i}{c}" for c in OWN]) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *[f"`{c}` string" for c in OWN]]))
    want = sorted(str(r) for r in docs.where("doc_id != 2").collect())
    for kept in (without_copies(docs), without_near_copies(docs, Measure(5, 80, 100))):
        assert kept.columns == docs.columns
        assert sorted(str(r) for r in kept.collect()) == want

"""The last stage of the pipeline gives all segmentations that its operator finds."""

import numpy as np
from pyspark.sql import functions as F


def test_piece_ids_have_the_best_segmentations(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "A short text, segmented."), (2, "über uns ▁ 1234"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in p.piece_ids(spark, docs, "").collect()}
    assert {"doc_id", "n_pieces", "ids", "score", "lossless"} <= set(got[1].asDict())
    for k in (1, 2):
        row = got[k]
        assert len(row["scores"]) == 3 and len(row["others"]) == 2 and row["scores"] == sorted(row["scores"], reverse=True) and row["score"] == row["scores"][0]
        assert len({bytes(i) for i in (row["ids"], *row["others"])}) == 3 and row["n_pieces"] == len(np.frombuffer(row["ids"], "<u4"))
    others = p.piece_ids(spark, docs, "").select("doc_id", F.explode("others").alias("ids"))
    assert sorted((r["doc_id"], r["text"]) for r in p.pieces.decode(others).filter("doc_id < 3").collect()) == [(k, r) for k, r in ((1, "A short text, segmented."), (2, "über uns ▁ 1234")) for _ in range(2)]
    assert got[3]["lossless"] and got[3]["scores"][0] == got[3]["score"]

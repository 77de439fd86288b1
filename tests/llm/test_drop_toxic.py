"""The pipeline rejects by the language's own threshold."""

import math

from statuta.llm import toxicity


def test_own_threshold_decides(spark, monkeypatch):
    net = toxicity.ConvNet()
    net.trained, net.scale, net.shift, net.thresholds = True, 0.0, math.log(0.8 / 0.2), {"en": 0.95, "de": 0.4}  # every score is 0.8
    monkeypatch.setattr(toxicity, "fit", lambda sample: net)
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "a b c", "de"), (3, "a b c", "fr"), (4, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == {1, 4}

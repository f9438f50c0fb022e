"""Input columns named like the operators' helpers come back as they were; a repeated labelled id is one trial."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidespan.llm import decontaminate, quality, secret_scan

HELPERS = ["_stratum", "_cutoff", "_quality_counts", "_base", "_found", "_token", "_assign", "_access", "_hex", "_original", "_text_key", "_id_key", "aside_0_0"]


def test_helper_names_in_the_input(spark, docs_of):
    text = "the quick brown fox " * 30 + "password=hunter22"
    docs = docs_of([(1, text), (2, None), (3, text + " more"), (1, text)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, "quite another text of some words that stands nowhere else at all here")], "item_id long, text string")
    for out in (quality.quality_filter(docs, labels, quality.QualityConfig(max_repeat_percent=1000)), decontaminate.decontaminated(docs, items), secret_scan.redacted(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) >= 3 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)
        assert out.limit(0).count() == 0


def test_a_stratum_with_an_underscore(spark, docs_of):
    docs = docs_of([(1, "word " * 60)]).withColumn("_lang", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(docs, labels, quality.QualityConfig(stratum="_lang", max_repeat_percent=1000)).first()["_lang"] == "x"


def test_a_repeated_id_is_one_trial(spark, docs_of, monkeypatch):
    seen = []
    real = quality.cutoffs
    monkeypatch.setattr(quality, "cutoffs", lambda labelled, cfg: seen.append(labelled.collect()) or real(labelled, cfg))
    words = [" ".join(f"w{i}x{k}" for k in range(70)) for i in range(3)]
    docs = docs_of([(1, words[0])] * 40 + [(2, words[1]), (3, words[2])])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(docs, labels).count() == 42 and quality.quality_verdicts(docs, labels).count() == 42
    assert [len(x) for x in seen] == [2, 2]

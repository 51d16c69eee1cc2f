"""Each stage of the pipeline on a few documents."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import EN, FR, lines_of


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    own = [" ".join(lines_of(8, 20 + i)) for i in range(4)]
    rows = [(i, f"{EN}{x}", "en", "a") for i, x in enumerate(own)] + [(10 + i, FR * 3, "fr", "b") for i in range(2)] + [(20, None, "en", "a"), (21, "12 !!", None, None)]
    docs, columns = table(spark, rows), ["doc_id", "text", "lang", "source", "n_chars"]
    step = pipeline.languages(spark, docs, "")
    assert step.columns == columns and {r["doc_id"] for r in step.collect()} == {0, 1, 2, 3, 10, 11}
    step = pipeline.lines(spark, step, "")
    assert step.columns == columns and {r["doc_id"] for r in step.collect()} == {0, 1, 2, 3, 10}
    near = table(spark, [(0, own[0], "en", "a"), (1, own[0] + " more", "en", "a"), (2, own[1], "en", "b"), (2, own[1], "en", "b"), (3, None, "en", "b")])
    step = pipeline.near_duplicates(spark, near, "")
    assert step.columns == columns and sorted(r["doc_id"] for r in step.collect()) == [0, 2, 3]
    step = pipeline.mixture(spark, docs, "")
    assert step.columns == columns and step.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert pipeline.tokens(spark, docs, "").columns == ["doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(pipeline.STAGES) == 5

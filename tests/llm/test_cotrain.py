import pytest
from pyspark.sql import functions as F

from panelcast.llm import cotrain as C


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_labels_held_back_are_met(tables):
    docs, labels = tables
    unseen = F.pmod(F.hash("doc_id"), F.lit(3)) == 0
    got = C.score(docs, C.train(docs, labels.where(~unseen))).join(labels.where(unseen), "doc_id").collect()
    assert len(got) > 100
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) >= 0.97
    clean, toxic = [r for r in got if r.quality and not r.toxic], [r for r in got if r.toxic]
    assert sum(r.keep for r in clean) / len(clean) >= 0.97
    assert sum(not r.keep for r in toxic) / len(toxic) >= 0.8
    assert sum((r.toxic_score >= 0.5) == (r.toxic == 1) for r in got) / len(got) >= 0.95


ROWS = [(1, "Some plain text, with words.", "en", "a", 28, "x"), (2, None, None, None, None, "y"), (3, "", "", "", 0, "z"), (None, "null id", "en", "a", 7, "x"), (1, "Some plain text, with words.", "en", "a", 28, "x"),
        (4, "word " * 100_000, "de", "b", 500_000, "w"), (5, "!!! ### " * 50, "fr", "c", 400, "w")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string"


def test_odd_rows(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    targets = C.train(*tables)
    got = C.score(docs, targets).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert all(0 <= r.score <= 1 and 0 <= r.toxic_score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert C.score(docs.limit(0), targets).count() == 0


def test_without_labels_nothing_goes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = C.keep(docs, some)
        assert got.columns == docs.columns and got.count() == len(ROWS)
        assert C.score(docs, C.train(docs, some)).where("score IS NULL AND toxic_score IS NULL AND keep").count() == len(ROWS)


def test_bounds_are_kept(tables):
    docs, labels = tables
    own = labels.select(F.col("doc_id").alias("id"), *[F.col(t).cast("double").alias(t) for t in C.TARGETS])
    sample = C._sample(docs, own, docs.select(F.col("doc_id").alias("id")), 50, 70, {})
    assert sample.where("quality IS NOT NULL").count() == 50 and sample.where("quality IS NULL").count() == 70


def test_repeated_ids_stay_within_the_bounds(spark):
    """20,000 rows of one id, with two texts, are one row of the sample, whatever order they come in."""
    docs = spark.range(20_300).selectExpr("if(id < 20000, 7, id) AS doc_id", "if(id < 20000, concat('copy ', id % 2), concat('text ', id)) AS text", "'en' AS lang", "'a' AS source", "10L AS n_chars")
    own = spark.range(100).selectExpr("if(id = 0, 7, id + 20000) AS id", "id % 2 + 0.0D AS quality", "0.0D AS toxic")
    ids = docs.select(F.col("doc_id").alias("id"))
    got = C._sample(docs, own, ids, 200, 5_000, {}).collect()
    assert len(got) == len({r.id for r in got}) == 301 and sum(r.quality is not None for r in got) == 100
    again = C._sample(docs.orderBy(F.desc("text")), own, ids, 200, 5_000, {}).where("id = 7").collect()
    assert [r.words for r in again] == [r.words for r in got if r.id == 7]


def test_rare_classes_are_drawn_whole(spark):
    own = spark.createDataFrame([(i, 1.0, float(i % 100 == 0)) for i in range(2000)] + [(2000, 0.0, 1.0)], "id long, quality double, toxic double")
    drawn = C._per_class(own, 60).collect()
    assert len(drawn) == 60 and sum(r.toxic for r in drawn) == 21 and sum(r.quality == 0 for r in drawn) == 1
    assert abs(sum(r.stands_for for r in drawn) - 2001) < 1e-6 and {r.stands_for for r in drawn if r.toxic} == {1.0}


def test_a_rare_target_still_rejects(spark):
    """One label in 25, and a sample of a tenth of the labels: the rare ones are drawn whole, and unseen ones go."""
    calm, rude = "a quiet walk along the river and home for tea number {}", "you rotten filthy scoundrel get lost vile pest number {}"
    rows = [(i, (rude if i % 25 == 7 else calm).format(i)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, int(i % 25 == 7)) for i, _ in rows[:600]], "doc_id long, quality int, toxic int")
    got = C.score(docs, C.train(docs, labels, labelled_rows=60)).collect()
    assert all((r.toxic_score >= 0.5) == (r.doc_id % 25 == 7) for r in got)


def test_a_missing_class_is_said(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.warns(UserWarning, match="toxic = 1"):
        C.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int"))


def test_a_step_of_a_fit_is_a_small_job(spark):
    """The driver keeps something of every stage and task: a step of a fit has two stages of three tasks, and no job looks at the first row for its width."""
    words = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(["good", "fine"] * 2 if i % 2 else ["bad", "poor"] * 2) + " " + " ".join(words[(i * k) % 40] for k in range(1, 12))
    docs = spark.createDataFrame([(i, text(i), "en", "ab"[i % 2], 100) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    spark.sparkContext.setJobGroup("fits", "")
    C.train(docs, labels, rounds=1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    jobs = [[s for s in map(seen.getStageInfo, seen.getJobInfo(j).stageIds) if s] for j in seen.getJobIdsForGroup("fits")]
    steps = [stages for stages in jobs if any("RDDLossFunction" in s.name for s in stages)]
    assert len(steps) > 8 and all(len(stages) <= 2 and sum(s.numTasks for s in stages) <= 3 for stages in steps)
    assert not any("VectorAssembler" in s.name for stages in jobs for s in stages)

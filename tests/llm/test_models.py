from pyspark.sql import functions as F

from rankloom.llm import quality, toxicity
from rankloom.llm.storage import is_trained_on, read_table

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    rows = scored.join(read_table(spark, SF, "labels"), "doc_id").filter(~is_trained_on(F.col("doc_id"))).select("predicted", label).collect()
    right = sum(r.predicted == r[label] for r in rows) / len(rows)
    found = [r.predicted for r in rows if r[label] == (1 if label == "toxic" else 0)]
    return right, sum(x == (1 if label == "toxic" else 0) for x in found) / len(found)


def test_quality_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    model = quality.learn_quality(docs, read_table(spark, SF, "labels"))
    right, low = held_out(spark, quality.score_quality(docs, model), "quality")
    assert right > 0.99 and low > 0.98


def test_toxicity_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    model = toxicity.learn_toxicity(docs, read_table(spark, SF, "labels"))
    right, found = held_out(spark, toxicity.score_toxicity(docs, model), "toxic")
    assert right > 0.97 and found > 0.8


def test_without_labels_text_or_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "some words here", 0.2), (3, "some words here", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for learn, score in ((quality.learn_quality, quality.score_quality), (toxicity.learn_toxicity, toxicity.score_toxicity)):
        model = learn(docs, labels)
        rows = score(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(docs.limit(0), model).count() == 0
        nulls = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
        learn(docs, nulls)
    assert toxicity.drop_toxic(docs, toxicity.learn_toxicity(docs, labels)).columns == docs.columns


def test_clauses_weigh_targets_negation_and_reports():
    g = toxicity.Grammar({"idiot$": 2.0, "moro": 3.0})
    words = lambda s: g.clause(s.split())
    plain, aimed, denied, told = (words(s)[0] for s in ("an idiot here", "you are an idiot", "he is not an idiot", "someone said idiot"))
    assert aimed > plain > max(denied, told) > 0
    assert words("kill you")[1]["K"] == 1 and words("kill time")[1]["K"] == 0
    assert words("morons")[0] == 3.0 and words("idiotic")[0] == 0.0
    assert g.features("nothing here.") == [0.0] * toxicity.N_FEATURES
    two = g.features("You idiot. He said: fine. MORON!")
    assert two[0] == 1.0 and two[3] > g.features("You idiot.")[3]


def test_composed_machine_reads_every_class():
    arcs = toxicity.compose()
    start = ("0",) * len(toxicity.GRAMMAR)
    state, out, bonus = arcs[start, "T"]
    assert arcs[state, "I"][1] == "IT" and arcs[start, "I"][1] == "I"
    assert all(to in {s for s, _ in arcs} for to, _, _ in arcs.values())

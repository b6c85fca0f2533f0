import random

from pyspark.sql import functions as F

from caseweave.operators import trees
from caseweave.operators.incremental import IncrementalTrees
from caseweave.operators.learning import Settings
from caseweave.streaming.learning import StreamedTrees
from caseweave.streaming.pipeline import Discovery
from caseweave.streaming.tables import batch_ids

LOOSE = Settings(grace=100, delta=1e-3)
PAIR = ("a", "b")


def flipping_batches(make_log, n_batches=4, per_batch=300, seed=3):
    """Response[a, b] holds for x > 50 in the first half of the batches, for x <= 50 in the second."""
    draw, bags, traces = random.Random(seed), {}, {}
    for batch in range(n_batches):
        for i in range(per_batch):
            x = draw.randrange(100)
            case = f"c{batch}_{i}"
            bags[case] = {"x": str(x), "who": f"w{draw.randrange(200)}", "batch": str(batch)}
            traces[case] = "ab" if (x > 50) == (batch < n_batches // 2) else "ac"
    log = make_log(traces, attrs=lambda c, i, a: bags[c])
    number = F.col("attrs")["batch"].cast("int")
    clean = log.withColumn("batch", number).withColumn("attrs", F.map_filter("attrs", lambda k, _: k != "batch"))
    return [clean.filter(F.col("batch") == b).drop("batch") for b in range(n_batches)]


def leaves(rows):
    return sorted((r.node, str(r.steps), r.n1, r.n0) for r in rows.collect())


def test_state_in_tables_equals_a_learner_in_memory(spark, make_log, tmp_path):
    """A new object for every batch (a restart), and a batch twice (a repeat after a failure)."""
    batches = flipping_batches(make_log)
    folder = str(tmp_path / "trees")
    before = StreamedTrees(folder)
    assert before.leaves(spark) is None and before.rules(spark) is None and before.prequential_f1(spark) is None
    for number, log in enumerate(batches):
        for _ in range(2 if number == 2 else 1):
            StreamedTrees(folder, ["Response"], LOOSE).process(log, [PAIR], number)
    streamed = StreamedTrees(folder, ["Response"], LOOSE)

    cuts = trees.freeze(trees.cut_points(batches[0]))
    learner = IncrementalTrees(LOOSE).learn((n, trees.activations(log, [PAIR], ["Response"], cuts=cuts)) for n, log in enumerate(batches))
    assert leaves(streamed.leaves(spark)) == leaves(learner.leaves())
    (score,), (want,) = streamed.prequential_f1(spark).collect(), learner.total_scores().collect()
    assert (score.tp, score.fp, score.fn) == (want.tp, want.fp, want.fn)
    assert [(r.template, r.first, r.second, r.node, r.batch) for r in streamed.resets(spark).collect()] == [("Response", "a", "b", "", 2)]
    (rule,) = streamed.rules(spark).filter("template = 'Response'").collect()
    assert rule.condition.startswith("x <= ")
    since = sum(log.filter("activity = 'a'").count() for log in batches[2:])
    assert sum(r.n1 + r.n0 for r in streamed.leaves(spark).collect()) == since  # nothing is lost by splits
    assert batch_ids(spark, folder) == [2, 3]  # older states are gone


def test_pairs_that_come_late_keep_the_numbers_of_the_others(spark, make_log, tmp_path):
    one, two = flipping_batches(make_log, n_batches=2)
    streamed = StreamedTrees(str(tmp_path / "trees"), ["Response"], LOOSE)
    streamed.process(one, [PAIR], 0)
    streamed.process(two, [("a", "c"), PAIR], 7)
    seen = {(r.first, r.second): r.n for r in streamed.leaves(spark).groupBy("first", "second").agg(F.sum(F.col("n1") + F.col("n0")).alias("n")).collect()}
    a = [log.filter("activity = 'a'").count() for log in (one, two)]
    assert seen[("a", "c")] == a[1] and seen[PAIR] == sum(a)  # errors of one batch alone reset nothing


def test_discovery_learns_from_a_stream(spark, make_log, tmp_path):
    """From events to rules: traces are assembled, candidates found, and each batch is scored, then learnt."""
    first, second = flipping_batches(make_log, n_batches=4)[:2]
    src = str(tmp_path / "src")
    clock = make_log({"sign": "z"}).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS")).withColumn("is_end", F.lit(False))
    for part in (first, second, clock.select(first.columns)):
        part.coalesce(1).write.mode("append").parquet(src)
    job = Discovery(str(tmp_path / "out"), min_support=0.3, settings=LOOSE, adaptive=True)
    stream = spark.readStream.schema(first.schema).parquet(src)
    job.start(stream, str(tmp_path / "cp"), trigger={"availableNow": True}, shards=2).awaitTermination()
    rule = job.rules(spark).filter("template = 'Response' AND first = 'a' AND second = 'b'").collect()
    assert [r.condition.split(" > ")[0] for r in rule] == ["x"]
    released = spark.read.parquet(job.traces_path)
    n = {(r.template, r.first, r.second): r.n_activations for r in job.ratios(spark).collect()}
    assert n["Response", "a", "b"] == released.filter("activity = 'a'").count() == 600
    scores = job.prequential_f1(spark).filter("template = 'Response' AND first = 'a' AND second = 'b'").collect()
    assert [s.tp + s.fn for s in scores] == [released.filter("activity = 'b'").count()]

from corpuslab.llm import mixing


def test_the_schedule_gives_the_candidates(spark):
    # c has enough blocks by the schedule, though not by the tokens of this made-up plan
    rows = [("a", 3, 2, 10.0, 15.0, 30.0), ("b", 2, 2, 10.0, 19.0, 20.0), ("c", 2, 3, 10.0, 25.0, 30.0), ("d", 1, 1, 10.0, 10.0, 10.0)]
    plan = spark.createDataFrame(rows, "source string, due_blocks long, ready_blocks long, block double, supply double, demand double")
    assert sorted(r.source for r in mixing.scheduled_shortages(plan, 10).collect()) == ["a", "b"]


def test_candidates_lose_no_short_source(spark):
    sized = spark.createDataFrame([(i, f"s{i}", n) for i, n in enumerate((0, 1, 699, 700, 701, 7899))], "doc_id long, source string, tokens long")
    goals = [(f"s{i}", share, 1) for i, share in enumerate((1e-14, 0.00015, 0.07, 0.07, 0.07, 0.8))]
    plan = mixing.mix_plan(sized, spark.createDataFrame(goals, "source string, target_share double, max_repeat long"))
    short = sorted(r.source for r in plan.filter("supply < demand").collect())
    assert short and sorted(r.source for r in mixing.scheduled_shortages(plan).collect()) == short


def test_small_blocks_stay_within_one_block(spark):
    docs = [(i, "a" if i % 10 < 7 else "b", 3 + i % 5) for i in range(3000)] + [(9000, "c", 40)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 1)], "source string, target_share double, max_repeat long")
    plan = mixing.mix_plan(sized, goals, 10, 100)
    total = sum(n for _, _, n in docs)
    block = plan.first().block
    assert block <= 100 and plan.first().rounds == -(-total // 1000)
    rows = sorted(mixing.mix(sized, plan, 10, 3).collect(), key=lambda r: r.slot)
    assert max(r.slot for r in rows) < 10 * plan.first().rounds
    for source, share in (("a", 0.4), ("b", 0.3)):
        done = 0
        for r in rows:
            if r.source == source:
                done += r.tokens
                assert abs(done - share * (r.slot + 1) * block) < 2 * block + 8
    assert [r.source for r in mixing.scheduled_shortages(plan, 10).collect()] == ["c"]


def test_deadlines_are_missed_by_sources_that_run_out():
    placed, missed = mixing.pfair_schedule([6, 4], [3, 4], 10)
    assert missed == {0} and sum(s == 0 for _, s, _ in placed) == 3 and sum(s == 1 for _, s, _ in placed) == 4

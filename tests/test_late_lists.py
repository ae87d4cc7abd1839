"""What settings that come late change, in one pass over both lists."""

import random

from pyspark.sql import functions as F

from tidemark.operators import suppress


def test_both_lists_meet_the_rows_once(spark):
    """The plan cuts ids at their dashes once and joins each kind once; changes are those of hiding twice."""
    rnd = random.Random(2)
    some = lambda n: [f"{rnd.choice('ab')}-{rnd.randrange(40)}" for _ in range(n)]
    rows = spark.createDataFrame([(i, rnd.choice(["Van", "ORDU", None]), rnd.choice(["Ünye", "Fatsa", None]), n) for n, i in enumerate([*some(200), None, "", "7"])], "id string, province string, district string, _sides int")
    lists = [suppress.hides(spark, p, d, [*some(12), *(str(rnd.randrange(40)) for _ in range(9)), None, "7"]) for p, d in ((["van"], ["Ordu/unye"]), ([], ["ordu/FATSA", "van/ünye", "ordu"]))]
    got = suppress.late_changes(rows, *lists)
    assert got.columns == [*rows.columns, "change"]
    was, now = ({r["_sides"] for r in suppress.hidden_by(rows, h).where("hidden").collect()} for h in lists)
    assert {(r["_sides"], r.change) for r in got.collect()} == {(n, "withdrawn") for n in now - was} | {(n, "returned") for n in was - now} and was - now and now - was
    plan = got.select(F.col("_sides"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4 and plan.count("Generate explode") == 1

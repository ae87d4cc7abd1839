"""Rounds of the ordered merge cost what still waits, not what is settled."""

import random

from test_hot_groups import merged


def test_later_rounds_hold_only_what_waiting_rows_look_for(spark):
    """Hundreds of rows are settled at once; one chain with a correction waits on, and only its few cells stay."""
    rnd = random.Random(4)
    feed = [(f"f{n}", n, "s", f"k{n}", 40, [rnd.randrange(100)], None) for n in range(600)]
    chain = [(f"c{n}", 1000 + n, "s", "same", 40, [2 * n], "b0" if n == 5 else None) for n in range(12)]
    base = [(f"b{n}", n, "s", "other" if n else "same", 40, [-1 if n == 0 else n]) for n in range(300)]
    got, want, done = merged(spark, base, feed + chain)
    assert got == want and len(done.kept) > 2
    assert done.cells.count() < 100
    assert sum(t.count() for t in done.told) == 1 and sum(t.count() for t in done.kept) > 500


def test_random_merges_over_many_days(spark):
    """Days around a cell, unknown ages and ids in three scopes, against the plain fold (in which null keys, left out here, would be alike)."""
    rnd = random.Random(11)
    base, feed = [], []
    for scope in "abc":
        row = lambda n: (f"i{rnd.randrange(60)}", n, scope, rnd.choice(["k", "m"]), rnd.choice([None, 5, 6, 7, 30]), [rnd.randrange(120) for _ in range(rnd.randrange(3))])  # noqa: E731, B023
        base += [row(n) for n in range(10)]
        feed += [(*row(n), rnd.choice([None] * 9 + [f"i{rnd.randrange(60)}"])) for n in range(90)]
    got, want, done = merged(spark, base, feed)
    assert got == want and len(done.kept) > 1

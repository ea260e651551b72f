"""SQL functions against plain loops, with nulls, ties and empty input."""

import random

from lineproof.functions import surface


def test_first_wins_and_union_box(spark):
    surface.register(spark)
    surface.register(spark)
    one = spark.sql("""select first_wins(array(struct(2L, 'a'), struct(1L, 'b'), struct(3L, 'b'), struct(1L, 'a'))) as v, first_wins(cast(array() as array<struct<place: bigint, value: string>>)) as none,
        union_box(array(struct(5L, 6L, 2L, 2L), struct(1L, 7L, 3L, 9L))) as b, union_box(array(struct(5L, 6L, 2L, cast(null as bigint)))) as lacking, first_wins(array(struct(1L, cast(null as string)), struct(2L, 'x'), struct(3L, null))) as nulls""").first()
    assert (one.v, one.none, tuple(one.b), one.lacking, one.nulls) == (["a", "b"], [], (1, 6, 6, 10), None, [None, "x"])


def test_greedy_batches(spark):
    surface.register(spark)
    r = random.Random(3)
    rows = [(k, p, r.choice([None, 0, 5, 40, 90, 500])) for k in range(12) for p in range(r.randint(1, 30))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, pos long, size long")
    got = {(x.key, x.pos): x.batch for x in spark.sql("select * from greedy_batches(table(select * from {df}) partition by (key) order by (pos), 3, 100)", df=df).collect()}
    want = {}
    for key in range(12):
        batch = n = held = 0
        for _, pos, size in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if n and (n == 3 or held + (size or 0) > 100):
                batch, n, held = batch + 1, 0, 0
            n, held = n + 1, held + (size or 0)
            want[key, pos] = batch
    assert got == want
    assert spark.sql("select * from greedy_batches(table(select * from {df} where key < 0) partition by (key) order by (pos), 3, 100)", df=df).count() == 0

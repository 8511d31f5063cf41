"""What a tile's fold gathers doesn't grow with the tile."""

import random

from parcelry.operators.campaign import campaign, cells, schedule
from test_campaign import SCHEMA, made, simulate


def test_one_tile_of_many_parcels(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(k, 1, rng.random(), 1, rng.random()) for k in range(5000)], SCHEMA)
    falling = sorted({t for t, _ in schedule(min_digs=3)}, reverse=True)
    counts = cells(df, ["tile_id"], falling, "other", "prob").collect()
    assert len(counts) <= (len(falling) + 1) ** 2 and sum(r["n"] for r in counts) == 5000


def test_order_is_that_of_the_simulation(spark):
    rows = made(11, n=300, tiles=2)
    got = campaign(spark.createDataFrame(rows, SCHEMA), min_digs=4, choose="other").orderBy("dig_index").collect()
    assert [(r["pid"], r["dig_batch"]) for r in got] == [x[:2] for x in simulate(rows, least=4, choose=4)]

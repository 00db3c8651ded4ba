"""Counts after each batch are those of a fresh pass over what the entities are then."""

import random

import pytest
from pyspark.sql import functions as F

from cataloom import record_queries
from cataloom.operators.facets import facet_cells
from cataloom.operators.filters import Selection, catalogue_view
from cataloom.streaming.live_facets import LiveFacets

DATA = "/root/testdata/sf0.001"
FIELDS = "id long, company_name string, expos array<string>, hq_country string, cat_l1_ids array<int>, cat_l2_ids array<int>, _seq long, _deleted boolean"


def counted(df, selection):
    rows = catalogue_view(df).select(F.explode(facet_cells(selection)).alias("c")).groupBy("c.dim", "c.value").count().collect()
    return {(r["dim"], r["value"]): r["count"] for r in rows}


@pytest.mark.parametrize("selection", [Selection(), Selection(expo="T", countries=("Japan",), l1=(10,))])
def test_counts_follow_upserts(spark, tmp_path, selection):
    r, live = random.Random(3), LiveFacets(spark, str(tmp_path / "live"), selection)
    now, seq = {}, 0
    for batch in range(3):
        rows = []
        for _ in range(40):
            seq += 1
            i = r.randrange(25)
            row = (i, f"n{i}", r.choices("TJK", k=r.randrange(1, 3)), r.choice(["Japan", "Taiwan", None]), r.sample([10, 20, 30], 2), r.sample([101, 201, 301], 1), seq, batch > 0 and r.random() < 0.2)
            rows.append(row)
            now[i] = row
        if batch == 2:  # late records of entities that are newer by now
            rows += [(i, "late", ["T"], "Japan", [10], [101], 0, False) for i in range(25) if i in now]
        df = spark.createDataFrame(rows, FIELDS)
        view = catalogue_view(df)
        view.write.mode("append").parquet(str(tmp_path / "in"))
        live.follow(str(tmp_path / "in"), view.schema).awaitTermination()
        want = counted(spark.createDataFrame([x for x in now.values() if not x[-1]], FIELDS), selection)
        assert {(x["dim"], x["value"]): x["n"] for x in live.counts().collect()} == want
    # a batch that comes again changes nothing
    before = live.counts().collect()
    live._fold(spark.createDataFrame([("expos", "T", 5)], "dim string, value string, delta long"), 2)
    assert sorted(live.counts().collect()) == sorted(before)


def test_query_reads_the_deliveries_once(spark, monkeypatch):
    reads, catalogue = [], record_queries.catalogue

    def read(s, sf_dir):
        count = spark.sparkContext.accumulator(0)
        reads.append(count)

        def noted(batches):
            for b in batches:
                count.add(b.num_rows)
                yield b

        df = catalogue(s, sf_dir)
        return df.mapInArrow(noted, df.schema)

    monkeypatch.setattr(record_queries, "catalogue", read)
    record_queries.live_facets(spark, DATA).collect()
    assert [r.value for r in reads] == [spark.read.parquet(f"{DATA}/supplier.parquet").count()]

from pyspark.sql import functions as F

from tabsmith.operators import score as sc
from tabsmith.session import scratch_path
from tabsmith.sources import io
from tabsmith.streaming import stream as st
from tests.conftest import SF001


def test_csv_na_tokens_and_json_array(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("id,name,score\n1,NA,2.5\n2,bob,\n3,N/A,NaN\n")
    df = io.load(spark, str(csv), "csv")
    rows = {r.id: r for r in df.collect()}
    assert rows[1].name is None and rows[3].name is None and rows[2].score is None
    assert rows[3].score is None  # NaN -> NULL at load
    js = tmp_path / "b.json"
    js.write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert io.load(spark, str(js), "json").count() == 2


def test_stream_totals_equal_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = scratch_path(spark, "test-stream")
    ev.repartition(5, "event_id").write.parquet(src)
    s = st.file_stream(spark, src, ev.schema)
    agg = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    out = spark.read.parquet(st.run_to_table(agg, scratch_path(spark, "test-stream-out"), mode="complete"))
    batch = {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in out.collect()} == batch


def test_parse_rows_numbers_and_text(spark):
    df = spark.createDataFrame([("25, 50000, yes",), ("x, 1.5, 0",)], "t string")
    r = sc.parse_rows(df, "t", ["a", "b", "c"]).collect()
    assert (r[0].a, r[0].b, r[0].c, r[0].c_text) == (25.0, 50000.0, None, "yes")
    assert (r[1].a, r[1].a_text, r[1].b) == (None, "x", 1.5)


def test_csv_types_depend_on_the_values_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("yn,clock,zero,day,at,gap_int,gap_bool,gap_clock,gap_day,text,big,exp,none,hex\n"
                                    "Y,12:30,007,2024-01-02,2024-01-02T03:04:05,1,true,12:30,2024-01-01,a,99999999999,1e3,,1d\n"
                                    "N,08:15,010,2024-01-03,2024-01-02 03:04,NA,NA,NA,NA,b,1, 2.5 ,NA,2d\n")
    df = io.load(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"yn": "string", "clock": "string", "zero": "int", "day": "date", "at": "timestamp", "gap_int": "int", "gap_bool": "boolean",
                               "gap_clock": "string", "gap_day": "date", "text": "string", "big": "bigint", "exp": "double", "none": "string", "hex": "string"}
    rows = df.orderBy("zero").collect()
    assert (rows[0].yn, rows[0].clock, rows[0].zero, rows[0].exp, rows[1].exp, rows[1].gap_bool) == ("Y", "12:30", 7, 1000.0, 2.5, None)

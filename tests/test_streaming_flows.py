"""Streaming ingest idempotency, streaming keep-first, and the daily flow."""


from leadsmith.plans.flows import clean_contacts, daily_run
from leadsmith.session import scratch_path
from leadsmith.sources.derived import name_gender_table, posting_detail_pages, posting_listing_pages
from leadsmith.streaming.ingest import ingest_contacts, keep_first_to_table, landed_files
from tests.conftest import SF_SMALL, rows


def _landing(spark, tmp_path, batches):
    land = str(tmp_path / "landing")
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, "ingest_seq long, company string, person string, email string") \
            .coalesce(1).write.mode("append").parquet(land)
    return land


def test_ingest_twice_adds_nothing(spark, tmp_path):
    land = _landing(spark, tmp_path, [
        [(1, "c", "p", "a@ok.example"), (2, "c", "p", "b@hays.de"), (3, "c", "q", "a@ok.example")],
        [(4, "c", "r", "n@ok.example")],
    ])
    schema = spark.read.parquet(land).schema
    master = str(tmp_path / "master")

    def clean(batch, m):
        return clean_contacts(batch, m)

    ingest_contacts(spark, land, schema, master, str(tmp_path / "ck1"), clean, max_files_per_trigger=1)
    first = rows(spark.read.parquet(master), "email", "person")
    assert first == [("a@ok.example", "p"), ("n@ok.example", "r")]
    # a replay from scratch (new checkpoint) finds everything in the master already
    ingest_contacts(spark, land, schema, master, str(tmp_path / "ck2"), clean)
    assert rows(spark.read.parquet(master), "email", "person") == first


def test_streaming_keep_first_keys(spark, tmp_path):
    src = f"{SF_SMALL}/events.parque[t]"
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "user_id").schema
    stream = landed_files(spark, src, schema, base_path=SF_SMALL)
    out = str(tmp_path / "out")
    keep_first_to_table(stream, ["user_id"], "ts", out, str(tmp_path / "ck"))
    got = spark.read.parquet(out).select("user_id")
    want = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct()
    assert got.count() == got.distinct().count() == want.count()


def test_streaming_keep_first_over_batches(spark, tmp_path):
    land = str(tmp_path / "events")
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "user_id")
    for i in range(4):
        df.where(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(land)
    out = str(tmp_path / "out")
    for run in ("ck1", "ck2"):      # a replay adds nothing
        stream = landed_files(spark, land, df.schema, max_files_per_trigger=1)
        keep_first_to_table(stream, ["user_id"], "ts", out, str(tmp_path / run))
        got = spark.read.parquet(out).select("user_id")
        assert got.count() == got.distinct().count() == df.select("user_id").distinct().count()


def test_streaming_keep_first_of_late_keys(spark, tmp_path):
    land, out = str(tmp_path / "events"), str(tmp_path / "out")
    # One file per micro-batch; users 3 to 5 first occur in later files, days back.
    for k, part in enumerate(([(1, "2024-03-20", 1), (2, "2024-03-19", 2)], [(3, "2024-03-21", 1), (4, "2024-03-22", 2)],
                              [(5, "2024-03-02", 3), (6, "2024-03-01", 3)], [(7, "2024-02-01", 4), (8, "2023-01-01", 5)])):
        df = spark.createDataFrame(part, "event_id long, d string, user_id long")
        df = df.selectExpr("event_id", "cast(d AS timestamp_ntz) AS ts", "user_id")
        df.coalesce(1).write.mode("append").parquet(land)
        for run in ("ck1", "ck2") if k == 3 else ("ck1",):      # a replay adds nothing
            stream = landed_files(spark, land, df.schema, max_files_per_trigger=1)
            keep_first_to_table(stream, ["user_id"], "ts", out, str(tmp_path / run))
    assert rows(spark.read.parquet(out), "event_id", "user_id") == [(1, 1), (2, 2), (6, 3), (7, 4), (8, 5)]


def test_daily_run_master_is_idempotent(spark):
    master = spark.createDataFrame(
        [], "company string, person string, email string, gender string, first_name string, last_name string")
    listing, pages = posting_listing_pages(spark, SF_SMALL), posting_detail_pages(spark, SF_SMALL)
    raw_base = spark.createDataFrame([], "url string, project_name string, project_description string, "
                                         "company string, person string, email string")

    def day(raw, agencies, known):
        return daily_run(listing, pages, raw, agencies, known, name_gender_table(spark), scratch_path(spark, "day"))

    first = day(raw_base, raw_base, master)
    m1 = first["master"]
    assert m1.count() == m1.select("email").distinct().count() > 0
    second = day(first["raw"], first["agencies"], m1)
    assert rows(second["master"]) == rows(m1) and rows(second["agencies"]) == rows(first["agencies"])
    assert second["contacts"].count() == 0


def test_scratch_paths_are_unique(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")

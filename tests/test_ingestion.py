import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adinsight.plans import source_queries
from adinsight.sources import bundle_sink, report_files, typed_views
from adinsight.sources.budget_files import budget_lines, find_header, read_budget
from adinsight.sources.warehouse import (
    Warehouse, client_rollup, client_slug, coverage, load_folder, unmapped_files,
)
from adinsight.streaming.arrivals import accept, watch_clients, watch_folder

TERMS = (
    "﻿Search terms report\n"
    '"January 1, 2025 - July 13, 2026"\n'
    "Search term,Match type,Added/Excluded,Campaign,Clicks,Impr.,Cost,Conversions,Cost,,\n"
    '"blue widget, large",Broad match,None,--,"1,204","20,001","$1,234.50",3.00,1\n'
    '"two\nlines",Exact match,Added,--,0,< 10%,--,,2\n'
    "short,Exact match\n"
    "long,Exact match,Added,C,1,2,3,4,5,6,7,8,9\n"
    ",,,,,,,,\n"
    "Total: account,,,,1204,,,,\n"
    "Total,,,,1204,20001,1234.5,3,3\n"
)
KEYWORDS = (
    "Keywords\n2025-01-01 - 2025-02-28\n"
    "Search keyword,Search keyword match type,Campaign,Ad group,Quality Score,Exp. CTR,Ad relevance,Landing page exp.,Clicks,Cost\n"
    "alpha,Exact match,C1,G1,{qs},Average,Average,{lp},10,5.5\n"
    "beta,,C1,G1,7,Average,--,Average,10,5.5\n"
)
CAMPAIGNS = (
    "Campaigns\n\"January 1, 2025 - March 13, 2025\"\nCampaign,Campaign type,Month,Clicks,Impr.,Cost,Conversions,Conv. value\n"
    "Search | A,Search,January 2025,10,100,50.5,2,20\nSearch | A,Search,February 2025,10,100,50.5,2,20\n"
)


@pytest.fixture
def folder(tmp_path):
    files = {
        "a_terms.csv": TERMS, "b_short.csv": "x\ny\nz\n", "c_unknown.csv": "t\nw\nFoo,Bar\n1,2\n",
        "k1.csv": KEYWORDS.format(qs=3, lp="Average"), "m.csv": CAMPAIGNS,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def frames(spark, folder):
    paths = report_files.list_reports(str(folder))
    files = report_files.describe_files(report_files.read_cells(spark, paths, "headers"))
    return files, report_files.records(report_files.read_cells(spark, paths), files)


def test_scan_parses_quotes_totals_and_ragged_rows(spark, folder):
    files, rows = frames(spark, folder)
    info = {r["source_file"]: r for r in files.collect()}
    assert set(info) == {"a_terms.csv", "c_unknown.csv", "k1.csv", "m.csv"}
    terms = info["a_terms.csv"]
    assert terms["window_raw"] == "January 1, 2025 - July 13, 2026"
    assert (terms["window_start"], terms["window_end"]) == (dt.date(2025, 1, 1), dt.date(2026, 7, 13))
    assert terms["keys"] == ["search_term", "match_type", "added_excluded", "campaign", "clicks", "impr", "cost",
                             "conversions", "cost_1"]
    assert terms["report_type"] == "search_terms" and info["c_unknown.csv"]["report_type"] is None
    got = [r["record"] for r in rows.filter("source_file = 'a_terms.csv'").orderBy("row_index").collect()]
    assert [r["search_term"] for r in got] == ["blue widget, large", "two\nlines", "short", "long", "Total: account"]
    assert got[0]["campaign"] is None and got[0]["cost"] == "$1,234.50" and got[0]["cost_1"] == "1"
    assert got[1]["impr"] is None and got[1]["cost"] is None
    assert got[2]["clicks"] is None and len(got[3]) == 9


def test_landing_types_metrics_and_entity(spark, folder):
    _, rows = frames(spark, folder)
    landed = {(r["report_type"], r["row_index"]): r for r in report_files.land_rows(rows).collect()}
    first = landed[("search_terms", 0)]
    assert (first["entity"], first["clicks"], first["impressions"], first["cost"]) == ("blue widget, large", 1204.0, 20001.0, 1234.5)
    assert landed[("campaign_performance", 1)]["date"] == "February 2025"
    assert landed[("search_terms", 1)]["cost"] is None


def test_numeric_columns_use_the_share(spark, folder):
    _, rows = frames(spark, folder)
    flags = {(r["source_file"], r["column"]): r["is_numeric"]
             for r in report_files.numeric_columns(rows, ["source_file"]).collect()}
    assert flags[("a_terms.csv", "clicks")] and not flags[("a_terms.csv", "search_term")]


def test_numbered_slug_meets_a_genuine_one(spark):
    df = spark.createDataFrame([("f", "w", ["Cost", "Cost", "Cost 1", "", " "])], "file string, window_raw string, cells array<string>")
    row = report_files.describe_files(df).first()
    assert row["slugs"] == ["cost", "cost_1", "cost_1_1"] or row["keys"][-1] == "cost_1"
    assert len(set(row["keys"])) == len(row["keys"])


def test_snapshot_replace_preserves_scores_and_other_clients(spark, folder, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    ledger = {r["report_type"]: r["row_count"] for r in load_folder(house, "one", str(folder)).collect()}
    assert ledger == {"search_terms": 5, "search_keyword_qs": 2, "campaign_performance": 2}
    load_folder(house, "two", str(folder))
    before = house.rows().filter("client_id = 'two'").count()

    # a second file of the same type wins by name; earlier scores override its values
    (folder / "k2.csv").write_text(KEYWORDS.format(qs=9, lp="--") + "gamma,Exact match,C1,G1,5,Average,Average,Average,1,1\n")
    (folder / "a_terms.csv").write_text("t\nJan 1, 2025 - Jan 31, 2025\nSearch term,Clicks\nTotal,5\n")
    again = {r["report_type"]: (r["source_file"], r["row_count"]) for r in load_folder(house, "one", str(folder)).collect()}
    assert again["search_keyword_qs"] == ("k2.csv", 3) and again["search_terms"] == ("a_terms.csv", 0)
    mine = house.rows().filter("client_id = 'one'")
    kept = {r["entity"]: r["record"] for r in mine.filter("report_type = 'search_keyword_qs'").collect()}
    assert kept["alpha"]["quality_score"] == "3" and kept["alpha"]["landing_page_exp"] == "Average"
    assert kept["beta"]["ad_relevance"] is None and kept["gamma"]["quality_score"] == "5"
    assert mine.filter("report_type = 'search_terms'").count() == 0
    assert house.rows().filter("client_id = 'two'").count() == before

    # loading the same folder again changes nothing
    def content():
        return sorted(map(repr, house.rows().filter("client_id = 'one'").drop("record").collect()))

    once = content()
    load_folder(house, "one", str(folder))
    assert content() == once


def test_coverage_rollup_and_unmapped(spark, folder, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    assert house.rows().count() == 0
    load_folder(house, "one", str(folder))
    rows = coverage(house.uploads()).collect()
    assert {r["coverage"] for r in rows} == {"3/12"} and sum(not r["loaded"] for r in rows) == 9
    clients = spark.createDataFrame([("one", "One"), ("none", "A none")], "client_id string, name string")
    assert [(r["client_id"], r["reports_loaded"]) for r in client_rollup(clients, house.uploads()).collect()] == [("none", 0), ("one", 3)]
    assert {r["source_file"] for r in unmapped_files(spark, str(folder)).collect()} == {"b_short.csv", "c_unknown.csv"}


def test_typed_views(spark, folder, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    load_folder(house, "one", str(folder))
    camps = typed_views.typed_view(house.rows(), "campaign_performance")
    assert [r["month_start"] for r in camps.orderBy("row_index").collect()] == [dt.date(2025, 1, 1), dt.date(2025, 2, 1)]
    terms = typed_views.typed_view(house.rows(), "search_terms").orderBy("row_index").first()
    assert terms["extra"] == {"match_type": "Broad match", "cost_1": "1"}
    root = str(tmp_path_factory.mktemp("typed"))
    typed_views.materialise(house.rows(), root)
    assert spark.read.parquet(f"{root}/search_keyword_qs").count() == 2


def test_bundle_sink_writes_sections(spark, tmp_path):
    sections = {"one": spark.range(2), "two": spark.range(1).withColumn("x", F.lit(None).cast("string"))}
    bundle_sink.write_bundle(sections, "c", str(tmp_path / "out"))
    bundle_sink.write_bundle({"two": sections["two"]}, "c", str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted((r["section"], r["value"]) for r in back.collect()) == [
        ("one", '{"id":0}'), ("one", '{"id":1}'), ("two", '{"id":0,"x":null}')]


def budget_rows(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_index bigint, cells array<string>")


def test_budget_header_in_a_later_row(spark, tmp_path):
    path = tmp_path / "budget.csv"
    path.write_text('Plan 2026\n\nBusiness Unit,Market,Service Line,Annual Budget\nA,North,Tires,"$12,000"\nB,,Brakes,-\nC,South,,600\n')
    got = sorted(map(tuple, read_budget(spark, str(path), "annual").collect()))
    assert got == [("A", "North", "Tires", 1000.0), ("C", "South", None, 50.0)]
    total = read_budget(spark, str(path), "total", 6).filter("brand = 'A'").first()
    assert total["monthly"] == 2000.0


def test_budget_short_keys_match_whole_words(spark):
    rows = budget_rows(spark, [["Region", "Budget"], ["N", "10"]])
    head = find_header(rows).first()
    assert (head["brand"], head["region"], head["amount"]) == (None, 0, 1)
    head = find_header(budget_rows(spark, [["Location", "Budget"], ["N", "10"]])).first()
    assert (head["region"], head["category"]) == (0, None)
    assert find_header(budget_rows(spark, [["Foo", "Budget"], ["N", "10"]])).isEmpty()
    assert budget_lines(rows).collect()[0]["monthly"] == 10.0


def test_budget_header_depth(spark):
    rows = budget_rows(spark, [["note"]] * 8 + [["Region", "Budget"], ["N", "10"]])
    assert [r.monthly for r in budget_lines(rows, header_rows=9).collect()] == [10.0]
    with pytest.raises(Exception, match="no budget header in the first 5 rows"):
        budget_lines(rows).collect()


def test_budget_without_header_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Foo,Bar\n1,2\n")
    with pytest.raises(ValueError):
        read_budget(spark, str(path))


def test_client_slug(one):
    assert one(client_slug(F.lit("  Smith & Sons Ltd. "))) == "smith-sons-ltd"
    assert one(client_slug(F.lit("!!"))) == "client"


def test_arriving_files_are_loaded_once(spark, folder, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    check = str(tmp_path_factory.mktemp("check"))

    def run():
        query = watch_folder(house, "one", str(folder), check)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r["report_type"]: r["row_count"] for r in house.uploads().collect()}

    assert run() == {"search_terms": 5, "search_keyword_qs": 2, "campaign_performance": 2}
    stamp = house.uploads().agg(F.max("uploaded_at")).first()[0]
    assert run()["search_terms"] == 5
    assert house.uploads().agg(F.max("uploaded_at")).first()[0] == stamp
    (folder / "z.csv").write_text(TERMS.replace('"two\nlines",Exact match,Added,--,0,< 10%,--,,2\n', ""), encoding="utf-8")
    assert run()["search_terms"] == 4


def scores(house):
    rows = house.rows().filter("report_type = 'search_keyword_qs'").collect()
    return {r["entity"]: (r["record"]["quality_score"], r["record"]["landing_page_exp"]) for r in rows}


def test_keyword_files_alone_load_and_reload(spark, tmp_path_factory):
    src, house = tmp_path_factory.mktemp("in"), Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    (src / "k1.csv").write_text(KEYWORDS.format(qs=3, lp="Average"), encoding="utf-8")
    assert [r["report_type"] for r in load_folder(house, "one", str(src)).collect()] == ["search_keyword_qs"]
    assert scores(house)["alpha"] == ("3", "Average")
    (src / "k1.csv").write_text(KEYWORDS.format(qs="--", lp="Above average"), encoding="utf-8")
    load_folder(house, "one", str(src))
    assert scores(house)["alpha"] == ("3", "Average")


def test_scores_of_an_earlier_file_of_the_same_load_survive(spark, tmp_path_factory):
    src, house = tmp_path_factory.mktemp("in"), Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    (src / "k1.csv").write_text(KEYWORDS.format(qs=3, lp="Average"), encoding="utf-8")
    (src / "k2.csv").write_text(KEYWORDS.format(qs="--", lp="--"), encoding="utf-8")
    load_folder(house, "one", str(src))
    assert scores(house)["alpha"] == ("3", "Average") and house.uploads().first()["source_file"] == "k2.csv"


def test_unmapped_files_alone_load_nothing(spark, tmp_path_factory):
    src, house = tmp_path_factory.mktemp("in"), Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    (src / "x.csv").write_text("t\nw\nFoo,Bar\n1,2\n", encoding="utf-8")
    assert load_folder(house, "one", str(src)).count() == 0 and house.rows().count() == 0


def test_a_cell_beyond_the_default_limit_is_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TERMS.replace("blue widget", "blue " + "w" * 140_000), encoding="utf-8")
    _, rows = frames(spark, tmp_path)
    assert max(len(r["record"]["search_term"]) for r in rows.collect()) > 140_000


@pytest.mark.parametrize("limit", [1, 200])
def test_the_last_name_wins_whatever_the_batches(spark, tmp_path_factory, limit):
    src, house = tmp_path_factory.mktemp("in"), Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    (src / "b.csv").write_text(CAMPAIGNS, encoding="utf-8")
    (src / "a.csv").write_text(CAMPAIGNS.replace("February 2025", "March 2025"), encoding="utf-8")
    os.utime(src / "b.csv", (1_700_000_000, 1_700_000_000))
    query = watch_folder(house, "one", str(src), str(tmp_path_factory.mktemp("check")), limit)
    query.awaitTermination(120)
    assert query.exception() is None
    assert house.uploads().first()["source_file"] == "b.csv"
    assert {r["date"] for r in house.rows().collect()} == {"January 2025", "February 2025"}


@pytest.mark.parametrize("limit", [1, 4])
def test_arrivals_of_many_clients_equal_one_load(spark, tmp_path_factory, limit):
    root, check = tmp_path_factory.mktemp("in"), str(tmp_path_factory.mktemp("check"))
    house, other = (Warehouse(spark, str(tmp_path_factory.mktemp(n))) for n in ("house", "other"))
    march = CAMPAIGNS.replace("February 2025", "March 2025")

    def put(client, name, text, age):
        (root / client).mkdir(exist_ok=True)
        (root / client / name).write_text(text, encoding="utf-8")
        os.utime(root / client / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def run():
        query = watch_clients(house, str(root), check, limit)
        query.awaitTermination(180)
        assert query.exception() is None

    put("two", "c.csv", march, 1), put("one", "b.csv", CAMPAIGNS, 2), put("two", "a.csv", CAMPAIGNS, 3)
    put("one", "t.csv", TERMS, 4), put("one", "a.csv", march, 5), put("one", "short.csv", "x\n", 6), (root / "stray.csv").write_text(CAMPAIGNS)
    run()
    put("three", "k.csv", KEYWORDS.format(qs=3, lp="Average"), 7), put("two", "b.csv", CAMPAIGNS, 8), put("one", "z.csv", march, 9)
    run()
    stamp = house.uploads().agg(F.max("uploaded_at")).first()[0]
    run()
    assert house.uploads().agg(F.max("uploaded_at")).first()[0] == stamp
    for client in ("one", "two", "three"):
        load_folder(other, client, str(root / client))
    for table in ("rows", "uploads"):
        kept = [c for c in getattr(house, table)().columns if c not in ("upload_id", "uploaded_at")]
        got, want = (sorted(repr(tuple(r)) for r in getattr(w, table)().select(*kept).collect()) for w in (house, other))
        assert got == want and got
    names = {(r["client_id"], r["report_type"]): r["source_file"] for r in house.uploads().collect()}
    assert names == {("one", "campaign_performance"): "z.csv", ("one", "search_terms"): "t.csv",
                     ("two", "campaign_performance"): "c.csv", ("three", "search_keyword_qs"): "k.csv"}


def test_accept_keeps_the_last_name():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()

    def names(*arrived):
        frames = iter([pd.DataFrame({"source_file": list(arrived), "file": [f"/in/{a}" for a in arrived]})])
        return [f for out in accept(("one", "ads"), frames, state) for f in out["file"]]

    assert names("b", "a") == ["/in/a", "/in/b"]
    assert names("a") == [] and state.get == ("b",)
    assert names("a", "b", "c") == ["/in/b", "/in/c"] and state.get == ("c",)


ODD = ("t\nw\nSearch term,Clicks\n\"a \"\"b\"\", c\",1\n\"two\n\"\"lines\"\"\n\",2\n5\" pipe,\"3\"\n\"x\"y\"z,4\n\n,\nTotal,9\n"
       "\"\",\"\"\n\u00e9\u00df\"\u4e2d,5\r\n\"cr\r\nlf\",6\rlone,7\n\",\n,\",8\nlast \"open,9\nq,\"no end\n,")


def serial_states(data):
    """States behind every byte and record ends, by the rules of the csv module a byte at a time."""
    cell, plain, quoted, after = range(4)
    for start in range(4):
        state, cut = start, None
        for at, byte in enumerate(data):
            c = chr(byte)
            if state == quoted:
                state = after if c == '"' else quoted
            elif state == cell and c == '"' or state == after and c == '"':
                state = quoted
            elif c in ",\r\n":
                cut = at + 1 if cut is None and c != "," else cut
                state = cell
            else:
                state = plain
        yield state, cut


def test_block_states_follow_the_csv_rules():
    data = ODD.encode()
    for start in range(len(data)):
        for end in (start + 1, start + 2, start + 7, start + 30, len(data)):
            block = data[start:end]
            assert report_files.scan_block(block) == list(serial_states(block)), block


@pytest.mark.parametrize("preamble", [True, False])
def test_split_file_equals_the_serial_reader_at_every_cut(spark, tmp_path, preamble):
    path, bare = tmp_path / "odd.csv", tmp_path / "odd2.csv"
    path.write_bytes(b"\xef\xbb\xbf" + ODD.encode())
    bare.write_bytes(ODD.replace("\n", "\r\n").encode())
    short = tmp_path / "short.csv"
    short.write_bytes(b"one line that is longer than a block of the test, and no other")
    paths = [str(path), str(short), str(bare)]

    def read(split):
        rows = report_files.read_cells(spark, paths, preamble=preamble, split_bytes=split)
        return rows.rdd.getNumPartitions(), sorted(map(tuple, rows.collect()))

    tasks, serial = read(1 << 20)
    assert tasks == 3 and len(serial) > 15
    for split in (1, 3, 10, 25, 40, 64):
        tasks, rows = read(split)
        assert rows == serial and (split > 40 or tasks > 6), split


def test_long_quoted_cells_split_without_record_starts(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("t\nw\nSearch term,Clicks\n" + "".join(f'"{"a,\n" * n}",{n}\n' for n in (5, 9000, 0, 4000)), encoding="utf-8")
    whole = report_files.read_cells(spark, [str(path)]).collect()
    parts = report_files.read_cells(spark, [str(path)], split_bytes=1000)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole)) and len(whole) == 4
    assert 1 < parts.rdd.getNumPartitions() < 5


def test_a_load_lost_before_its_commit_leaves_the_old_snapshot(spark, folder, tmp_path_factory, monkeypatch):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    load_folder(house, "one", str(folder))
    load_folder(house, "two", str(folder))

    def content(client):
        rows = house.rows().filter(F.col("client_id") == client).withColumn("record", F.to_json("record"))
        ledger = house.uploads().filter(F.col("client_id") == client)
        return sorted(map(repr, rows.collect())), sorted(map(repr, ledger.collect()))

    before, other = content("one"), content("two")
    (folder / "m.csv").write_text(CAMPAIGNS.replace("February", "March").replace("50.5", "7"), encoding="utf-8")
    (folder / "a_terms.csv").write_text("t\nJan 1, 2025 - Jan 31, 2025\nSearch term,Clicks\nTotal,5\n", encoding="utf-8")
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            load_folder(house, "one", str(folder))
    assert content("one") == before and content("two") == other

    load_folder(house, "one", str(folder))
    rows, ledger = content("one")
    assert any("March 2025" in r for r in rows) and not any("February" in r or "search_terms" in r for r in rows)
    assert len(ledger) == 3 and content("two") == other
    assert house.vacuum("one") == 5 and house.vacuum("one") == 0 and house.vacuum("nobody") == 0
    assert content("one") == (rows, ledger) and content("two") == other


@pytest.fixture
def store(spark, folder, tmp_path_factory):
    """A store that only Spark opens, with the reports in ``in/one``."""
    top = tmp_path_factory.mktemp("store")
    (top / "in").mkdir()
    (top / "in" / "one").symlink_to(folder)
    (folder / "[a]{b}.csv").write_text(CAMPAIGNS, encoding="utf-8")
    name = f"t{os.path.basename(top).lower().replace('_', '')}{os.getpid()}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./s", f"file://{top}")
    return f"viewfs://{name}/s"


def test_reports_in_a_store_that_only_spark_opens(spark, store, folder, tmp_path_factory):
    assert not report_files.opens(store) and report_files.opens(str(folder)) and report_files.opens(f"file://{folder}")
    names = sorted(os.listdir(folder))
    assert [p.rsplit("/", 1)[1] for p in report_files.list_reports(f"{store}/in/one")] == names
    assert report_files.list_reports(f"{store}/in") == [] and len(report_files.list_reports(f"{store}/in", True)) == len(names)
    here, there = Warehouse(spark, str(tmp_path_factory.mktemp("house"))), Warehouse(spark, f"{store}/house")
    load_folder(here, "one", str(folder)), load_folder(there, "one", f"{store}/in/one")
    for table, gone in (("rows", []), ("uploads", ["upload_id", "uploaded_at"])):
        want, got = (sorted(map(str, getattr(w, table)().drop(*gone).collect())) for w in (here, there))
        assert got == want and got
    mixed = report_files.read_cells(spark, [f"{folder}/m.csv", f"{store}/in/one/a_terms.csv"])
    assert mixed.count() == 7


def test_arrivals_in_a_store_that_only_spark_opens(spark, store):
    for watch, root in ((watch_clients, "in"), (watch_folder, "in/one")):
        house, args = Warehouse(spark, f"{store}/house-{watch.__name__}"), [] if watch is watch_clients else ["one"]
        for _ in range(2):
            query = watch(house, *args, f"{store}/{root}", f"{store}/check-{watch.__name__}")
            query.awaitTermination(180)
            assert query.exception() is None
        assert {(r["client_id"], r["report_type"]): r["row_count"] for r in house.uploads().collect()} == {
            ("one", "search_terms"): 5, ("one", "search_keyword_qs"): 2, ("one", "campaign_performance"): 2}


def test_a_named_folder_counts_as_shared(spark):
    class Session:
        sparkContext = type("Context", (), {"master": "spark://host"})

        def __init__(self, **named):
            self.conf = {k.replace("_", "."): v for k, v in named.items()}

    assert source_queries.scratch(Session(spark_checkpoint_dir="file:///mnt/shared")).startswith("file:///mnt/shared/adinsight-")
    assert source_queries.scratch(Session(spark_sql_warehouse_dir="file:/mnt/house")).startswith("file:/mnt/house/adinsight-")
    with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
        source_queries.scratch(Session(spark_sql_warehouse_dir="file:/home/me/spark-warehouse"))


def test_places_of_equally_named_files_are_told_apart(spark):
    rows = spark.range(400).selectExpr("concat('term ', id) search_term", "cast(id as int) row_index", "'Added' added_excluded", "id clicks", "id impressions",
                                       "id / 4e0 cost", "id conversions")
    facts = type("Facts", (dict,), {"spark": spark})(fx_search_terms=rows)
    found = source_queries.scanned(facts, 24)
    assert found.select("source_file", "row_index").distinct().count() == found.count() == 400

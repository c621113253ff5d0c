import time

import pytest
from pyspark.sql import functions as F

from forum_signals.functions.casts import safe_int
from forum_signals.session import LEAN_WRITES
from forum_signals.sources import dump, norms, tables
from forum_signals.sources.schemas import COMMENTS, POSTS, enforce
from verification.dump_writer import write_dump

POSTS_XML = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" Body="&lt;p&gt;a &gt; b&#xA;c 'q' /&gt; <-x" Title='say "hi" ' Tags="&lt;a&gt;&lt;b&gt;" Score="x" />
  <row Id="2"
     PostTypeId="2" ParentId="1" Body="two
lines" Score="1_000" CreationDate="2020-01-01T00:00:00.000"/><row Id="3" PostTypeId="" Body="null" />
  <other Id="9" />
  <row Id="4" Body="" Extra="1"></row>
</posts>
""".replace("<-x", "x")


@pytest.fixture
def dump_dir(tmp_path):
    (tmp_path / "site" / "deep").mkdir(parents=True)
    (tmp_path / "site" / "Posts.xml").write_text(POSTS_XML, newline="")
    (tmp_path / "site" / "deep" / "Comments.xml").write_text(
        '<comments><row Id="7" PostId="2" Text="i see now" Score="" /><row Id="8" PostId="" /></comments>'
    )
    (tmp_path / "site" / "Users.xml").write_text('<users><row Id="1" /></users>')
    return str(tmp_path)


@pytest.mark.parametrize("reader", [dump.read_dump_rows, dump.read_dump_rows_whole])
def test_rows_of_a_dump_file(spark, dump_dir, reader):
    path = dump.find_dump_file(spark, dump_dir, "Posts.xml")
    rows = {r.Id: r for r in reader(spark, path, POSTS).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1].Body == "<p>a > b\nc 'q' /> x" and rows[1].Title == 'say "hi" ' and rows[1].Tags == "<a><b>"
    assert rows[1].Score == 0 and rows[1].ParentId is None and rows[1].AnswerCount == 0
    assert (rows[2].PostTypeId, rows[2].ParentId, rows[2].Score) == (2, 1, 1000)
    assert rows[2].Body == "two lines" and rows[2].CreationDate == "2020-01-01T00:00:00.000"
    assert rows[3].PostTypeId == 0 and rows[3].Body == "null" and rows[3].Title is None
    assert rows[4].Body == ""
    assert reader(spark, path, POSTS).dtypes == [(f.name, f.dataType.simpleString()) for f in POSTS.schema]


ROOTED = "<?xml version='1.0'?>\n<!-- made by hand -->\n<comments>\n%s\n</comments>\n"


def write(folder, text):
    path = folder / "Comments.xml"
    path.write_text(text, newline="")
    return str(path)


def test_integers_of_any_script(spark):
    """As Python reads them, within the type."""
    texts = [
        "12", " 7 ", "+3", "-4", "1_000", "1__0", "_1", "1.5", "", "x", "\u0663\u0664", "\uff11\uff12", "\U0001d7d9\U0001d7da", "\u00a05\u3000", "\u2003-\u0967",
        "\u06611\u0966", "\u00b2", "\u2460", "1\u00a02", "\u0661_\u0662", "\u4e00", "\u00a0", None,
    ]

    def plain(text):
        try:
            return int(text)
        except (TypeError, ValueError):
            return None

    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.a, r.b) for r in frame.select("i", safe_int(F.col("t"), "bigint").alias("a"), safe_int(F.col("t"), "int", 0).alias("b")).collect()}
    assert got == {i: (plain(t), plain(t) or 0) for i, t in enumerate(texts)}


def test_a_dump_whose_comments_hold_rows(spark, tmp_path):
    """The split read refuses it, the whole read takes the rows beside the comment; the job passes the choice on."""
    from forum_signals.plans import jobs

    write(tmp_path, ROOTED % '<row Id="1"/><!-- <row Id="2"/> -->\n<row Id="3" Text="a"/>')
    with pytest.raises(Exception, match="a comment or literal section spans a row"):
        dump.read_dump(spark, str(tmp_path))["comments"].collect()
    assert sorted(r.Id for r in dump.read_dump(spark, str(tmp_path), whole=True)["comments"].collect()) == [1, 3]
    saved = jobs.ingest(jobs.Workspace(spark, str(tmp_path / "work")), str(tmp_path), whole=True)
    assert list(saved) == ["comments"] and sorted(r.Id for r in saved["comments"].collect()) == [1, 3]


def test_every_layout_of_a_row_is_read(spark, tmp_path):
    rows = [
        '<row Id="1" />', '<row\tId="2"/>', '<row\n  Id="3"\n/>', '<row\r\n\tId="4"></row>', '<row    Id="5" >\n</row >', "<row/>", "<row />",
        '<row Text="&lt;row Id=&quot;9&quot; />" Id="6"/>', "<rowset Id='9'/>", "<rows/>", "<!-- a note -->", '<row Id="7"/><row Id="8"/>',
        "<row Text='> /> \"' Id='10'/>",
    ]
    path = write(tmp_path, ROOTED % "\n".join(rows))
    expected = [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    for reader in (dump.read_dump_rows, dump.read_dump_rows_whole):
        got = reader(spark, path, COMMENTS).select("Id", "Text").collect()
        assert sorted((r.Id for r in got), key=lambda v: (v is not None, v)) == expected
        assert {r.Id: r.Text for r in got}[6] == '<row Id="9" />'
    assert dump.read_dump_rows(spark, path, COMMENTS).count() == len(expected)


@pytest.mark.parametrize("size", ["1k", "7k"])
def test_no_row_is_lost_at_the_edges_of_splits(spark, tmp_path, size):
    layouts = ('<row Id="{}" Text="{}" />\n', '<row\tId="{}" Text="{}"/>', '<row\n Id="{}"\n Text="{}"></row>')
    body = "".join(layouts[i % 3].format(i, "x" * (i % 97)) for i in range(3000))
    path = write(tmp_path, ROOTED % body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ids = dump.read_dump_rows(spark, path, COMMENTS).select("Id").collect()
        assert sorted(r.Id for r in ids) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "text",
    [
        ROOTED % '<row Id="1"/>\n<!-- <row Id="9" /> -->',
        ROOTED % '<row Id="1"/>\n<![CDATA[ <row Id="9" /> ]]>',
        '<comments>\n<row Id="1"/>\n<row Id="2" Text="cut',
        '<comments>\n<row Id="1"/>\n<row Id="2" Text="cut"',
        '<comments>\n<row Id="1"/>\n<row',
        '<comments>\n<row Id="1"/>\n',
        '  <row Id="1"/>\n<row Id="2',
    ],
)
def test_broken_or_hidden_rows_fail_the_read(spark, tmp_path, text):
    with pytest.raises(Exception, match="cut off|does not end|spans a row"):
        dump.read_dump_rows(spark, write(tmp_path, text), COMMENTS).count()


def test_rows_in_comments_are_no_rows(spark, tmp_path):
    path = write(tmp_path, ROOTED % '<row Id="1"/>\n<!-- <row Id="9" /> -->')
    assert [r.Id for r in dump.read_dump_rows_whole(spark, path, COMMENTS).collect()] == [1]


def test_only_wanted_files_and_missing_one_is_skipped(spark, dump_dir, caplog):
    found = dump.read_dump(spark, dump_dir)
    assert sorted(found) == ["comments", "posts"]
    assert "Tags.xml" in caplog.text
    rows = {r.Id: r for r in found["comments"].collect()}
    assert rows[7].Text == "i see now" and rows[7].Score == 0
    assert rows[8].PostId is None and rows[8].Text is None


def test_one_large_file_is_read_in_parallel(spark, tmp_path):
    body = "".join(f'  <row Id="{i}" PostId="{i % 7}" Text="{"x" * 200} {i}" />\n' for i in range(20_000))
    (tmp_path / "Comments.xml").write_text(f"<comments>\n{body}</comments>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows = dump.read_dump_rows(spark, str(tmp_path / "Comments.xml"), COMMENTS)
        assert rows.rdd.getNumPartitions() > 8
        assert rows.agg(F.count("*"), F.count_distinct("Id"), F.sum("Id")).collect()[0] == (20_000, 20_000, 199990000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_xml_fails(spark, tmp_path):
    (tmp_path / "Comments.xml").write_text('<comments><row Id="1" Text="a & b" /></comments>')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        dump.read_dump_rows(spark, str(tmp_path / "Comments.xml"), COMMENTS).collect()


def test_norms(spark, tmp_path):
    (tmp_path / "norms.csv").write_text(
        "Word,Bigram,Conc.M\nApple,0,4.5\nbanana,0,\nnull,0,2.0\napple,0,5\nN/A,0,3\n,0,1\nice cream,1,4.1\nNone,0,1\nzoo,0,NA\nnone,0,2\n"
    )
    got = {r.token: r.score for r in norms.read_norms_csv(spark, str(tmp_path / "norms.csv")).collect()}
    assert got == {"apple": 5.0, "ice cream": 4.1, "none": 2.0}


def test_tables_and_reports(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.range(5).select(F.col("id").cast("string").alias("Id"))
    assert tables.write_table(df, path).count() == 5
    assert [r.Id for r in tables.write_table(df.where("Id = '3'"), path).collect()] == ["3"]  # replaced
    assert enforce(df, COMMENTS.schema[:1]).dtypes == [("Id", "bigint")]
    report = str(tmp_path / "r.csv")
    tables.write_report(spark.range(5).orderBy(F.desc("id")), report, {"id": "an.id"})
    files = list((tmp_path / "r.csv").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["an.id", "4", "3", "2", "1", "0"]
    counts = {r.table_name: r.n_rows for r in tables.row_counts({"a": df, "b": df.limit(2)}).collect()}
    assert counts == {"a": 5, "b": 2}


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(1000).select(F.col("id").alias("question_id"), F.lit("t").alias("tag"))
        left = tables.save_bucketed(pairs, "bucketed_pairs", "question_id", 4)
        right = tables.save_bucketed(pairs.select("question_id", F.lit(True).alias("flag")), "bucketed_flags", "question_id", 4)
        joined = left.join(right, "question_id")
        assert joined.count() == 1000
        assert "Exchange hashpartitioning(question_id" not in joined._jdf.queryExecution().toString()
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_pairs")
        spark.sql("DROP TABLE IF EXISTS bucketed_flags")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("codec", ["gzip", "lz4"])
def test_compressed_part_files(spark, tmp_path, codec):
    """They are read like plain ones, and a root element that is not closed fails the read."""
    rows = "".join(f'<row Id="{i}" Text="t{i}" />\n' for i in range(300))
    for name, text in (("whole", ROOTED % rows), ("cut", f"<comments>\n{rows}")):
        lines = spark.createDataFrame([(text,)], "value string").coalesce(1)
        lines.write.option("compression", codec).text(str(tmp_path / name / "Comments.xml"))
    found = dump.read_dump_rows(spark, str(tmp_path / "whole" / "Comments.xml"), COMMENTS)
    assert sorted((r.Id, r.Text) for r in found.collect()) == [(i, f"t{i}") for i in range(300)]
    with pytest.raises(ValueError, match="cut off"):
        dump.read_dump_rows(spark, str(tmp_path / "cut" / "Comments.xml"), COMMENTS)


def test_the_written_dump_is_compressed(spark, tmp_path):
    """A dump of short answers takes much less room than its text, in every layout and with missing values."""
    texts = spark.range(5000).selectExpr(
        "if(id % 50 = 0, null, id) as Id", "id * 10 as PostId", "if(id % 3 = 0, null, concat('a <b> & \"c\"\\n\\t', id)) as Text",
        "string(null) as CreationDate", "int(id % 7) as Score",
    )
    path = tmp_path / "Comments.xml"
    write_dump(texts, str(path))
    assert sum(f.stat().st_size for f in path.glob("part-*")) < 5000 * 40
    rows = {tuple(r) for r in dump.read_dump_rows(spark, str(path), COMMENTS).collect()}
    assert rows == {tuple(r) for r in texts.collect()}


def size(path):
    return sum(f.stat().st_size for f in path.glob("part-*"))


def test_the_written_dump_is_smaller_than_with_lz4(spark, tmp_path):
    posts = spark.range(20_000).selectExpr(
        "id * 7919 as Id", "id % 2000 as PostId", "concat('<p>anodized brass ', id % 150, ' &amp; which one</p>') as Text",
    )
    write_dump(posts.coalesce(1), str(tmp_path / "Comments.xml"))
    spark.read.text(str(tmp_path / "Comments.xml")).write.option("compression", "lz4").text(str(tmp_path / "lz4"))
    assert 0 < size(tmp_path / "Comments.xml") < 0.8 * size(tmp_path / "lz4")
    assert dump.read_dump_rows(spark, str(tmp_path / "Comments.xml"), COMMENTS).count() == 20_000


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(",").split(",") if name.startswith("shuffle_")}


def test_writes_keep_no_shuffle_files(spark, tmp_path):
    """They go at once, not with the driver's next garbage, and the session's settings are as before."""
    rows = spark.range(1000).selectExpr("id as Id", "cast(id % 3 as string) as Text").repartition(4, "Id")
    settings = {key: spark.conf.get(key, None) for key in LEAN_WRITES}
    before = shuffled(spark)
    write_dump(rows, str(tmp_path / "Comments.xml"))
    kept = tables.write_table(rows, str(tmp_path / "kept"))
    end = time.time() + 10
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert kept.count() == dump.read_dump_rows(spark, str(tmp_path / "Comments.xml"), COMMENTS).count() == 1000
    assert settings == {key: spark.conf.get(key, None) for key in LEAN_WRITES}


@pytest.mark.parametrize("kinds", [3, 20])
def test_posts_are_written_by_type_unsorted(spark, tmp_path, kinds):
    """So that no task spills its texts; with more types than files held open the rows are the same."""
    posts = spark.range(500).selectExpr("id as Id", f"cast(id % {kinds} as byte) as PostTypeId", "'x' as Body")
    kept = tables.write_table(posts, str(tmp_path / "posts"), partition_by="PostTypeId")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [p for p in (runs.apply(i).physicalPlanDescription() for i in range(runs.size())) if f"{tmp_path}/posts" in p and "Insert" in p]
    assert plans and "Sort" not in plans[-1]
    assert sorted((r.Id, r.PostTypeId) for r in kept.collect()) == [(i, i % kinds) for i in range(500)]

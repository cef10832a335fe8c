import csv
import gzip
import random
import zipfile
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from rankspark.operators import documents, nearest
from rankspark.sources.delimited import read_csv_corpus, read_numbered_csv_corpus
from rankspark.sources.points import points_from_columns
from rankspark.sources.tagged import page_fields, read_abstracts, read_xml_abstracts

CSV = 'id,title,text,extra\n1,a,"hello ""q"" world\nline2",x\n2,b\n3,c,,y\n4,d,plain text,z\n5,e,"",w\n'
TEXTS = sorted(['hello "q" world\nline2', "", "plain text", ""])


def write(tmp_path, kind):
    path = str(tmp_path / f"corpus.csv{kind}")
    if kind == ".gz":
        with gzip.open(path, "wt", newline="") as f:
            f.write(CSV)
    elif kind == ".zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("first.csv", CSV)
            z.writestr("second.csv", "h\n1,2,not read\n")
    else:
        with open(path, "w", newline="") as f:
            f.write(CSV)
    return path


@pytest.mark.parametrize("kind", ["", ".gz", ".zip"])
def test_csv(spark, tmp_path, kind):
    rows = read_csv_corpus(spark, write(tmp_path, kind))
    assert sorted(r["text"] for r in rows.collect()) == TEXTS
    spread = read_csv_corpus(spark, write(tmp_path, kind), partitions=3)
    assert spread.rdd.getNumPartitions() == 3
    assert sorted(r["text"] for r in spread.collect()) == TEXTS


@pytest.mark.parametrize("kind", ["", ".gz", ".zip"])
def test_numbered_csv(spark, tmp_path, kind):
    path = write(tmp_path, kind)
    want = ['hello "q" world\nline2', "", "plain text", ""]
    rows = read_numbered_csv_corpus(spark, path)
    assert [r["text"] for r in sorted(rows.collect())] == want
    assert [r["doc_id"] for r in sorted(rows.collect())] == [0, 1, 2, 3]
    assert [r["text"] for r in sorted(read_numbered_csv_corpus(spark, path, limit=3).collect())] == want[:3]


def test_numbered_csv_follows_the_file_across_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b,c\n" + "".join(f"x,y,row {i} {'z' * (i % 90)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_numbered_csv_corpus(spark, str(path), multi_line=False)
        got = {r["doc_id"]: int(r["text"].split()[1]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: i for i in range(3000)}


def test_csv_of_other_widths(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('a,b,c\n1,"x,y"\n1,2,\n1,2,t\n1,"x,y",,5,6\n1\n')
    assert sorted(r["text"] for r in read_csv_corpus(spark, str(path)).collect()) == ["", "", "t"]


@contextmanager
def small_splits(spark, size=20_000):
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size // 7}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def cell(rng, i):
    return rng.choice(
        [f"plain {i}", f'with "quotes", commas {i}\nand lines\n\n, x', "\n" * rng.randint(1, 5), "", f'a\r\nb "" {i}', "long line, " * 40 + "\n" * 9]
    )


def write_records(folder, files, rows, rng):
    """Some with short and blank records, one with other line ends; the texts in order."""
    texts = []
    for n in range(files):
        with open(folder / f"part{n}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\r\n" if n == 1 else "\n")
            writer.writerow(["head\nof it", "b", "c", "d"])
            for i in range(rows):
                kind = rng.random()
                if kind < 0.05:
                    writer.writerow(["1", cell(rng, i)])
                elif kind < 0.07:
                    out.write("\n")
                else:
                    texts.append(cell(rng, i))
                    writer.writerow([i, cell(rng, i), texts[-1], *["x"] * rng.randint(0, 3)])
    return texts


def test_csv_with_quoted_newlines_is_read_by_many_tasks(spark, tmp_path):
    texts = write_records(tmp_path, 3, 400, random.Random(5))
    with small_splits(spark):
        rows = read_csv_corpus(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        assert sorted(r["text"] for r in rows.collect()) == sorted(texts)
        one_file = read_csv_corpus(spark, str(tmp_path / "part0.csv"))
        assert one_file.rdd.getNumPartitions() > 3
        numbered = read_numbered_csv_corpus(spark, str(tmp_path))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        got = sorted(numbered.collect())
    assert "Python" not in plan and "MapInArrow" not in plan and "rangepartitioning" not in plan
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [r["text"] for r in got] == texts


@pytest.mark.parametrize("limit", [0, 1, 100, 401, 5000])
def test_first_records_only(spark, tmp_path, limit):
    texts = write_records(tmp_path, 4, 150, random.Random(6))
    with small_splits(spark, 4_000):
        rows = read_numbered_csv_corpus(spark, str(tmp_path), limit=limit)
        got = sorted(rows.collect())
    assert [r["text"] for r in got] == texts[:limit]
    assert [r["doc_id"] for r in got] == list(range(min(limit, len(texts))))
    if 0 < limit <= 100:  # of four files the first ones hold them
        assert "part3.csv" not in "".join(rows.inputFiles())


def test_single_line_records_are_never_exchanged(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n" + "".join(f'{i},"x, y","text, {i}"\n' for i in range(2000)))
    with small_splits(spark):
        for multi_line in (True, False):
            rows = read_numbered_csv_corpus(spark, str(tmp_path), multi_line=multi_line)
            got = {r["doc_id"]: r["text"] for r in rows.collect()}
            assert got == {i: f"text, {i}" for i in range(2000)}
            exchanges = [line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in line]
            assert all("_file" not in line.split("hashpartitioning")[1] for line in exchanges if "value" in line)


def test_csv_with_backslashes_over_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,b,c\n1,2,"say \\"hi\\",\ntwice \\\\"\n1,2,"next"\n')
    got = sorted(read_numbered_csv_corpus(spark, str(tmp_path), escape="\\").collect())
    assert [r["text"] for r in got] == ['say "hi",\ntwice \\', "next"]


def test_count_before(spark):
    from rankspark.operators.scale import count_before

    df = spark.range(0, 1000, 1, 7).withColumn("flag", F.col("id") % 3 == 0)
    rows = count_before(df.withColumn("task", F.spark_partition_id()), F.col("flag"), "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        assert r["n"] == seen.get(r["task"], 0)
        seen[r["task"]] = r["n"] + r["flag"]
    assert len(rows) == 1000


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert read_csv_corpus(spark, str(tmp_path)).count() == 0
    assert read_numbered_csv_corpus(spark, str(tmp_path)).count() == 0
    assert read_numbered_csv_corpus(spark, str(tmp_path), limit=3).count() == 0


ABSTRACTS = """<feed>
<doc>
<title>Wikipedia: Alpha &amp; co</title>
<url>http://a</url>
<abstract>An abstract that is long &amp; fine.</abstract>
<links></links>
</doc>
<doc>
<title>Wikipedia: Short</title>
<url>http://b</url>
<abstract>too short</abstract>
</doc>
<doc>
<title>Wikipedia: Beta</title>
<url>http://c</url>
<abstract>Another abstract, long enough.</abstract>
</doc>
</feed>
"""


def test_abstracts(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(ABSTRACTS)
    got = sorted((r["title"], r["desc"]) for r in read_abstracts(spark, str(path)).collect())
    assert got == [
        ("Alpha &amp; co", "An abstract that is long &amp; fine."),
        ("Beta", "Another abstract, long enough."),
    ]
    decoded = sorted((r["title"], r["desc"]) for r in read_xml_abstracts(spark, str(path)).collect())
    assert decoded == [("Alpha & co", "An abstract that is long & fine."), ("Beta", "Another abstract, long enough.")]


def test_titles_are_carried_over_records_and_splits(spark, tmp_path):
    lines, want, title = [], [], ""
    rng = random.Random(7)
    for i in range(3000):
        kind = rng.random()
        if kind < 0.1 and not 1000 < i < 2000:  # a third of the lines under one title
            title = f"title {i}"
            lines.append(f"<title>Wikipedia: {title}</title>")
        elif kind < 0.2:
            lines.append(rng.choice(["</doc>", "<doc>", "", " <title>not at the start</title>", "x <abstract>nor this</abstract>"]))
        else:
            lines.append(f"<abstract>an abstract, number {i}</abstract>")
            want.append((title, f"an abstract, number {i}"))
    (tmp_path / "dump.xml").write_text("\n".join(lines))
    with small_splits(spark, 5_000):
        rows = read_abstracts(spark, str(tmp_path))
        got = sorted((r["title"], r["desc"]) for r in rows.collect())
    assert got == sorted(want)
    # Two files: each by itself, or as one.
    (tmp_path / "e.xml").write_text("<abstract>after the last title of all</abstract>\r\n")
    assert ("", "after the last title of all") in {tuple(r) for r in read_abstracts(spark, str(tmp_path)).collect()}
    assert (title, "after the last title of all") in {tuple(r) for r in read_abstracts(spark, str(tmp_path), one_dump=True).collect()}


def test_page_fields(spark):
    html = "<html><head><title>T &amp; u</title><style>p{}</style></head><body><script>x<1</script><p>Some\n <b>text</b></p></body></html>"
    row = page_fields(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row["title"], row["desc"]) == ("T &amp; u", "Some text")


def test_ids_and_offsets(spark):
    df = spark.createDataFrame([(30, "b"), (10, "a"), (20, "b")], "doc_id long, source string")
    ids = {r["doc_id"]: r["ordinal"] for r in documents.assign_ids(df, [F.col("doc_id")]).collect()}
    assert ids == {10: 0, 20: 1, 30: 2}
    base = {r["source"]: (r["n_docs"], r["base"]) for r in documents.segment_offsets(df, "source").collect()}
    assert base == {"a": (1, 0), "b": (2, 1)}


def test_fields_and_length_filter(spark):
    df = spark.createDataFrame([(1, "t", "x" * 16), (2, "u", "x" * 15)], "id int, a string, b string")
    rows = documents.as_fields(df, "id", {"title": "a", "body": "b"})
    assert rows.count() == 4 and set(rows.columns) == {"doc_id", "field", "text"}
    assert [r["doc_id"] for r in documents.min_length(rows).collect()] == [1]


def test_nearest(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 1.0)], "id int, a double, b double")
    points = points_from_columns(df, "id", "a", "b")
    assert [(r["doc_id"], r["dist"]) for r in nearest.nearest(points, 0, 0).collect()] == [(1, 0.0), (3, 1.0), (2, 5.0)]
    assert [r["doc_id"] for r in nearest.nearest(points, 3, 4, k=1).collect()] == [2]

import gzip
import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lociframe.bindings import genomic
from lociframe.session import discard, shared_dir, written
from lociframe.sources import guarded
from lociframe.sources import (
    document_paths,
    jdbc_options,
    load_split,
    merge_profiles,
    normalized_uri,
    parse_documents,
    profile,
    profile_parts,
    read_checked,
    read_commented_tsv,
    read_csv,
    read_file_metadata,
    read_jsonl,
    read_profile,
    read_table,
    read_tsv,
    scan_files,
    scan_manifest,
    scan_manifest_source,
    write_csv,
    write_file_per_key,
    write_parquet,
    write_tsv,
)

COMMENTED = '''# order = o1\tignored field
#kind=a=b
#state=draft
gene\tclass
G1\tvus

G2\tpathogenic
#state=final
#lonely
G3\t"tab\there"
G4\t
G5\t"say ""x"""
'''


def test_commented_files(spark, tmp_path, rows):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write(COMMENTED)
    (tmp_path / "b.tsv").write_text("#order=o2\n##state = x y\ngene\tclass\nG9\t007\n")
    df = read_commented_tsv(spark, str(tmp_path), "gene STRING, class STRING")
    assert rows(df) == [
        ("G1", "vus"),
        ("G2", "pathogenic"),
        ("G3", "tab\there"),
        ("G4", ""),
        ("G5", 'say "x"'),
        ("G9", "007"),
    ]
    assert rows(read_commented_tsv(spark, str(tmp_path))) == rows(df)

    found = {r.file_path.rsplit("/", 1)[1]: r.metadata for r in read_file_metadata(spark, str(tmp_path)).collect()}
    assert found == {
        "a.tsv.gz": {"order": "o1", "kind": "a", "state": "final"},
        "b.tsv": {"order": "o2", "state": "xy"},
    }


def test_metadata_order_holds_across_splits_of_one_file(spark, tmp_path):
    lines = [f"#key={i}" if i % 100 == 0 else f"row {i}" for i in range(20_001)]
    (tmp_path / "big.tsv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = read_file_metadata(spark, str(tmp_path))
        assert [r.metadata for r in found.collect()] == [{"key": "20000"}]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_of_every_file_is_checked(spark, tmp_path):
    (tmp_path / "swapped.tsv").write_text("class\tgene\nvus\tG1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_commented_tsv(spark, str(tmp_path), "gene STRING, class STRING").collect()


def test_csv_tsv_parquet_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'q"x', None)], "id bigint, name string, score double")
    schema = "id bigint, name string, score double"
    write_csv(df, f"{tmp_path}/c")
    write_tsv(df, f"{tmp_path}/t")
    write_parquet(df, f"{tmp_path}/p", partition_by=["id"])
    assert rows(read_csv(spark, f"{tmp_path}/c", schema)) == rows(df)
    assert rows(read_tsv(spark, f"{tmp_path}/t", schema)) == rows(df)
    assert rows(spark.read.parquet(f"{tmp_path}/p"), "id", "name", "score") == rows(df)
    assert dict(read_csv(spark, f"{tmp_path}/c").dtypes) == {"id": "int", "name": "string", "score": "double"}
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(df, f"{tmp_path}/c")


def test_quotes_missing_values_and_line_breaks(spark, tmp_path, rows):
    (tmp_path / "q.csv").write_text('id,name,score\n1,"say ""x"", twice",NA\n2,NA,0.5\n')
    df = read_csv(spark, f"{tmp_path}/q.csv", "id int, name string, score double", missing="NA")
    assert rows(df) == [(1, 'say "x", twice', None), (2, None, 0.5)]
    write_csv(df, f"{tmp_path}/w")
    assert 'say ""x"", twice' in "".join(p.read_text() for p in (tmp_path / "w").glob("*.csv"))
    (tmp_path / "m.csv").write_text('id,name\n1,"two\nlines"\n')
    assert rows(read_csv(spark, f"{tmp_path}/m.csv", "id int, name string", multiline=True)) == [(1, "two\nlines")]


def test_files_keep_blanks_and_empty_texts(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "  lead"), (2, "trail  "), (3, ""), (4, None), (5, " ")], "id int, name string")
    for write, read in ((write_csv, read_csv), (write_tsv, read_tsv)):
        path = f"{tmp_path}/{write.__name__}"
        write(df, path)
        assert rows(read(spark, path, "id int, name string")) == rows(df)
    with pytest.raises(Exception, match="line break in column name"):
        write_csv(spark.createDataFrame([(1, "a\nb")], "id int, name string"), f"{tmp_path}/broken")


def test_columns_are_taken_by_name_without_a_schema(spark, tmp_path):
    for name, head in (("a", "gene,class"), ("b", "class,gene")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\nx,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).collect()


def test_a_file_without_comments_has_an_empty_map(spark, tmp_path):
    (tmp_path / "plain.tsv").write_text("a\tb\n1\t2\n")
    assert [r.metadata for r in read_file_metadata(spark, str(tmp_path)).collect()] == [{}]


def test_jsonl_has_the_union_of_keys(spark, tmp_path, rows):
    records = [{"input": "i", "output": "o"}, {"note": "n"}]
    (tmp_path / "n.jsonl").write_text("\n".join(map(json.dumps, records)))
    df = read_jsonl(spark, f"{tmp_path}/n.jsonl")
    assert rows(df, "input", "note", "output") == [("i", None, "o"), (None, "n", None)]


def test_manifest_scan(spark, tmp_path, rows):
    for sample in ("s 1", "s2", "unlisted"):
        (tmp_path / f"{sample}.tsv").write_text(f"gene\tcounts\nG1\t{len(sample)}\n")
    manifest = spark.createDataFrame(
        [("a", f"file://{tmp_path}/s2.tsv"), ("b", f"{tmp_path}/s2.tsv"), ("c", f"{tmp_path}/gone.tsv")], "id string, url string"
    )
    def scan(manifest, **options):
        return scan_manifest(spark, manifest, "url", str(tmp_path), "gene STRING, counts BIGINT", **options)

    with pytest.raises(FileNotFoundError, match="gone.tsv"):
        scan(manifest)
    df = scan(manifest.filter("id <> 'c'"))
    assert rows(df, "id", "gene", "counts") == [("a", "G1", 2), ("b", "G1", 2)]
    assert [path.rpartition("/")[2] for path in df.inputFiles()] == ["s2.tsv"]  # only what is named is read
    kept = scan(manifest, absent="keep")
    assert rows(kept, "id", "gene", "counts") == [("a", "G1", 2), ("b", "G1", 2), ("c", None, None)]
    assert rows(scan(manifest.filter("id = 'c'"), absent="keep"), "id", "gene") == [("c", None)]


def test_normalized_uri(spark):
    df = spark.createDataFrame([("file:///a/b",), ("/a/b",), ("s3a://x/y",), ("s3n://x/y",), ("hdfs://n/f",)], "u string")
    got = [r[0] for r in df.select(normalized_uri(df.u)).collect()]
    assert got == ["/a/b", "/a/b", "s3://x/y", "s3://x/y", "hdfs://n/f"]


def test_table_and_jdbc_options(spark):
    spark.range(3).createOrReplaceTempView("small_table")
    assert read_table(spark, "small_table").count() == 3
    options = jdbc_options("jdbc:x", "SELECT 1", "id", (0, 10), 4, user="u")
    assert options["dbtable"] == "(SELECT 1) AS source_rows"
    assert options["numPartitions"] == "4" and options["upperBound"] == "10" and options["user"] == "u"
    with pytest.raises(ValueError, match="together"):
        jdbc_options("jdbc:x", "SELECT 1", partition_column="id")


def test_split_reads_only_its_folder(spark, tmp_path, plan):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id bigint, split string")
    write_parquet(df, f"{tmp_path}/s", partition_by=["split"])
    test = load_split(spark.read.parquet(f"{tmp_path}/s"), "test")
    assert [r.id for r in test.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in plan(test)


def test_profile(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "a")], "n int, `odd name` string")
    assert rows(profile(df)) == [("n", "int", 3, 1, "1"), ("odd name", "string", 3, 1, "a")]
    assert rows(profile(df.limit(0))) == [("n", "int", 0, 0, None), ("odd name", "string", 0, 0, None)]


def test_shared_dir_is_fresh_and_follows_the_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second
    assert root is None or first.startswith(root)


SCORES = "id int, name string, score double"
BODY = 'id,name,score\n1,"x,y",0.5\n2,a,b,c\n3\nx,b,1\n4,"say ""q""",oops\n\n5,,\n6,"",2\n7,"open,1\n'


@pytest.fixture
def mixed_files(tmp_path):
    """Name to content of good and broken files, below tmp_path/in."""
    (tmp_path / "in").mkdir()
    whole = gzip.compress(b"id,name,score\n" + b"".join(b"%d,n,1.5\n" % i for i in range(5000)))
    files = {
        "bad lines.csv": BODY.encode(),
        "cut.csv.gz": whole[:-300],
        "good.csv.gz": whole,
        "zipped.csv": whole,  # told by its content, not its name
        "header.csv": b"idd,name,score\n1,a,2\n",
        "empty.csv": b"",
        "blank.csv": b"\n \n",
        "only header.csv": b"id,name,score\r\n",
        "bytes.csv": b"id,name,score\n1,\xff,2\n",
        "mark.csv": "\ufeffid,name,score\r\n1,\u00e9,2\r\n".encode(),
        "flipped.csv.gz": whole[:200] + bytes([whole[200] ^ 255]) + whole[201:],
    }
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    return tmp_path / "in"


def manifest_of(spark, folder):
    names = [p.name for p in sorted(folder.iterdir())] + ["gone.csv"]
    rows = [(name, f"{'file://' if i % 2 else ''}{folder}/{name}") for i, name in enumerate(names)]
    return spark.createDataFrame([*rows, ("null", None), ("good.csv.gz", f"{folder}/good.csv.gz")], "file string, url string")


def outcome(df):
    """Per file the good rows, the bad lines and the kind of error."""
    found = {}
    for r in df.collect():
        good, bad, error = found.setdefault(r.file, ([], [], []))
        if r.file_error is None:
            good.append((r.file_line, r.id, r.name, r.score))
        elif r.file_line is None:
            error.append(r.file_error.split(":")[0])
        else:
            bad.append((r.file_line, r.file_error))
    return {k: (sorted(a, key=repr), sorted(b), c) for k, (a, b, c) in found.items()}


@pytest.mark.parametrize("way", ["tasks", "spark", "source"])
def test_each_file_fails_alone(spark, tmp_path, mixed_files, way):
    manifest = manifest_of(spark, mixed_files)
    if way == "source":
        manifest.write.parquet(f"{tmp_path}/m")
        got = outcome(scan_manifest_source(spark, f"{tmp_path}/m", "url", SCORES, ",", rows_per_partition=2))
    else:
        got = outcome(scan_files(manifest, "url", SCORES, ",", root=str(mixed_files) if way == "spark" else None))
    bad = [(3, "4 fields, expected 3"), (4, "1 fields, expected 3"), (5, "id does not fit its type")]
    bad += [(6, "score does not fit its type"), (10, "unexpected end of data")]
    assert got["bad lines.csv"] == ([(2, 1, "x,y", 0.5), (8, 5, None, None), (9, 6, "", 2.0)], bad, [])
    assert len(got["good.csv.gz"][0]) == 10_000 and got["good.csv.gz"][1:] == ([], [])  # named twice
    assert len(got["zipped.csv"][0]) == 5000
    assert got["mark.csv"] == ([(2, 1, "\u00e9", 2.0)], [], [])
    assert "only header.csv" not in got
    empty = "FileNotFoundError" if way == "spark" else "ValueError"
    errors = {"cut.csv.gz": "EOFError", "header.csv": "ValueError", "empty.csv": empty, "blank.csv": "ValueError"}
    errors |= {"bytes.csv": "UnicodeDecodeError", "gone.csv": "FileNotFoundError", "null": "FileNotFoundError"}
    for name, kind in errors.items():
        assert got[name] == ([], [], [kind])
    assert got["flipped.csv.gz"][0] == [] and len(got["flipped.csv.gz"][2]) == 1


def test_long_files_are_read_in_parts(monkeypatch, mixed_files):
    how = (["id", "name", "score"], ",", None, None)
    open_file = lambda name: lambda: guarded.open_url(f"{mixed_files}/{name}")
    whole = [r for part in guarded.guarded_records(open_file("good.csv.gz"), *how) for r in part]
    monkeypatch.setattr(guarded, "HELD_CHARACTERS", 1000)
    monkeypatch.setattr(guarded, "ROWS_AT_ONCE", 100)
    parts = list(guarded.guarded_records(open_file("good.csv.gz"), *how))
    assert [r for part in parts for r in part] == whole and len(whole) == 5000
    assert max(map(len, parts)) == 100
    assert len(list(guarded.guarded_records(open_file("cut.csv.gz"), *how))[0]) == 1  # none of its rows


def test_comments_missing_values_and_clashing_columns(spark, tmp_path, rows):
    (tmp_path / "c.tsv").write_text("# x\nid\tname\n#y\n1\tNA\n2\t#z\n")
    manifest = spark.createDataFrame([(f"{tmp_path}/c.tsv",)], "url string")
    df = scan_files(manifest, "url", "id int, name string", comment="#", missing="NA")
    assert rows(df, "id", "name", "file_line") == [(1, None, 4), (2, "#z", 5)]
    with pytest.raises(ValueError, match="id"):
        scan_files(manifest.withColumn("id", manifest.url), "url", "id int")
    assert scan_files(manifest.limit(0), "url", "id int, name string").count() == 0


def test_every_line_is_good_or_rejected(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text(BODY)
    lines = [f"{i},n,{i}.5" if i % 7 else f"{i},n" for i in range(3000)]
    (tmp_path / "b.csv").write_text("id,name,score\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # b.csv is read in several parts
    try:
        checked = read_checked(spark, str(tmp_path), SCORES)
        good, rejected = checked.good.collect(), checked.rejected.collect()
        assert checked.good.select("name").count() == checked.good.count() == len(good)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(good) + len(rejected) == 3000 + 8
    refused = [r for r in rejected if r.file.endswith("b.csv")]
    assert {r.line for r in refused} == {line for i, line in enumerate(lines) if i % 7 == 0}
    assert all(r.reason == "2 fields, expected 3" for r in refused)
    # a place leads to its line: records of a part begin behind the first line break at or after its start
    content = (tmp_path / "b.csv").read_text()
    assert len({r.part_start for r in refused}) > 1
    for r in refused:
        after = content[r.part_start :].split("\n")[1:]
        assert after[r.record - 1] == r.line
    reasons = {r.line: r.reason for r in rejected if r.file.endswith("a.csv")}
    assert reasons["x,b,1"] == "id does not fit its type" and reasons["3"] == "1 fields, expected 3"
    assert reasons['4,"say ""q""",oops'] == "score does not fit its type" and len(reasons) == 5


def test_documents_are_parsed_once(spark, plan, rows):
    data = [(1, '{"a": {"b": [7, "x"]}, "$k": 1.5}'), (2, '{"a": '), (3, None), (4, "null"), (5, '{"a": {"b": "text"}}'), (6, "")]
    df = spark.createDataFrame(data, "id int, text string")
    documents = parse_documents(df, "text")
    assert rows(documents.bad) == [(2, '{"a": '), (6, "")]
    paths = {"first": ("$.a.b[0]", "int"), "second": ("$.a.b[1]", "string"), "price": ("$['$k']", "double"), "kind": ("$.a.b[1]", "int")}
    found = document_paths(documents.good, paths)
    assert rows(found) == [
        (1, 7, "x", 1.5, None), (3, None, None, None, None), (4, None, None, None, None), (5, None, None, None, None),
    ]
    assert "parse_json" not in plan(found)  # the parsed form is what is stored
    assert parse_documents(df.limit(0), "text").good.count() == 0


def test_merged_profiles_equal_one_pass(spark):
    df = spark.range(20_000).selectExpr(
        "id", "id % 7 AS part", "concat('t', id % 5000) AS name", "IF(id % 10 = 0, NULL, sqrt(id)) AS root", "id = 5 AS flag",
        "IF(id % 100 = 0, double('NaN'), 1.0D) AS odd",
    )
    parts = profile_parts(df, ["part"])
    assert parts.count() == 7 * 5
    half = merge_profiles(parts.filter("part < 3")).unionByName(merge_profiles(parts.filter("part >= 3")))
    merged = {r.column: r for r in read_profile(merge_profiles(half)).collect()}
    whole = {r.column: r for r in read_profile(merge_profiles(profile_parts(df.drop("part")))).collect()}
    assert merged.keys() == whole.keys() == {"id", "name", "root", "flag", "odd"}
    for name, r in merged.items():
        for exact in ("type", "rows", "nulls", "low", "high", "least", "greatest"):
            assert r[exact] == whole[name][exact]
    truth = {"id": 20_000, "name": 5000, "root": 18_000, "flag": 2, "odd": 2}
    for name, exact in truth.items():
        assert abs(merged[name].distinct - exact) <= 0.03 * exact
        assert abs(merged[name].distinct - whole[name].distinct) <= 0.03 * exact
    for rank, value in zip((0.25, 0.5, 0.75), merged["id"].quantiles):
        assert abs(value / 20_000 - rank) <= 0.015
    assert merged["name"].quantiles is None and merged["flag"].least == "false"
    assert (merged["odd"].low, merged["odd"].high) == (1.0, 1.0)
    by_part = read_profile(merge_profiles(parts, ["part"])).filter("column = 'id'").collect()
    assert sorted((r.part, r.low) for r in by_part) == [(i, float(i)) for i in range(7)]


def test_a_discarded_intermediate_leaves_no_files(spark, tmp_path):
    first, second = (written(spark.range(n), "discarded") for n in (3, 4))
    assert first.count() == 3 and len(second.inputFiles()) > 0
    discard(first)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        first.count()
    assert second.count() == 4
    discard(second, written(spark.range(0), "discarded"))


def test_bad_lines_fail_unless_asked_otherwise(spark, tmp_path, rows):
    """A longer line, a shorter one, a misfit: no reader loses them in silence."""
    for name, line in (("long", "1,a,9"), ("short", "2"), ("misfit", "x,b")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(f"id,name\n0,z\n{line}\n")
        (tmp_path / name / "f.tsv").write_text(f"#c=d\nid\tname\n0\tz\n{line}\n".replace(",", "\t"))
        folder = f"{tmp_path}/{name}"
        with pytest.raises(Exception, match="(?i)malformed|failed_read|fail"):
            read_csv(spark, f"{folder}/f.csv", "id int, name string").collect()
        kept = read_csv(spark, f"{folder}/f.csv", "id int, name string", bad_lines="null")
        expected = {"long": (1, "a"), "short": (2, None), "misfit": (None, "b")}[name]
        assert rows(kept) == sorted([(0, "z"), expected], key=repr)
        if name != "misfit":  # texts fit any line of the right length, and lengths are checked whatever is read
            with pytest.raises(Exception, match="(?i)malformed|failed_read|fail"):
                read_csv(spark, f"{folder}/f.csv", "id int, name string").select("name").collect()
            with pytest.raises(Exception, match="(?i)malformed|failed_read|fail"):
                read_commented_tsv(spark, f"{folder}/f.tsv", "id STRING, name STRING").collect()
            loose = read_commented_tsv(spark, f"{folder}/f.tsv", "id STRING, name STRING", bad_lines="null")
            assert loose.count() == 2
        manifest = spark.createDataFrame([(f"{folder}/f.csv",)], "url string")
        with pytest.raises(Exception, match="(?i)malformed|failed_read|fail"):
            scan_manifest(spark, manifest, "url", folder, "id int, name string", sep=",").collect()
    with pytest.raises(ValueError, match="bad_lines"):
        read_csv(spark, "x", "id int", bad_lines="drop")


def test_a_file_per_key_is_written_and_named_by_the_tasks(spark, tmp_path, rows):
    """Keys of many rows and of one, in the order asked for, bytes as they are; a second try leaves one file."""
    lines = [(k, place, f"{k}-{place}".encode()) for k in range(200) for place in range(k % 7 + 1)]
    lines += [(1000, place, b"\x1f\x8b%05d" % place) for place in range(30_000)]
    df = spark.createDataFrame(lines, "k long, place int, line binary").repartition(5, "place")
    for _ in range(2):
        files = write_file_per_key(df, "k", ["place"], "line", str(tmp_path / "out"))
    named = spark.createDataFrame([("a/b c", 0, "x")], "k string, place int, line string")
    texts = write_file_per_key(named, "k", ["place"], "line", f"file://{tmp_path}/texts")
    found = {r.k: r.file for r in files.collect()}
    expected = {}
    for k, _, line in lines:
        expected.setdefault(k, []).append(line)
    assert {k: Path(file).read_bytes() for k, file in found.items()} == {k: b"\n".join(v) + b"\n" for k, v in expected.items()}
    assert len(list((tmp_path / "out").iterdir())) == len(expected)
    assert rows(texts) == [("a/b c", f"file://{tmp_path}/texts/k=a%2Fb%20c")]
    assert rows(scan_files(texts.withColumnRenamed("k", "name"), "file", "x string").select("file_error")) == []
    with pytest.raises(Exception, match="a file needs a name"):
        write_file_per_key(df.select(F.lit(None).cast("long").alias("k"), "place", "line"), "k", ["place"], "line", str(tmp_path / "no"))


def test_files_of_analyses_are_not_listed_by_the_driver(spark, plan):
    table = spark.createDataFrame([(k, f"g{i}", i) for k in range(8, 40) for i in range(3)], "analysis_id long, gene string, counts long")
    _, files = genomic._write_files(SimpleNamespace(spark=spark), table, "analysis_id", ["gene", "counts"], "\t", "view\tmany")
    assert "binaryFile" not in plan(files) and files.rdd.getNumPartitions() < 32 and files.count() == 32
    scanned = scan_files(files, "file", "gene string, counts long").collect()
    faults = {r.analysis_id: r.file_error for r in scanned if r.file_error}
    assert sorted({k % 7 for k in faults}) == [0, 1, 2, 3] and "EOFError" in faults[8]
    assert sorted((r.gene, r.counts) for r in scanned if r.analysis_id == 11) == [("g0", 0), ("g1", 1), ("g2", 2)]

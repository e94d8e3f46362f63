"""CSV readers, checks and imports on edge files, against Python's csv module."""

import contextlib
import csv
import io
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from slicelake.operators import quality
from slicelake.sinks import imports
from slicelake.sources import csvfiles, generated, records

EDGE = (
    'ID,Name,Note\r\n1,"Smith, J","says ""hi"""\r\n2," two\nlines ",plain\r\n\r\n   \r\n3,short\r\n4,a,b,c\r\n'
    '"","",\r\n5,  padded\t,"back\\slash"\r\n'
)


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(text)
    return path


def loader_rows(text, columns):
    """The loader's reading of a file, said with Python's reader."""
    head, *body = csv.reader(io.StringIO(text, newline=""))
    places = [[h.lower() for h in head].index(c) for c in columns]
    return [tuple(line[i].strip() if i < len(line) else "" for i in places) for line in body if line]


def test_object_csv_matches_python(spark, tmp_path, rows):
    path = put(tmp_path, "edge file+%20.csv", EDGE)
    columns = ["note", "id", "name"]
    got = rows(csvfiles.read_object_csv(spark, [path], columns).select(*columns))
    assert got == sorted(loader_rows(EDGE, columns), key=repr)


def test_headers_match_in_any_case_and_order(spark, tmp_path, rows):
    a = put(tmp_path, "a.csv", "EMPLOYEE_ID,FIRST_NAME\n1,Jane\n")
    b = put(tmp_path, "b.csv", "first_name,employee_id\nJohn,2\n")
    c = put(tmp_path, "c.csv", "first_name\nJohn\n")
    frame = csvfiles.read_object_csv(spark, [a, b, c], ["employee_id", "first_name"])
    assert rows(frame.select("employee_id", "first_name")) == [("1", "Jane"), ("2", "John")]


def test_header_findings(spark, tmp_path):
    files = {
        "dup": "ID,id\n1,2\n", "bom": "﻿id,name\n", "extra": "id,name,x\n", "less": "id\n", "good": "Name,ID\n", "empty": "",
    }
    paths = [put(tmp_path, f"{k}.csv", v) for k, v in files.items()] + [str(tmp_path / "gone.csv")]
    headers = csvfiles.probe_headers(csvfiles.file_frame(spark, paths)).cache()
    errors = {os.path.basename(r["file"]): r["error"] for r in headers.where("error IS NOT NULL").collect()}
    assert list(errors) == ["gone.csv"] and "FileNotFoundError" in errors["gone.csv"]
    found = quality.header_findings(headers.where("error IS NULL"), F.array(F.lit("id"), F.lit("name")))
    messages = {os.path.basename(r["file"])[:-4]: r["message"] for r in found.collect()}
    assert messages == {
        "dup": "CSV has duplicate column names when compared case-insensitively: ID, id.",
        "bom": "CSV columns do not match target table (missing: id; unknown: ﻿id).",
        "extra": "CSV columns do not match target table (unknown: x).",
        "less": "CSV columns do not match target table (missing: name).",
        "empty": "CSV columns do not match target table (missing: id, name).",
    }


def test_headers_are_folded_once(spark):
    headers = spark.createDataFrame(
        [(1, ["ID", "n"]), (2, ["id", "Id"]), (3, ["name", "iD"]), (4, None), (5, []), (6, ["id", None, "name"])], "file int, header array<string>"
    )
    found = quality.header_findings(headers, F.array(F.lit("id"), F.lit("Name")))
    assert {r["file"]: r["message"] for r in found.collect()} == {
        1: "CSV columns do not match target table (missing: Name; unknown: n).",
        2: "CSV has duplicate column names when compared case-insensitively: id, Id.",
        5: "CSV columns do not match target table (missing: id, Name).",
    }
    # the header's names and the expected ones
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2


def test_row_arity(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b,c\n1,2,3\n1,2\n1,2,3,4\n1,"x,""y""",3\n1,2,3,\n"p\nq",2,3,4\n,,\n')
    rows = csvfiles.with_row_numbers(csvfiles.read_import_csv(spark, path, ["a", "b", "c"]))
    found = quality.arity_findings(rows, F.lit(3)).select("row_no", "finding", "cells").collect()
    assert sorted(map(tuple, found)) == [(3, "short", 2), (4, "surplus", 4), (6, "surplus", 4), (7, "surplus", 4)]


def test_row_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 3000)):
        put(tmp_path, f"{name}.csv", "k,v\n" + "".join(f"{name},{i}\n" for i in range(n)))
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = csvfiles.with_row_numbers(csvfiles.read_object_csv(spark, paths, ["k", "v"]))
        assert numbered.where(F.col("row_no") != F.col("v").cast("bigint") + 2).count() == 0
        ids = csvfiles.with_row_id(numbered).agg(F.countDistinct("ROW_ID"), F.min("ROW_ID"), F.max("ROW_ID")).first()
        assert tuple(ids) == (8001, 1, 8001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_all_files_are_split(spark, tmp_path, rows):
    """Quoted line breaks do not keep a file in one task, and one read is enough unless a record goes over a split's end."""
    text = "id,note\n" + "".join(f'{i},"say ""{i}"", ok"\n' for i in range(3000))
    texts = {"pl ain%20": text, "broken": text + '3000,"two\nlines"\n', "small": "id,note\n1,x\n"}
    paths = [put(tmp_path, f"{name}.csv", body) for name, body in texts.items()]
    with splits_of(spark, "16384"):
        guess = records.Splits()
        headers = csvfiles.probe_headers(csvfiles.file_frame(spark, paths))
        frame = csvfiles.read_object_csv(spark, paths, ["id", "note"], headers, guess)
        got = rows(frame.select("file", "id", "note"))
        assert guess.held()
        assert frame.select("file", "block_start").distinct().groupBy("file").count().where("count > 3").count() == 2
    want = [(p, *r) for p, body in zip(paths, texts.values()) for r in loader_rows(body, ["id", "note"])]
    assert got == sorted(want, key=repr)


@contextlib.contextmanager
def splits_of(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def odd_text(seed, count):
    """Records of all kinds of cells, quoted line breaks longer than a split among them."""
    random.seed(seed)
    end = random.choice(["\n", "\r\n", "\r"])
    cells = ["x", "", "a b", '"q"', '"a,b"', '"say ""hi"""', '"two\nlines"', 'st"ray', '"x\r\ny"', '"' + "long\n" * 300 + '"', '"a""\n""b"', "é", '""']
    lines = [",".join(random.choices(cells, k=random.choice([1, 2, 2, 2, 3]))) for _ in range(count)]
    lines += ["", "   ", 'last,"no\nend"']
    return "id,note" + end + end.join(lines) + random.choice(["", end])


@pytest.mark.parametrize("split", ["300", "4096", "1g"])
def test_records_equal_python_for_all_splits(spark, tmp_path, split):
    texts = {f"f{i}": odd_text(i, 40) for i in range(6)}
    texts["head"] = '"i\nd","no\nte"\n1,2\n"3\n",4\n'
    texts["open"] = 'id,note\n1,"never\nends\n' + "x,y\n" * 100
    texts["none"] = "id,note"
    paths = {name: put(tmp_path, f"{name}.csv", text) for name, text in texts.items()}
    with splits_of(spark, split):
        rows = records.cut(spark, list(paths.values())).select("file", "block_start", "place", "value")
        found = csvfiles.with_row_numbers(rows, first=0).select("file", "row_no", "value").collect()
    for name, text in texts.items():
        # a cell that never closes ends before the file's last line end
        want = [r for r in csv.reader(io.StringIO(text.removesuffix("\n"), newline="")) if r][1:]
        got = [r["value"] for r in sorted(found, key=lambda r: r["row_no"]) if r["file"] == paths[name]]
        assert [next(csv.reader([v])) for v in got] == want, name


def cut_by_hand(text, size):
    """Splits of ``size`` bytes as Spark makes them, their states composed one after the other, and cut on their own."""
    lines, at, splits = text.encode().removesuffix(b"\n").split(b"\n"), 0, {}
    for line in lines:
        splits.setdefault(0 if at == 0 else (at - 1) // size * size, []).append(line)
        at += len(line) + 1
    quotes, opener, whole, pieces = records.Quotes(",", '"'), None, [], {}
    for start, some in sorted(splits.items()):
        cutter = records.Cutter(quotes, 1, start, opener)
        cutter.lines(b"".join(some), [0, *itertools.accumulate(map(len, some))])
        began = start if cutter.inside and cutter.opener is None else cutter.opener
        cutter.close()
        opener = began if cutter.inside else None
        for place, edge, first, value in cutter.out:
            if edge == records.RECORD:
                whole.append(((start, place), value))
            else:
                pieces.setdefault(first, [None, []])[1].append(value)
                if edge == records.TAIL:
                    pieces[first][0] = place
    whole += [((first, place), b"\n".join(some)) for first, (place, some) in pieces.items() if place is not None]
    return [v.decode() for _, v in sorted(whole)]


@pytest.mark.parametrize("size", [16, 64, 500, 1 << 30])
def test_cutter_equals_python(size):
    for seed in range(30):
        text = odd_text(seed, 60)
        want = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
        assert [next(csv.reader([v])) for v in cut_by_hand(text, size)] == want, seed


def test_guess_is_refuted(spark, tmp_path):
    crossing = put(tmp_path, "crossing.csv", "id,note\n1,\"" + "line\n" * 2000 + '"\n2,x\n')
    wrong = tmp_path / "wrong.csv"
    wrong.write_bytes(b"id,note\n" + b"1,x\n" * 20_000 + b"1,\xff\n")  # far behind what the probe of the header reads
    for path, size in ((crossing, "1024"), (str(wrong), "1g")):
        with splits_of(spark, size):
            guess = records.Splits()
            headers = csvfiles.probe_headers(csvfiles.file_frame(spark, [path]))
            csvfiles.read_object_csv(spark, [path], ["id", "note"], headers, guess).count()
            assert not guess.held()
            checked, splits = csvfiles.check_files(spark, headers)
            assert csvfiles.read_object_csv(spark, [path], ["id", "note"], checked, splits).count() == (2 if path == crossing else 0)


@pytest.mark.parametrize("split", ["4096", "1g"])
def test_one_result_for_all_split_sizes(spark, tmp_path, split):
    body = "".join(f"{i},v{i}\n" for i in range(2000))
    texts = {
        "blank": "k,v\n" + body + "   \n" + body + "2,b\n",
        "quoted": "k,v\n" + body + '1,"a\nb"\n' + body,
        "crlf": "k,v\r\n" + body.replace("\n", "\r\n"),
        "stray": 'k,v\nx"y,"two\nlines"\n' + body,
        "plain": "k,v\n" + body,
    }
    paths = [put(tmp_path, f"{name}.csv", text) for name, text in texts.items()]
    wrong = tmp_path / "wrong.csv"
    wrong.write_bytes(b"k,v\n" + body.encode() + b"1,\xff\n")
    paths.append(str(wrong))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        headers = csvfiles.checked_headers(spark, paths).cache()
        errors = {r["file"]: r["error"] for r in headers.collect() if r["error"]}
        assert list(errors) == [str(wrong)] and "UTF-8" in errors[str(wrong)]
        rows = csvfiles.with_row_numbers(csvfiles.read_object_csv(spark, paths, ["k", "v"], headers))
        counts = {r["file"].rsplit("/", 1)[1][:-4]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
        assert counts == {"blank": 4002, "quoted": 4001, "crlf": 2000, "stray": 2001, "plain": 2000}
        # the row of white space counts, the rows behind it keep their numbers
        last = rows.where("k = '2' AND v = 'b'").select("row_no").collect()
        assert [r["row_no"] for r in last] == [4003]
        with pytest.raises(ValueError, match="UTF-8"):
            csvfiles.read_import_csv(spark, str(wrong), ["k", "v"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_profile_and_delimiter(spark, tmp_path):
    path = put(tmp_path, "a.csv", "﻿First Name;Age\nAda;36\n\"a;b\";41\n")
    assert csvfiles.profile_csv(spark, path) == {
        "delimiter": ";", "raw_header": ["First Name", "Age"], "header": ["first_name", "age"]
    }
    plain = put(tmp_path, "b.csv", "one\ntwo\n")
    assert csvfiles.profile_csv(spark, plain)["delimiter"] == ","


def test_import(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", "id|name|d\n1|Ada|2024-01-02\n2||\n")
    database = f"imp_{os.getpid()}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path / 'wh'}'")
    spec = imports.ImportSpec(
        database, "people", {"id": "BIGINT", "name": "VARCHAR(10)", "d": "DATE"}, ["id"], {"name", "d"},
        partition_by_batch=True, delimiter="|",
    )
    assert imports.import_csv(spark, path, spec) == 2
    table = spark.table(f"{database}.people")
    assert rows(table.select("id", "name", F.col("d").cast("string"), "batch_num")) == [(1, "Ada", "2024-01-02", 0), (2, None, None, 0)]
    assert dict(spark.sql(f"SHOW TBLPROPERTIES {database}.people").collect())["slicelake.primary_key"] == "id,batch_num"


@pytest.mark.parametrize(
    "body, problem",
    [
        ("1,Ada\n ,Bob\n", "CSV row 3 has no value for primary-key column 'id'"),
        ("1,Ada,x\n", "more values than its header"),
        ("x,Ada\n", "incompatible value in id"),
        ("1,Ada Lovelace\n", "value too long in name"),
        ("1,A\n1,B\n", "duplicate primary-key value"),
        ("99999999999999999999,A\n", "incompatible value in id"),
    ],
)
def test_import_refuses(spark, tmp_path, body, problem):
    path = put(tmp_path, "a.csv", "id,name\n" + body)
    spec = imports.ImportSpec("nowhere", "t", {"id": "BIGINT", "name": "VARCHAR(8)"}, ["id"])
    with pytest.raises(ValueError, match=problem):
        imports.import_csv(spark, path, spec)
    assert not spark.catalog.databaseExists("nowhere")


def test_import_spec_rules():
    spec = imports.ImportSpec("d", "t", {"a": "TEXT"}, partition_by_batch=True)
    assert spec.add_row_id and spec.primary_key == ["ROW_ID"]
    for kind in ("VARCHAR(0)", "VARCHAR(65536)", "BLOB"):
        with pytest.raises(ValueError):
            imports.ImportSpec("d", "t", {"a": kind})
    with pytest.raises(ValueError):
        imports.ImportSpec("d", "t", {"a": "TEXT"}, ["b"])
    with pytest.raises(ValueError):
        imports.ImportSpec("d", "1t", {"a": "TEXT"})


def test_list_objects(spark, tmp_path):
    for name in ("feed/eu/a.csv", "feed/eu/b.txt", "feed/us/c.csv", "other/d.csv"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        put(tmp_path, name, "x\n")
    found = csvfiles.list_objects(spark, str(tmp_path), "feed/*.csv")
    assert sorted(r["name"] for r in found.collect()) == ["feed/eu/a.csv", "feed/us/c.csv"]
    assert csvfiles.list_objects(spark, str(tmp_path), "feed/*", 1).count() == 1


def line_bytes(record, payload):
    return len(f"{record},2026-07-19 12:00:00.000000,group-{record % 16:02d},{'x' * payload},{record % 10000}.25\n")


@pytest.mark.parametrize("target, start, payload", [(1, 1, 12), (44, 1, 12), (100_000, 1, 128), (1_000_000, 99_990, 12), (700_000, 9_500, 480)])
def test_generated_bytes(spark, target, start, payload):
    written, record = 43, start
    while written < target:
        written += line_bytes(record, payload)
        record += 1
    assert generated.rows_for_bytes(target, start, payload) == record - start
    ids = spark.range(start, record + 50)
    assert generated.limit_bytes(ids, target, payload).count() == record - start
    frame = generated.generate_bytes(spark, target, start, payload)
    size = frame.agg(F.sum(F.length(F.concat_ws(",", *frame.columns)) + 1)).first()[0] or 0
    assert size + 43 == written


def test_import_keeps_the_constraints(spark, tmp_path, rows):
    """Missing values, keys equal as numbers, and a second import into the same table."""
    database = f"twice_{os.getpid()}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path / 'wh'}'")
    keyed = imports.ImportSpec(database, "keyed", {"id": "BIGINT", "name": "TEXT"}, ["id"])
    good = put(tmp_path, "good.csv", "id,name\n1,A\n2,B\n")
    for name, body, problem in (("gap", "1,A\n2,\n", "no value in name"), ("same", "1,A\n01,B\n", "duplicate primary-key")):
        with pytest.raises(ValueError, match=problem):
            imports.import_csv(spark, put(tmp_path, f"{name}.csv", "id,name\n" + body), keyed)
    assert imports.import_csv(spark, good, keyed) == 2
    with pytest.raises(ValueError, match="in the target already"):
        imports.import_csv(spark, put(tmp_path, "more.csv", "id,name\n3,C\n2,B\n"), keyed)
    assert spark.table(f"{database}.keyed").count() == 2
    blank = imports.ImportSpec(database, "blanks", {"id": "BIGINT", "name": "TEXT"}, ["id"])
    assert imports.import_csv(spark, put(tmp_path, "blank.csv", "id,name\n1,  \n"), blank) == 1   # blanks are a value
    numbered = imports.ImportSpec(database, "numbered", {"name": "TEXT"}, add_row_id=True)
    for _ in range(2):
        assert imports.import_csv(spark, put(tmp_path, "text.csv", "name\nx\ny\n"), numbered) == 2
    assert rows(spark.table(f"{database}.numbered").select("ROW_ID").orderBy("ROW_ID")) == [(1,), (2,), (3,), (4,)]


def test_headers_are_folded(spark):
    found = spark.range(1).select(quality.header_diff(F.array(F.lit("STRASSE")), F.array(F.lit("straße"))).alias("d")).first()["d"]
    assert found["missing"] == [] and found["unknown"] == []

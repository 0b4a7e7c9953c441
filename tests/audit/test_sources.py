"""Files that are read in parts, in several encodings, from folders of which nothing is left out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillet.sources import delimited, listing, records


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_one_task(spark, path, names, sep, encoding):
    """(rows, number of rejects) as Spark's reader gives them when one task reads the file."""
    schema = ", ".join(f"`{n}` STRING" for n in names) + ", bad STRING"
    read = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
    got = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("columnPruning", "false").csv(str(path)).collect()
    return sorted((tuple(r)[:-1] for r in got if r["bad"] is None), key=repr), sum(r["bad"] is not None for r in got)


def some_file(seed, encoding, sep, end="\n"):
    rng = random.Random(seed)
    lines = [sep.join(("id", "note", "more"))]
    for i in range(400):
        kind = rng.random()
        value = "".join(rng.choice(("a", "ü", "ਅĀ" if encoding.startswith("UTF") else "é", " ", "bc", "''")) for _ in range(rng.randint(1, 12)))
        if kind < 0.3:
            value = '"' + value.replace("a", '""') + "".join(rng.choice((end, sep, end + sep, '""', "x")) for _ in range(rng.randint(0, 6))) + '"'
        elif kind < 0.35:
            value = f'{value} 5" pipe'
        elif kind < 0.38:
            value = f'"{value}" tail'
        elif kind < 0.4:
            value = '"' + (f"line {i}{end}" * rng.randint(50, 200)) + '"'
        elif kind < 0.45:
            value = rng.choice(("", '""'))
        lines.append(sep.join((str(i), value, str(i % 7))) if kind < 0.97 else sep.join((str(i), value)))
    return end.join(lines) + end


@pytest.mark.parametrize("encoding,sep,end", [("UTF-8", ",", "\n"), ("ISO-8859-1", ";", "\r\n"), ("UTF-16LE", ",", "\n"), ("UTF-16BE", "\t", "\r\n"), ("UTF-8", "|", "\n")])
def test_parts_give_what_one_task_gives(spark, tmp_path, monkeypatch, encoding, sep, end):
    monkeypatch.setattr(records, "PART", 1024)
    text = some_file(f"{encoding}{sep}", encoding, sep, end)
    path = tmp_path / ("x.tsv" if sep == "\t" else "x.csv")
    path.write_bytes((b"\xff\xfe" if encoding == "UTF-16LE" else b"\xfe\xff" if encoding == "UTF-16BE" else b"") + text.encode(encoding))
    out = delimited.read_folder(spark, str(tmp_path))
    table = next(iter(out["tables"].values()))
    want, bad = by_one_task(spark, path, table.columns, sep, "UTF-16" if encoding.startswith("UTF-16") else encoding)
    assert table.columns == ["id", "note", "more"] and rows_of(table) == want
    rejects = out["rejects"].collect()
    assert len(rejects) == bad > 0
    lines = text.split("\n")
    for r in rejects:
        assert r["line"] is None or lines[r["line"] - 1].startswith(r["raw"].split("\n")[0].removesuffix("\r"))


@pytest.mark.parametrize("encoding,part", [("UTF-8", 700), ("UTF-16LE", 1000), ("UTF-8", 1 << 20)])
def test_hidden_names_are_read_in_ranges(spark, tmp_path, monkeypatch, encoding, part):
    """A file that Spark's readers leave out for its name gives what it gives under another."""
    monkeypatch.setattr(records, "PART", part)
    body = (b"\xff\xfe" if encoding == "UTF-16LE" else b"") + some_file(3, encoding, ",").replace("ਅĀ", "ੳ").encode(encoding)
    for name in ("_x %20.csv", "x %20.csv"):
        (tmp_path / name).write_bytes(body)
    forms = [records.Form(listing.plain(str(tmp_path / name)), ",", encoding, True, 3, "\n", len(body)) for name in ("_x %20.csv", "x %20.csv")]
    got = [records.records(spark, [f]) for f in forms]
    one, other = (rows_of(g.rows.select("text", "fields")) for g in got)
    assert one == other and len(one) == 400 and forms[0].hidden and not got[0].left


def test_parts_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PART", 2048)
    (tmp_path / "x.csv").write_text(some_file(1, "UTF-8", ","))
    form = records.Form(listing.plain(str(tmp_path / "x.csv")), ",", "UTF-8", True, 3)
    found = records.records(spark, [form])
    assert found.parts.count() > 5 and not found.left and found.rows.select("start").distinct().count() > 3


def test_a_line_end_across_two_characters(spark, tmp_path, monkeypatch):
    """ਅĀ holds the bytes of a line end askew; where a part begins there, one task reads the file."""
    monkeypatch.setattr(records, "PART", 512)
    (tmp_path / "x.csv").write_bytes(b"\xff\xfe" + ("id,v\n" + "".join(f"{i},{'ਅĀ' * (i % 50)}\n" for i in range(200))).encode("UTF-16LE"))
    out = delimited.read_folder(spark, str(tmp_path))["tables"]["x_csv"]
    assert rows_of(out) == sorted(((str(i), "ਅĀ" * (i % 50) or None) for i in range(200)), key=repr)


def test_fields_and_states():
    assert records.fields_of('a,"b ""c"", d",,"",e', ",") == ["a", 'b "c", d', None, None, "e"]
    assert records.fields_of('5" pipe,"x" y,"q"', ",") == ['5" pipe', '"x" y', "q"]
    assert records.fields_of("", ",") == [None] and records.fields_of("a,", ",") == ["a", None]
    for line, outside, inside in (("a,b", False, True), ('a,"b', True, False), ('x" ,"y', True, True), ('5" pipe', False, False), ('"a","b"', False, False), ('"a""', True, False), ('"', True, False)):
        assert (records.ends_inside(line, False, ","), records.ends_inside(line, True, ",")) == (outside, inside), line


def test_nothing_is_left_out_of_a_folder(spark, tmp_path):
    for name in ("_d.csv", "vendor/v.csv", "venv/w.csv", ".hidden/h.csv", "node_modules/n.csv", "sub dir/ü [1].csv", "deep/er/_x/y.csv", "plain.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("k,v\n1,a\n2,b,c\n")
    for name, body in (("notes.md", "no table"), (".dot.csv", "a,b\n1,2\n"), ("empty.csv", ""), ("~$b.xlsx", "lock"), ("old.xls", "old")):
        (tmp_path / name).write_text(body)
    os.symlink(tmp_path, tmp_path / "loop")
    os.symlink(tmp_path / "gone.csv", tmp_path / "dangling.csv")
    out = delimited.read_folder(spark, str(tmp_path))
    assert set(out["tables"]) == {"d_csv", "v_csv", "ü_1_csv", "y_csv", "plain_csv"}
    assert {n: rows_of(t) for n, t in out["tables"].items()} == {n: [("1", "a")] for n in out["tables"]}
    assert sorted((r["table"], r["line"]) for r in out["rejects"].collect()) == sorted((t, 3) for t in out["tables"])
    told = {r["rel"]: (r["kind"], r["skip_reason"]) for r in out["files"].collect()}
    assert told["notes.md"] == ("other", None) and told["_d.csv"] == ("csv", None) and told["vendor/v.csv"] == ("csv", None)
    assert told["venv"][0] == told["node_modules"][0] == "folder" and told[".hidden"] == ("folder", "hidden") and told[".dot.csv"] == ("csv", "hidden")
    assert told["empty.csv"][1] == "empty file" and told["loop"][1].startswith("it cannot be read") and told["dangling.csv"][1].startswith("it cannot be read")
    assert "~$b.xlsx" in told and told["old.xls"][0] == "legacy"


def test_a_file_that_cannot_be_opened_is_a_row(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n1,a\n")
    os.mkfifo(tmp_path / "pipe.md")
    (tmp_path / "b.csv").write_text("k,v\n1,a\n")
    files = delimited.discover(spark, str(tmp_path))
    (tmp_path / "b.csv").unlink()  # gone between the listing and the look at its head
    monkeypatch.setattr(delimited, "discover", lambda *_: files)
    out = delimited.read_folder(spark, str(tmp_path))
    assert set(out["tables"]) == {"a_csv"}
    assert {r["rel"]: r["skip_reason"] for r in out["files"].collect()}["b.csv"] == "it cannot be read: No such file or directory"


def test_what_tasks_cannot_open_goes_by_the_driver(spark, tmp_path, monkeypatch):
    """On a scheme that only Hadoop knows, listing and heads come through it."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.here.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(delimited, "WHOLE_BYTES", 100)
    (tmp_path / "a.csv").write_text("k,v\n1,a\n2\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.csv").write_text("k,v\n" + "".join(f"{i},{i}\n" for i in range(100)))
    out = delimited.read_folder(spark, "viewfs://here/in")
    assert {n: t.count() for n, t in out["tables"].items()} == {"a_csv": 1, "b_csv": 100} and out["rejects"].count() == 1


def test_plans_do_not_grow_with_files(spark, tmp_path):
    sizes = []
    for n in (2, 12):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"k,v\n1,{i}\n2\n")
        rejects = delimited.read_folder(spark, str(folder))["rejects"]
        assert rejects.count() == n
        sizes.append(str(rejects._jdf.queryExecution().optimizedPlan().toString()).count("Relation"))
    assert sizes[0] == sizes[1]


def test_old_line_ends(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"k,v\r1,a\r2,\"b\rc\"\r3\r")
    out = delimited.read_folder(spark, str(tmp_path))
    assert rows_of(out["tables"]["mac_csv"]) == [("1", "a"), ("2", "b\nc")] or rows_of(out["tables"]["mac_csv"]) == [("1", "a"), ("2", "b\rc")]
    assert [(r["line"], r["raw"]) for r in out["rejects"].collect()] == [(5, "3")]

import re
from pathlib import Path

from blockquery.scripts.facts import chains
from blockquery.scripts.sql_text import sql_text
from blockquery.sources.script_files import listed_files, read_scripts, rejects, write_sql


def scripts_folder(tmp_path):
    folder = tmp_path / "scripts"
    folder.mkdir()
    (folder / "a.scala").write_text('val a = spark.read.table("t")\n  .filter("x > 1")\nval b = a.groupBy("k").count()\n')
    (folder / "b.scala").write_text('val c = spark.read.table("u").select("m"", "n")\nval d = spark.read.table("w")\n')
    (folder / "blank.scala").write_text(" \n\t\n")
    (folder / "empty.scala").write_text("")
    return folder


def test_read_and_rejects(spark, tmp_path):
    folder = scripts_folder(tmp_path)
    scripts = read_scripts(spark, str(folder))
    found = {Path(r.script_id).name: r.content for r in scripts.collect()}
    assert sorted(found) == ["a.scala", "b.scala", "blank.scala"] and found["a.scala"].count("\n") == 3
    wanted = [(f"file:{folder}/{n}.scala",) for n in ("a", "empty", "gone")]
    out = rejects(scripts, spark.createDataFrame(wanted, "script_id string"), listed_files(spark, str(folder)))
    assert sorted((Path(r.script_id).name, r.reason) for r in out.collect()) == [
        ("blank.scala", "empty"),
        ("empty.scala", "empty"),
        ("gone.scala", "missing"),
    ]


def test_write_sql(spark, tmp_path):
    texts = sql_text(chains(read_scripts(spark, str(scripts_folder(tmp_path)))))
    out = tmp_path / "sql"
    write_sql(texts, str(out), files=1)
    (part,) = out.glob("part-*")
    lines = [re.sub(r"(as SQL), .*", r"\1", line) for line in part.read_text().splitlines() if line]
    folder = f"file:{tmp_path}/scripts"
    assert lines == [
        f"-- blockquery: chains of {folder}/a.scala as SQL",
        "SELECT * FROM `t` WHERE x > 1;",
        "SELECT k, count(*) AS count FROM `a` GROUP BY k;",
        f"-- blockquery: chains of {folder}/b.scala as SQL",
        "SELECT * FROM `w`;",
    ]

"""Files by name, lines set apart, cubes of parts, and reports that survive a failure."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import sql, text
from reviewlens.operators import ratings
from reviewlens.plans import run, session
from reviewlens.sources import cubes, files, publish
from tests.test_plans import plan_of
from tests.test_sources import HEADER, line, write_gz

COLUMNS = "marketplace string, review_id string, product_category string, star_rating int"


@pytest.fixture(params=["local", "viewfs", "blank"])
def place(request, spark, tmp_path):
    """A folder by a local path, through a mount that only Hadoop knows, and with blanks in its name."""
    if request.param == "viewfs":
        store = f"store-{tmp_path.parent.name}-{tmp_path.name}".replace("_", "-")  # a mount is read once
        spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./in", f"file://{tmp_path}")
        return tmp_path, f"viewfs://{store}/in"
    if request.param == "blank":
        (tmp_path / "a folder, 100% of it").mkdir()
        return tmp_path / "a folder, 100% of it", str(tmp_path / "a folder, 100% of it")
    return tmp_path, str(tmp_path)


def named(table):
    return sorted(tuple(r) for r in table.select("marketplace", "review_id", "product_category", "star_rating").collect())


def test_files_by_name(spark, reviews, place):
    _, path = place
    rows = [("US", f"r{i}", ["Home Improvement", "PC", "Health & Care"][i % 3], 1 + i % 5) for i in range(30)]
    rows += [("DE", f"d{i}", "PC", 1) for i in range(4)]
    names = files.write_named_tsv(reviews(rows, COLUMNS), f"{path}/named")
    assert sorted(names) == [
        "data_reviews_de_PC_v1_00.tsv.gz",
        "data_reviews_us_Health_&_Care_v1_00.tsv.gz",
        "data_reviews_us_Home_Improvement_v1_00.tsv.gz",
        "data_reviews_us_PC_v1_00.tsv.gz",
    ]
    back = files.read_tsv(spark, f"{path}/named", category_from_file=True)
    assert named(back) == sorted(r for r in rows if r[0] == "US")
    assert named(files.read_tsv(spark, f"{path}/named", True, "de")) == sorted(r for r in rows if r[0] == "DE")
    assert len(files.files_under(spark, f"{path}/named")) == 4
    with pytest.raises(Exception, match="file name needs"):
        files.write_named_tsv(reviews([("US", "r", None, 1)], COLUMNS), f"{path}/refused")


def test_a_name_is_parsed_once_a_file(spark, tmp_path):
    for name in ("data_reviews_us_A_v1_00.tsv.gz", "data_reviews_us_A_v1_x.tsv.gz", "data_reviews_de_A_v1_00.tsv.gz"):
        write_gz(tmp_path / name, [HEADER, line(1)])
    rows = files.read_tsv(spark, str(tmp_path), category_from_file=True)
    assert [Path(p).name for p in sorted(rows.inputFiles())][0] == "data_reviews_us_A_v1_00.tsv.gz"
    assert not any("_de_" in p for p in rows.inputFiles())
    plan = plan_of(rows)
    lines_side, files_side = plan.split("BroadcastExchange")
    assert "csv" in lines_side and "regexp" not in lines_side.lower() and "rlike" not in lines_side.lower()
    assert "binaryFile" in files_side and "content" not in files_side
    assert rows.count() == 1
    # Without a mark of its marketplace in a file's name there is nothing to read.
    assert files.read_tsv(spark, str(tmp_path), True, "fr").count() == 0


def test_lines_set_apart(spark, place):
    folder, path = place
    (folder / "in").mkdir()
    short, long, word = "US\tc2\tr2", line(3) + "\textra", line(4, star="five")
    write_gz(folder / "in" / "data_reviews_us_A_v1_00.tsv.gz", [HEADER, line(1), short, long, HEADER])
    write_gz(folder / "in" / "data_reviews_us_B_C_v1_00.tsv.gz", [HEADER, word, line(5, star="")])
    source = f"{path}/in"
    found = files.split_tsv(spark, source, f"{path}/out/reviews", f"{path}/out/bad")
    assert (found.n_reviews, found.n_bad) == (2, 3)
    assert named(found.reviews) == named(files.read_tsv(spark, source, bad="drop"))
    assert sorted(map(tuple, found.bad.collect())) == sorted(map(tuple, files.bad_lines(spark, source).collect()))
    assert files.read_parquet(spark, f"{path}/out/reviews").count() == 2
    again = files.split_tsv(spark, source, f"{path}/by-file/reviews", f"{path}/by-file/bad", category_from_file=True)
    assert [r[2] for r in named(again.reviews)] == ["A", "B C"] and again.n_bad == 3
    with pytest.raises(FileExistsError):
        files.split_tsv(spark, source, f"{path}/out/reviews", f"{path}/elsewhere")
    assert not any("_split" in p for p in files.files_under(spark, path))


def test_nothing_bad_and_nothing_good(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    write_gz(tmp_path / "good" / "a.tsv.gz", [HEADER, line(1)])
    write_gz(tmp_path / "bad" / "a.tsv.gz", [HEADER, "x"])
    good = files.split_tsv(spark, str(tmp_path / "good"), str(tmp_path / "g1"), str(tmp_path / "g2"))
    assert (good.n_reviews, good.n_bad, good.reviews.count(), good.bad.count()) == (1, 0, 1, 0)
    bad = files.split_tsv(spark, str(tmp_path / "bad"), str(tmp_path / "b1"), str(tmp_path / "b2"))
    assert (bad.n_reviews, bad.n_bad, bad.reviews.count(), bad.bad.count()) == (0, 1, 0, 1)


def test_one_reading_sets_lines_apart(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    write_gz(tmp_path / "in" / "a.tsv.gz", [HEADER, line(1), "x"])
    read = []
    monkeypatch.setattr(files, "_read_lines", lambda *a, f=files._read_lines: (read.append(a), f(*a))[1])
    files.split_tsv(spark, str(tmp_path / "in"), str(tmp_path / "r"), str(tmp_path / "b"))
    assert len(read) == 1


def cube_of(counted):
    return sorted(str(tuple(r)) for r in ratings.rating_cube(counted).withColumn("helpful_share", F.round("helpful_share", 9)).collect())


def test_cubes_of_parts(spark, reviews, place):
    _, path = place
    columns = COLUMNS + ", helpful_votes int, total_votes int, vine string, verified_purchase string"
    rows = [("US", str(i), "AB"[i % 2], 1 + i % 5, i % 3, i % 4, "N", "YN"[i % 2]) for i in range(60)]
    table = reviews(rows, columns)
    number = F.col("review_id").cast("int")
    where = f"{path}/cubes"
    with pytest.raises(FileNotFoundError):
        cubes.read_parts(spark, where)
    assert cubes.put_part(table.where(number < 30), where, "first") == 30
    assert cubes.put_part(table.where(number < 10), where, "second") == 10
    assert cubes.put_part(table.where(number >= 30), where, "second") == 30
    assert cubes.parts_of(spark, where) == ["first", "second"]
    assert cube_of(cubes.read_parts(spark, where)) == cube_of(table)
    before = {p for p in files.files_under(spark, where) if "part=first" in p}
    assert cubes.put_part(table.where("false"), where, "second") == 0
    assert cubes.parts_of(spark, where) == ["first"]
    assert {p for p in files.files_under(spark, where) if "part=first" in p} == before
    assert cube_of(cubes.read_parts(spark, where)) == cube_of(table.where(number < 30))
    with pytest.raises(ValueError, match="cannot name"):
        cubes.put_part(table, where, "a/b")


class Broken(Exception):
    pass


def test_a_run_that_fails_anywhere_goes_on(spark, tmp_path, monkeypatch):
    """Every step on files fails once: whatever the step, each report is the old or the new one or on its way
    there, the same run ends the work, and nothing done is made again but what was under way."""
    steps = ("rename", "delete", "make_folder", "_write_text", "write_table")
    originals = {name: getattr(publish, name) for name in steps}
    count = {"n": 0, "fail": None}

    def counted(name):
        def step(*args):
            count["n"] += 1
            if count["n"] == count["fail"]:
                raise Broken(name)
            return originals[name](*args)

        return step

    for name in steps:
        monkeypatch.setattr(publish, name, counted(name))

    def reports(version, made):
        def report(n):
            def make():
                made.append(n)
                return spark.range(1).select(F.lit(f"{version}-{n}").alias("v"))

            return make

        return {f"report{n}": report(n) for n in range(2)}

    def values(folder):
        found = {}
        for n in range(2):
            path = f"{folder}/report{n}"
            found[n] = spark.read.parquet(path).first()[0] if files.exists(spark, path) else None
        return found

    total = None
    for fail in range(1, 60):
        folder = str(tmp_path / str(fail))
        count["fail"] = None
        publish.publish(spark, folder, "old", reports("old", []))
        count.update(n=0, fail=fail)
        made = []
        write = counted("write_table")

        def start():
            ongoing = publish.Run(spark, folder, "new")
            for name, make in reports("new", made).items():
                ongoing.put(name, make, write)
            ongoing.end(["report0", "report1"])

        try:
            start()
            total = count["n"]
        except Broken:
            found = values(folder)
            assert all(v in (f"old-{n}", f"new-{n}", None) for n, v in found.items())
            ended = publish.manifest(spark, folder)
            assert ended is None or ended["run"] in ("old", "new")
            if ended and ended["run"] == "old":
                assert found == {0: "old-0", 1: "old-1"}
            start()
        assert values(folder) == {0: "new-0", 1: "new-1"}
        assert publish.manifest(spark, folder) == {"run": "new", "reports": ["report0", "report1"]}
        assert not files.exists(spark, f"{folder}/_run")
        assert len(made) <= 4
        if total is not None:
            break
    assert total is not None and total > 15


def test_another_run_starts_over(spark, place):
    _, path = place
    one = publish.Run(spark, f"{path}/out", "one")
    one.put("a", lambda: spark.range(3))
    two = publish.Run(spark, f"{path}/out", "two")
    assert not two.is_done("a")
    two.put("a", lambda: spark.range(5))
    two.put("a", lambda: pytest.fail("it is done"))
    two.end(["a"])
    assert spark.read.parquet(f"{path}/out/a").count() == 5
    with pytest.raises(ValueError, match="cannot name"):
        two.put("_a", lambda: spark.range(1))


def test_a_run_is_named_by_what_it_reads(spark, tmp_path):
    write_gz(tmp_path / "a.tsv.gz", [HEADER, line(1)])
    first = publish.run_name(spark, str(tmp_path), bad="drop")
    assert first == publish.run_name(spark, str(tmp_path), bad="drop") != publish.run_name(spark, str(tmp_path), bad="keep")
    write_gz(tmp_path / "b.tsv.gz", [HEADER, line(2)])
    assert first != publish.run_name(spark, str(tmp_path), bad="drop")


def test_whole_runs_again_and_after_a_failure(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    write_gz(tmp_path / "in" / "data_reviews_us_Toys_v1_00.tsv.gz", [HEADER, *[line(i, star=str(1 + i % 5)) for i in range(20)], "short"])
    out = str(tmp_path / "out")
    arguments = [str(tmp_path / "in"), out, "--tsv", "--category-from-file", "--bad", "store"]
    made = []
    count = ratings.vine_contrast

    def breaks(counted):
        made.append(1)
        if made.count(1) == 1:
            raise Broken
        return count(counted)

    monkeypatch.setattr(ratings, "vine_contrast", breaks)
    split = files.split_tsv
    monkeypatch.setattr(files, "split_tsv", lambda *a: (made.append("split"), split(*a))[1])
    with pytest.raises(Broken):
        run.main(arguments)
    assert publish.manifest(spark, out) is None
    run.main(arguments)
    assert made.count("split") == 1 and made.count(1) == 2
    told = publish.manifest(spark, out)
    assert "vine_contrast" in told["reports"] and "lines" in told["reports"]
    assert {r[0]: r[1] for r in spark.read.parquet(f"{out}/category_counts").collect()} == {"Toys": 20}
    assert [r["line"] for r in files.read_set_apart(spark, f"{out}/lines/bad_lines").collect()] == ["short"]
    run.main(arguments)
    assert made.count("split") == 2 and json.loads((tmp_path / "out" / "_MANIFEST").read_text()) == told
    with pytest.raises(Exception, match="unreadable line"):
        run.main([*arguments[:3], "--bad", "fail"])
    run.main([*arguments[:3], "--bad", "drop"])
    assert spark.read.parquet(f"{out}/total_count").first()[0] == 20


def test_stored_intermediates_anywhere(spark, place, monkeypatch):
    _, path = place
    monkeypatch.setattr(files, "shared_folder", lambda spark: path)
    stored, where = files.keep(spark.range(4), "numbers")
    table = files.store_bucketed(spark.range(9).withColumn("word", F.col("id").cast("string")), "words", "word", 3)
    assert stored.count() == 4 and table.count() == 9
    files.release(spark, [where])
    assert not files.exists(spark, where)
    files.release(spark)
    assert files.files_under(spark, path) == []


def test_functions_in_sql(spark):
    sql.register(spark)
    texts = ["Don't<br />stop, NOW!  10", " a b\x1cc ", "", None, "it's <br /> f*** 'x' \\ é"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    table.createOrReplaceTempView("some_texts")
    cleaned = spark.sql("SELECT t, review_text(t) AS c, review_words(t) AS w FROM some_texts").collect()
    for row in cleaned:
        expected = table.where(F.col("t").eqNullSafe(row["t"])).select(
            text.clean_text(F.col("t")).alias("c"), F.array_remove(text.words(F.col("t")), "").alias("w")
        )
        assert tuple(expected.first()) == (row["c"], row["w"])
    words = ["good", "a", "f***", "f*", "f*x", "10", "-x", "", "{", "zeta", "9a", ":b", "é"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    frame.createOrReplaceTempView("some_words")
    given = frame.select("w", text.is_telling(F.col("w")), text.is_number(F.col("w")), text.is_censored(F.col("w")))
    asked = spark.sql("SELECT w, is_telling_word(w), is_number_word(w), is_censored_word(w) FROM some_words")
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, asked.collect()))
    name = "data_reviews_us_Home_Improvement_v1_00.tsv.gz"
    found = spark.sql("SELECT category_of_file(:n, 'us'), category_of_file(:n, 'de'), category_spelling('A_&_B ')", args={"n": name}).first()
    assert tuple(found) == ("Home Improvement", None, "A B")


def test_functions_in_sql_are_no_calls(spark):
    sql.register(spark)
    spark.createDataFrame([("x y",)], "t string").createOrReplaceTempView("some_texts")
    plan = plan_of(spark.sql("SELECT review_text(t) AS c FROM some_texts"))
    assert "regexp_replace" in plan and "review_text" not in plan


def test_workers_are_given_the_package(spark):
    session.ship_package(spark)
    session.ship_package(spark)
    shipped = [p for p in spark.sparkContext.listArchives + list(spark.sparkContext._python_includes) if p.startswith("reviewlens")]
    assert shipped == ["reviewlens.zip"]

import gzip
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import ratings
from reviewlens.plans import run
from reviewlens.schema import REVIEW_SCHEMA, conform
from reviewlens.sources import files

HEADER = "\t".join(REVIEW_SCHEMA.names)


def line(i, category="PC", star="5", headline="Five Stars", body="good", marketplace="US", verified="Y"):
    return "\t".join(
        [marketplace, f"c{i}", f"r{i}", f"p{i}", f"{i}", "A title", category, star, "1", "2", "N", verified]
        + [headline, body, "2015-08-31"]
    )


def write_gz(path, lines):
    path.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    return str(path)


def test_tsv_types_and_header(spark, tmp_path):
    path = write_gz(tmp_path / "a.tsv.gz", [HEADER, line(1), line(2, star="")])
    rows = files.read_tsv(spark, path).orderBy("review_id").collect()
    assert rows[0].asDict() == {
        "marketplace": "US",
        "customer_id": "c1",
        "review_id": "r1",
        "product_id": "p1",
        "product_parent": "1",
        "product_title": "A title",
        "product_category": "PC",
        "star_rating": 5,
        "helpful_votes": 1,
        "total_votes": 2,
        "vine": "N",
        "verified_purchase": "Y",
        "review_headline": "Five Stars",
        "review_body": "good",
        "review_date": date(2015, 8, 31),
    }
    assert rows[1]["star_rating"] is None


def test_tsv_without_and_with_repeated_headers(spark, tmp_path):
    write_gz(tmp_path / "a.tsv.gz", [line(1)])
    write_gz(tmp_path / "b.tsv.gz", [HEADER, line(2), HEADER, line(3)])
    rows = files.read_tsv(spark, str(tmp_path / "*.tsv.gz"))
    assert {r["review_id"] for r in rows.collect()} == {"r1", "r2", "r3"}
    assert rows.count() == 3


def test_tsv_quotes_and_backslashes_are_text(spark, tmp_path):
    odd = ['"open', 'say "hi"', "back\\slash\\", '\\"both"', "'single'", "# hash", " padded ", '""']
    lines = [line(i, headline=h, body=h + " end") for i, h in enumerate(odd)]
    path = write_gz(tmp_path / "a.tsv.gz", [HEADER, *lines])
    rows = files.read_tsv(spark, path).collect()
    found = {r["review_id"]: (r["review_headline"], r["review_body"], r["review_date"]) for r in rows}
    assert found == {f"r{i}": (h, h + " end", date(2015, 8, 31)) for i, h in enumerate(odd)}


def test_tsv_category_from_file(spark, tmp_path):
    write_gz(tmp_path / "data_reviews_us_Home_Improvement_v1_00.tsv.gz", [HEADER, line(1), line(2)])
    write_gz(tmp_path / "data_reviews_us_Home_Improvement_v1_01.tsv.gz", [HEADER, line(3)])
    write_gz(tmp_path / "data_reviews_us_PC_v1_00.tsv.gz", [HEADER, line(4, category="other")])
    write_gz(tmp_path / "data_reviews_de_PC_v1_00.tsv.gz", [HEADER, line(5)])
    rows = files.read_tsv(spark, str(tmp_path), category_from_file=True)
    counts = {r["product_category"]: r["n_reviews"] for r in ratings.category_counts(rows).collect()}
    assert counts == {"Home Improvement": 3, "PC": 1}


def test_tsv_bad_lines(spark, tmp_path):
    short, long, word = "US\tc2\tr2", line(3) + "\textra", line(4, star="five")
    path = write_gz(tmp_path / "a.tsv.gz", [HEADER, line(1), short, long, word, line(5, star=""), HEADER])
    with pytest.raises(Exception, match="unreadable line"):
        files.read_tsv(spark, path).count()
    with pytest.raises(Exception, match="unreadable line"):
        files.read_tsv(spark, path).select("review_body").collect()
    dropped = files.read_tsv(spark, path, bad="drop")
    assert dropped.columns == REVIEW_SCHEMA.names
    assert {r["review_id"] for r in dropped.collect()} == {"r1", "r5"} and dropped.count() == 2
    kept = {r["review_id"]: r["star_rating"] for r in files.read_tsv(spark, path, bad="keep").collect()}
    assert kept == {"r1": 5, "r2": None, "r3": 5, "r4": None, "r5": None}
    found = files.bad_lines(spark, path)
    assert {tuple(r) for r in found.collect()} == {("a.tsv.gz", bad) for bad in (short, long, word)}
    assert found.count() == 3
    with pytest.raises(ValueError, match="skip"):
        files.read_tsv(spark, path, bad="skip")


def test_an_empty_category_is_not_taken_for_a_null_one(spark, reviews, tmp_path):
    rows = [("r1", "A"), ("r2", None)]
    columns = "review_id string, product_category string"
    files.write_parquet(reviews(rows, columns), str(tmp_path / "ok"))
    back = files.read_parquet(spark, str(tmp_path / "ok"))
    assert {(r["review_id"], r["product_category"]) for r in back.collect()} == set(rows)
    with pytest.raises(Exception, match="empty product_category"):
        files.write_parquet(reviews([*rows, ("r3", "")], columns), str(tmp_path / "refused"))


def test_tsv_written_and_read(spark, reviews, tmp_path):
    odd = ['un"balanced', "back\\slash\\", '"both"', "'q'", "# hash", " padded ", '\\"', ",", "é ", None]
    odd += ["a\x00b", "\x00a\x00", "\x00"]
    rows = [(str(i), "A" if i % 2 else None, i % 6 or None, v, v) for i, v in enumerate(odd)]
    rows.append(("99", "A", 3, "two\tparts\nand\r\nmore", "x"))
    columns = ["review_id", "product_category", "star_rating", "review_headline", "review_body"]
    table = reviews(rows, ", ".join(f"{c} {REVIEW_SCHEMA[c].dataType.simpleString()}" for c in columns))
    files.write_tsv(table, str(tmp_path / "out"))
    found = files.read_tsv(spark, str(tmp_path / "out"))
    rows[-1] = ("99", "A", 3, "two parts and more", "x")
    assert sorted(tuple(r) for r in found.select("review_id").collect()) == sorted((r[0],) for r in rows)
    got = {r["review_id"]: tuple(r) for r in found.select(columns).collect()}
    assert got == {r[0]: r for r in rows}
    for path in (tmp_path / "out").glob("*.gz"):
        assert gzip.decompress(path.read_bytes()).decode().startswith(HEADER)


@pytest.fixture
def many(reviews):
    rows = [
        ("US" if i % 4 else "DE", f"r{i}", "Hot & new" if i % 3 == 0 else f"00{i % 5}", 1 + i % 5) for i in range(3000)
    ]
    return reviews(rows, "marketplace string, review_id string, product_category string, star_rating int")


def test_parquet_by_category(spark, many, tmp_path):
    path = str(tmp_path / "reviews")
    files.write_parquet(many, path)
    back = files.read_parquet(spark, path)
    assert back.schema.names == REVIEW_SCHEMA.names and [f.dataType for f in back.schema] == [
        f.dataType for f in REVIEW_SCHEMA
    ]
    assert back.exceptAll(many).count() == many.exceptAll(back).count() == 0
    assert len(back.inputFiles()) == many.select("product_category").distinct().count()


def test_number_like_categories_keep_their_spelling(spark, many, tmp_path):
    path = str(tmp_path / "reviews")
    files.write_parquet(many.where(F.col("product_category").startswith("00")), path)
    found = ratings.distinct_categories(files.read_parquet(spark, path)).collect()
    assert {r["product_category"] for r in found} == {"000", "001", "002", "003", "004"}


def test_a_table_without_the_columns_is_refused(spark):
    with pytest.raises(ValueError, match="star_rating"):
        conform(spark.range(3))


def test_union_keeps_duplicates_and_matches_names(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "n int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, n int")
    assert sorted(map(tuple, files.union_parts([a, b, a]).collect())) == [(1, "x")] * 5


def test_spread_fills_idle_cores_only(spark):
    few, enough = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 16)
    assert files.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert files.spread(enough) is enough
    assert files.spread(few).count() == 100


def test_store_writes_to_the_shared_folder(spark):
    folder = files.shared_folder(spark).removeprefix("file:")
    set_folder = spark.conf.get("spark.checkpoint.dir", None)
    assert set_folder is None or folder.startswith(set_folder.removeprefix("file:"))
    stored = files.store(spark.range(10).toDF("n"), "numbers")
    assert stored.count() == 10 and all(folder in p for p in stored.inputFiles())


def session_like(master, folder=None, settings=()):
    context = SimpleNamespace(getCheckpointDir=lambda: folder, master=master, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=dict(settings).get))


def test_shared_folder_without_a_setting():
    assert files.shared_folder(session_like("spark://host", "hdfs:/shared/1")) == "hdfs:/shared/1"
    named = session_like("spark://host", settings=[("spark.checkpoint.dir", "hdfs:/shared")])
    assert files.shared_folder(named) == "hdfs:/shared"
    for master in ("spark://host", "local[2]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            files.shared_folder(session_like(master))


def test_whole_run(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_gz(source / "a.tsv.gz", [HEADER, *[line(i, star=str(1 + i % 5), body="good bag") for i in range(50)]])
    write_gz(source / "b.tsv.gz", [HEADER, *[line(i, "Toys", "1", "Broke", "The bad toy") for i in range(50, 80)]])
    write_gz(source / "c.tsv.gz", [HEADER, line(99, "Toys", marketplace="DE")])
    stop = tmp_path / "stop.txt"
    stop.write_text("the\n")
    out = str(tmp_path / "out")
    files.release(spark)
    run.main([str(source), out, "--tsv", "--marketplace", "US", "--stop-words", str(stop)])
    assert not list(Path(files.shared_folder(spark).removeprefix("file:")).glob("*"))

    def report(name):
        return spark.read.parquet(f"{out}/{name}")

    assert {tuple(r) for r in report("category_counts").collect()} == {("Toys", 30), ("PC", 50)}
    assert report("total_count").first()[0] == 80
    assert report("top_helpful").count() == 20
    words = {(r["product_category"], r["word"]) for r in report("top_words").collect()}
    assert words == {
        *[(c, w) for c in ("PC", "Overall") for w in ("good", "bag")],
        *[(c, w) for c in ("Toys", "Overall") for w in ("bad", "toy")],
    }
    assert report("word_total").first()[0] == 50 * 2 + 30 * 3
    assert {r["word"] for r in report("top_headline_words").collect()} == {"broke"}
    predicted = {r["review_id"]: r["predicted_rating"] for r in report("predicted_ratings").collect()}
    assert len(predicted) == 80 and predicted["r1"] == 3.0 and predicted["r60"] == 1.0

"""Frames that show a stored row several times, or not always, and columns with clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import exact, lines, mixing, places, quality, repeats, simhash
from reviewlens.sources import files
from tests.test_plans import nodes_of

CLASHING = {"__at": 1, "__row": 2, "__copy": 3, "__copies": 4, "__score": 5, "__text": 6, "__print": 7, "__body": 8, "at": 9, "file": 10}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("places") / "docs")
    texts = ["one two three four five six " * 9, "seven eight nine ten eleven " * 10, "red green blue yellow pink " * 11]
    rows = [(i, texts[i % 3], "ab"[i % 2]) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def frames(stored):
    some = stored.where("doc_id < 5")
    return {
        "read": stored,
        "filtered": some.select("source", "doc_id", "text"),
        "exploded": some.select("doc_id", F.explode(F.array("text", "source", F.concat("text", "source"))).alias("text"), "source"),
        "joined": some.join(stored.select(F.col("doc_id").alias("other"), "source"), "source").drop("other"),
        "unioned": stored.union(some),
        "sampled": stored.sample(0.6, seed=3),
        "random": stored.where(F.rand(3) < 0.6),
        "aggregated": stored.groupBy("doc_id", "source").agg(F.max("text").alias("text")),
        "read twice": stored.sparkSession.read.parquet(*[stored.inputFiles()[0]] * 2),
    }


def n_components(texts):
    prints = list({simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts})
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[m] for m, q in enumerate(prints) if (p ^ q).bit_count() <= simhash.RADIUS) for p in prints]
    return len(set(label))


NAMES = ["read", "filtered", "exploded", "joined", "unioned", "sampled", "random", "aggregated", "read twice"]


@pytest.mark.parametrize("name", NAMES)
def test_one_place_for_each_row(stored, name):
    df = frames(stored)[name]
    n = df.count()
    placed = places.located(df)
    assert placed.count() == placed.select("__at").distinct().count() == n
    rows = [tuple(r) for r in placed.select("__row.*").collect()]
    assert len(rows) == n


@pytest.mark.parametrize("name, limit", [*[(name, 64 << 20) for name in ("read", "joined", "unioned", "sampled")], ("exploded", -1)])
def test_operators_take_every_row_once(stored, name, limit, monkeypatch):
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", limit)
    df = places.store(frames(stored)[name], "held") if name in ("sampled", "random") else frames(stored)[name]
    rows = df.select("doc_id", "text", "source").collect()
    texts = Counter(r["text"] for r in rows)
    found = exact.exact_duplicates(df).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(texts)
    assert Counter(r["text"] for r in exact.drop_exact_duplicates(df).collect()) == Counter(texts.keys())
    near = simhash.drop_near_duplicates(df).collect()
    assert {r["text"] for r in near} <= texts.keys() and len(near) == n_components(texts)
    taken = mixing.copies(df).collect()
    assert len(taken) == len(rows)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == sum(r["copies"] for r in taken)
    cleaned = repeats.remove_repeats(df).collect()
    assert Counter(bytes(r["text"]).decode() for r in cleaned) == texts
    marked = lines.drop_repeated_lines(df, least_documents=2).collect()
    assert len(marked) == len(rows) and {bytes(r["kept"]).decode() for r in marked if r["kept"]} == {t for t in texts}


def test_clashing_columns_keep_their_values(spark, stored):
    docs = stored.withColumns({name: F.lit(value) for name, value in CLASHING.items()})
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    for df in (docs, places.store(docs, "held")):
        given = {tuple(r) for r in df.collect()}
        for result in (
            exact.drop_exact_duplicates(df),
            simhash.drop_near_duplicates(df),
            mixing.mix(df),
            quality.keep_good(df, model, least=0.0),
        ):
            assert result.columns == df.columns
            rows = [tuple(r) for r in result.collect()]
            assert rows and set(rows) <= given
        assert len(quality.keep_good(df, model, least=0.0).collect()) == len(given)


@pytest.mark.parametrize("limit", [1 << 20, 900, 250, -1])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_lists_of_any_size_go_to_the_documents(spark, tmp_path, monkeypatch, limit, how):
    """Files are read once each, and the documents stay where they are."""
    path = str(tmp_path / "a folder, 100% of it")
    spark.range(0, 400, 1, 9).select("id", F.concat(F.lit("text "), "id").alias("text")).write.parquet(path)
    docs = places.located(spark.read.parquet(path)).select("__at", "__row.id", "__row.text")
    listed = places.store(docs.where("id % 7 = 0").select("__at", F.col("id").alias("number")), "listed")
    expected = docs.join(listed, "__at", how).drop("__at").collect()
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", limit)
    joined = places.beside(docs, listed, ["__at"], "__at.file", how)
    assert sorted(map(str, joined.drop("__at").collect())) == sorted(map(str, expected))
    scans = [n for n in nodes_of(joined._jdf.queryExecution().executedPlan()) if "FileSourceScan" in n.getClass().getSimpleName()]
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and scans


def test_files_are_read_once_beside_a_large_list(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.range(0, 90, 1, 9).select("id", F.lit("text").alias("text")).write.parquet(path)
    docs = places.located(spark.read.parquet(path)).select("__at", "__row.text")
    listed = places.store(docs.select("__at"), "listed")
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", 2100)  # 100 bytes a row: two files at a time
    joined = places.beside(docs, listed, ["__at"], "__at.file")
    assert joined.count() == 90
    joined.collect()
    read = [
        n.metrics().apply("numFiles").value()
        for n in nodes_of(joined._jdf.queryExecution().executedPlan())
        if n.getClass().getSimpleName() == "FileSourceScanExec" and "text" in n.toString().split("ReadSchema")[-1]
    ]
    assert sum(read) == 9 and max(read) <= 2


def test_texts_are_not_shuffled_for_large_lists(stored, monkeypatch):
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", -1)
    for result in (exact.drop_exact_duplicates(stored), simhash.drop_near_duplicates(stored), mixing.mix(stored)):
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_streams_and_inputs_through_a_mount(spark, tmp_path, stored, monkeypatch):
    """Input and intermediates by a path that only Hadoop knows, the input's with a blank. (Spark's reader of
    streaming state takes no blanks.)"""
    (tmp_path / "a b").mkdir()
    (tmp_path / "shared").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.corpus.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(files, "shared_folder", lambda spark: "viewfs://corpus/in/shared")
    stored.write.parquet("viewfs://corpus/in/a b/docs")
    docs = spark.read.parquet("viewfs://corpus/in/a b/docs")
    assert sum(r["kept"] for r in exact.exact_duplicates(docs).collect()) == 3
    assert exact.drop_exact_duplicates(docs).count() == simhash.drop_near_duplicates(docs).count() == 3
    assert len(repeats.remove_repeats(docs).collect()) == len(lines.drop_repeated_lines(docs).collect()) == 9
    files.release(spark, [path for path in files.intermediates() if path.startswith("viewfs://corpus")])
    assert files.files_under(spark, "viewfs://corpus/in/shared") == []

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelweave.config import InvalidInput, NotFound
from labelweave.functions import names
from labelweave.sources import documents as docs
from labelweave.sources import intake
from labelweave.sources import labels as label_ops
from labelweave.sources.batches import BatchTable
from labelweave.sources.commits import Conflict
from labelweave.streaming.arrivals import manifest_stream, score_stream

ACCOUNT, REGION = "123456789012", "eu-west-1"
CONFIG = intake.IntakeConfig(ACCOUNT, REGION)


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_file_names(spark):
    given = ["/tmp/report.pdf", r"C:\fakepath\report.pdf", "..", "", "a/", " . ", "  x.txt\t"]
    expected = ["report.pdf", "report.pdf", None, None, None, None, "x.txt"]
    assert apply(spark, given, names.safe_file_name) == expected


def test_object_keys(spark):
    keys = apply(spark, ["report.pdf"] * 2, names.object_key)
    assert keys[0] != keys[1] and all(k.endswith("/report.pdf") for k in keys)
    fixed = apply(spark, ["a", "a", "b"], lambda v: names.object_key(v, v))
    assert fixed[0] == fixed[1] != fixed[2]


def test_collection_choice_and_names(spark):
    chosen = apply(spark, ["invoices", None], lambda v: names.chosen_collection(v, "configured"))
    assert chosen == ["invoices", "configured"]
    assert apply(spark, [None], names.chosen_collection) == ["default"]
    full = apply(spark, ["default", " docs "], lambda v: names.collection_name(v, ACCOUNT, REGION))
    assert full == [f"default-{ACCOUNT}-{REGION}-an", f"docs-{ACCOUNT}-{REGION}-an"]
    bad = ["", "UPPERCASE", "-leading", "trailing-", "has.period", "a\nb", "xn--a", "sthree-x",
           "amzn-s3-demo-x", "a" * 38]
    good = ["a", "customer-docs", "9-9", "a" * 37]
    errors = apply(spark, bad + good, lambda v: names.collection_error(v, ACCOUNT, REGION))
    assert all(errors[: len(bad)]) and not any(errors[len(bad):])
    for account in (None, " ", "123", "12345678901a"):
        with pytest.raises(InvalidInput):
            names.check_account(account)
    for region in (None, "", "EU", "-eu"):
        with pytest.raises(InvalidInput):
            names.check_region(region)


def test_metadata(spark):
    given = [
        '{"source":"frontend","bucket_name":"untrusted"}', None, "{}", "[]", "nonsense",
        '{"a":1}', '{"a":null}', '{"a":{"b":"c"}}', '"text"', '{"a":"1","a":"2"}', '{"a":"1"} x', "",
        '{"a":"1"}, {"b":"2"}', '{"a":"1"}} x {', '{"a":"1"}] x [', '{"a":"1"}, "w":"2"',
    ]
    parsed = apply(spark, given, names.parse_metadata)
    assert parsed[0] == {"source": "frontend", "bucket_name": "untrusted"}
    assert parsed[1] == {} and parsed[2] == {}
    assert parsed[3:9] == [None] * 6
    assert parsed[9] == {"a": "2"} and parsed[11] is None
    assert parsed[10] is None and parsed[12:] == [None] * 4
    kept = apply(
        spark, given[:2], lambda v: names.with_collection(names.parse_metadata(v), F.lit("c"))
    )
    assert kept == [{"source": "frontend", "bucket_name": "c"}, {"bucket_name": "c"}]


def uploads(spark, rows):
    return spark.createDataFrame(
        rows,
        "file_name string, content_type string, requested_prefix string, metadata_json string, "
        "length long",
    )


def test_intake_rules(spark, staging):
    rows = uploads(spark, [
        ("/a/one.txt", "text/plain", "invoices", '{"k":"v"}', 3),
        ("two.bin", None, None, None, 25 * 1024 * 1024),
        ("big.bin", None, None, None, 25 * 1024 * 1024 + 1),
        ("  ", None, None, None, 1),
        (None, None, None, None, 1),
        ("..", None, None, None, 1),
        ("x", None, "Bad", None, 1),
        ("x", None, "", None, 1),
        ("x", None, None, '{"k":2}', 1),
        ("x", None, None, None, None),
    ])
    checked = intake.check_uploads(rows, CONFIG)
    good = {r["object_key"].split("/")[1]: r for r in intake.manifest(checked, CONFIG).collect()}
    assert set(good) == {"one.txt", "two.bin"}
    assert good["one.txt"]["collection"] == f"invoices-{ACCOUNT}-{REGION}-an"
    assert good["one.txt"]["metadata"] == {"k": "v", "bucket_name": good["one.txt"]["collection"]}
    assert good["two.bin"]["content_type"] == "application/octet-stream"
    assert good["two.bin"]["collection"].startswith("default-")
    errors = sorted(r["error"] for r in intake.rejects(checked).collect())
    assert errors == sorted([
        "file is too large", "file name is required", "file name is required",
        "file name is invalid", "invalid collection prefix", "invalid collection prefix",
        "metadata has to be one JSON object whose values are text", "file is required",
    ])


def test_files_are_taken_in_with_their_bytes(spark, staging, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"alpha")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"beta")
    files = intake.read_files(spark, str(tmp_path / "in"))
    rows = intake.manifest(intake.check_uploads(files, CONFIG), CONFIG, [F.col("path")])
    intake.store(rows, f"{staging.path}/stored")
    stored = spark.read.parquet(f"{staging.path}/stored").collect()
    assert {r["object_key"].split("/")[1]: bytes(r["content"]) for r in stored} == {
        "a.txt": b"alpha", "b.txt": b"beta"
    }


LINES = [
    {"name": "a", "pages": ["one", "two"], "label_id": "AB" * 12},
    {"name": "a", "pages": ["one", "two"], "label_id": "AB" * 12},
    {"name": "b", "pages": [], "label_id": "cd" * 12},
]


def write_lines(tmp_path, rows):
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))
    return str(path)


def test_training_documents_from_json(spark, tmp_path):
    path = write_lines(tmp_path, LINES)
    rows = docs.read_training_documents(spark, path, object_ids=True).collect()
    assert len(rows) == 3 and len({r["doc_id"] for r in rows}) == 3
    assert sorted(r["label_id"] for r in rows) == ["ab" * 12] * 2 + ["cd" * 12]
    again = docs.read_training_documents(spark, path, object_ids=True).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in again}


@pytest.mark.parametrize(
    "bad",
    [
        {"name": "a", "pages": [], "label_id": "ab" * 12, "extra": 1},
        {"name": "a", "pages": []},
        {"name": None, "pages": [], "label_id": "ab" * 12},
        {"name": "a", "pages": [None], "label_id": "ab" * 12},
        {"name": "a", "pages": [], "label_id": "xyz"},
        {"name": "a", "pages": "text", "label_id": "ab" * 12},
        "{broken",
        json.dumps(LINES[2]) + " x",
    ],
)
def test_bad_training_documents(spark, tmp_path, bad):
    with pytest.raises((InvalidInput, PySparkException)):
        docs.read_training_documents(
            spark, write_lines(tmp_path, [*LINES, bad]), object_ids=True
        ).collect()


def test_parquet_documents_need_the_same_fields(spark, staging):
    rows = spark.createDataFrame([("a", ["x"], "l")], docs.TRAINING_DOCUMENT)
    rows.write.parquet(f"{staging.path}/good")
    rows.withColumn("extra", F.lit(1)).write.parquet(f"{staging.path}/bad")
    assert docs.read_training_documents(spark, f"{staging.path}/good", "parquet").count() == 1
    with pytest.raises(InvalidInput):
        docs.read_training_documents(spark, f"{staging.path}/bad", "parquet")


def test_many_copies_of_one_row_get_ids_of_their_own(spark):
    rows = spark.createDataFrame([("hot",)] * 50 + [("x",), ("y",)], "name string")
    ids = docs.with_document_ids(rows, block=7).collect()
    assert len({r["doc_id"] for r in ids}) == 52
    assert sum(r["name"] == "hot" for r in ids) == 50


def test_documents_from_pages(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(1, 1, "b"), (1, 0, "a"), (2, 0, None)], "id long, turn long, text string"
    )
    got = {r["doc_id"]: r["pages"] for r in
           docs.documents_from_pages(rows, "id", "turn", "text").collect()}
    assert got == {1: ["a", "b"], 2: [""]}
    monkeypatch.setattr(docs, "MAX_PAGES", 1)
    with pytest.raises(InvalidInput):
        docs.documents_from_pages(rows, "id", "turn", "text")


def test_labels(spark, staging):
    path = f"{staging.path}/labels"
    given = spark.createDataFrame([(" one ",), ("　two\n",), ("one",)], "name string")
    table = label_ops.LabelTable(spark, path)
    created = table.create(given)
    labels = table.read()
    assert sorted(created.collect()) == sorted(labels.collect())
    rows = labels.collect()
    assert sorted(r["name"] for r in rows) == ["one", "one", "two"]
    assert len({r["label_id"] for r in rows}) == 3
    assert label_ops.malformed_ids(labels).count() == 0
    for blank in ("", " \t　", None):
        with pytest.raises(InvalidInput):
            label_ops.create_labels(spark.createDataFrame([(blank,)], "name string"))
    ids = labels.filter("name = 'two'").select("label_id")
    removed, kept = label_ops.delete_labels(labels, ids)
    assert [r["name"] for r in removed.collect()] == ["two"]
    assert [r["name"] for r in kept.collect()] == ["one", "one"]
    with pytest.raises(NotFound):
        label_ops.delete_labels(kept, ids)
    # The table itself: a change is a new version, a failed one leaves the table as it was.
    assert [r["name"] for r in table.delete(ids).collect()] == ["two"]
    assert [r["name"] for r in table.read().collect()] == ["one", "one"]
    with pytest.raises(NotFound):
        table.delete(ids)
    more = table.create(spark.createDataFrame([("three",)], "name string")).collect()
    again = label_ops.LabelTable(spark, path).read()
    assert again.count() == 3 and more[0] in again.collect()
    upper = spark.createDataFrame([("AB" * 12,)], "label_id string")
    assert label_ops.check_object_ids(upper).first()["label_id"] == "ab" * 12
    for bad in ("ab" * 11, "zz" * 12, "ab" * 12 + "\n", None):
        with pytest.raises(InvalidInput):
            label_ops.check_object_ids(spark.createDataFrame([(bad,)], "label_id string"))


def names_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_a_change_of_labels_writes_its_own_rows_only(spark, staging):
    table = label_ops.LabelTable(spark, f"{staging.path}/labels")
    table.create(names_of(spark, "one", "two", "three"))
    table.create(names_of(spark, "four"))
    added = spark.read.parquet(f"{table.path}/added")
    assert sorted(r["count"] for r in added.groupBy("version").count().collect()) == [1, 3]
    table.delete(table.read().filter("name = 'two'").select("label_id"))
    assert spark.read.parquet(f"{table.path}/removed").count() == 1
    assert sorted(r["name"] for r in table.read().collect()) == ["four", "one", "three"]


def test_labels_are_compacted_and_old_readers_go_on(spark, staging, monkeypatch):
    monkeypatch.setattr(label_ops, "COMPACT_AFTER", 3)
    table = label_ops.LabelTable(spark, f"{staging.path}/labels")
    table.create(names_of(spark, "a", "b"))
    early = table.read()
    table.delete(table.read().filter("name = 'a'").select("label_id"))
    assert not table._since_whole()[label_ops.WHOLE]
    table.create(names_of(spark, "c"))
    assert table._since_whole() == {"whole": ["000000004"], "added": [], "removed": []}
    table.create(names_of(spark, "d"))
    assert sorted(r["name"] for r in table.read().collect()) == ["b", "c", "d"]
    assert sorted(r["name"] for r in early.collect()) == ["a", "b"]
    # A whole table may bring an id back that was removed before.
    removed = table.delete(table.read().filter("name = 'd'").select("label_id"))
    back = removed.unionByName(table.read())
    table.replace(back)
    assert sorted(r["name"] for r in table.read().collect()) == ["b", "c", "d"]


def test_of_two_writers_of_labels_one_fails(spark, staging, monkeypatch):
    path = f"{staging.path}/labels"
    mine, other = label_ops.LabelTable(spark, path), label_ops.LabelTable(spark, path)
    mine.create(names_of(spark, "first"))
    usual = label_ops.create_labels

    def meeting(names):
        monkeypatch.setattr(label_ops, "create_labels", usual)
        with pytest.raises(Conflict, match="version 000000002"):
            other.create(names_of(spark, "late"))
        assert [r["name"] for r in other.read().collect()] == ["first"]
        return usual(names)

    monkeypatch.setattr(label_ops, "create_labels", meeting)
    mine.create(names_of(spark, "second"))
    other.create(names_of(spark, "third"))
    assert sorted(r["name"] for r in mine.read().collect()) == ["first", "second", "third"]


def test_a_failed_change_and_a_dead_writer_leave_the_labels_whole(spark, staging, monkeypatch):
    table = label_ops.LabelTable(spark, f"{staging.path}/labels")
    table.create(names_of(spark, "first"))
    with pytest.raises(InvalidInput):
        table.create(names_of(spark, " "))
    # A writer that claims a version and its rows and dies before it commits.
    assert table.log.claim("000000002")
    label_ops.create_labels(names_of(spark, "lost")).write.parquet(table._folder("added", "000000002"))
    with pytest.raises(Conflict):
        table.create(names_of(spark, "blocked"))
    assert table.give_up() == ["000000002"]
    table.create(names_of(spark, "second"))
    assert sorted(r["name"] for r in table.read().collect()) == ["first", "second"]
    # It was not dead after all, and cannot commit any more.
    with pytest.raises(Conflict, match="given up"):
        table.log.commit("000000002", "added")
    # A writer that last looked before a version was committed does not get that version.
    assert not table.log.claim("000000002") and table.log.claimed() == []


def test_a_batch_is_stored_once(spark, staging):
    table = BatchTable(spark, f"{staging.path}/batches", ("kind",))
    assert table.read() is None
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string")
    assert table.append(rows, "a-0") and not table.append(rows, "a-0")
    assert table.append(rows.filter("id = 1"), "a-1")
    assert sorted(map(tuple, table.read().select("id", "kind").collect())) == [(1, "x"), (1, "x"), (2, "y")]
    assert table.batches() == ["a-0", "a-1"]
    for bad in ("", "a~b", "a/b"):
        with pytest.raises(InvalidInput):
            table.append(rows, bad)


def test_a_batch_that_died_half_way_is_run_again(spark, staging):
    table = BatchTable(spark, f"{staging.path}/batches")
    rows = spark.range(10)
    broken = rows.selectExpr("CASE WHEN id = 9 THEN raise_error('lost') ELSE id END AS id")
    with pytest.raises(PySparkException):
        table.append(broken, "b")
    assert table.read() is None
    assert table.append(rows, "b") and table.read().count() == 10
    # Rows that were written, but whose writer died before it could commit them.
    assert table.log.claim("c")
    rows.write.parquet(table._folder("dead"))
    assert table.append(rows, "c") and table.read().count() == 20


def test_two_attempts_of_a_batch_at_once(spark, staging, monkeypatch):
    first = BatchTable(spark, f"{staging.path}/batches")
    second = BatchTable(spark, first.path)
    usual, met = first.log.commit, []

    def late(key, written):
        met.append(second.append(spark.range(3), key))
        usual(key, written)

    monkeypatch.setattr(first.log, "commit", late)
    assert not first.append(spark.range(3), "b") and met == [True]
    assert second.read().count() == 3


def test_a_stream_stores_its_batches_once(spark, staging):
    source = f"{staging.path}/source"
    spark.range(6).write.parquet(source)
    table = BatchTable(spark, f"{staging.path}/batches")
    for progress in ("one", "two"):
        # The second run has lost its progress and brings the same batch again.
        stream = spark.readStream.schema("id long").parquet(source)
        query = (
            table.append_stream(stream, "s")
            .option("checkpointLocation", f"{staging.path}/progress_{progress}")
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(120)
    assert table.read().count() == 6 and table.batches() == ["s-000000000000"]


def test_arriving_uploads(spark, staging):
    source = f"{staging.path}/arrivals"
    rows = uploads(spark, [("a.txt", None, None, None, 1), ("..", None, None, None, 1)])
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    good, bad = manifest_stream(stream, CONFIG, [F.col("file_name")])
    for name, frame in (("good", good), ("bad", bad)):
        writer = frame.writeStream.format("parquet").option("path", f"{staging.path}/{name}")
        query = (
            writer.option("checkpointLocation", f"{staging.path}/{name}_progress")
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(120)
    assert spark.read.parquet(f"{staging.path}/good").first()["object_key"].endswith("/a.txt")
    assert spark.read.parquet(f"{staging.path}/bad").first()["error"] == "file name is invalid"


def test_arriving_documents_are_scored(spark, staging, fruit):
    from labelweave.config import SplitSettings, TrainingConfig
    from labelweave.plans.training import train
    from labelweave.sources.models import ModelStore

    store = ModelStore(spark, f"{staging.path}/store")
    outcome = train(fruit, TrainingConfig(split=SplitSettings(repetitions=1), seed=1))
    saved = store.find(store.save(outcome))
    fresh = fruit.select("doc_id", "pages")
    fresh.write.parquet(f"{staging.path}/fresh")
    stream = spark.readStream.schema(fresh.schema).parquet(f"{staging.path}/fresh")

    def sink(found, number):
        found.write.mode("overwrite").parquet(f"{staging.path}/scores/batch={number}")

    query = (
        score_stream(stream, saved, sink)
        .option("checkpointLocation", f"{staging.path}/score_progress")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    found = spark.read.parquet(f"{staging.path}/scores")
    truth = {r["doc_id"]: r["label_id"] for r in fruit.collect()}
    assert {r["doc_id"]: r["predicted"] for r in found.collect()} == truth


def test_a_stream_follows_the_published_model(spark, staging, fruit, make_documents):
    from labelweave.config import SplitSettings, TrainingConfig
    from labelweave.plans.training import train
    from labelweave.sources.models import ModelStore
    from labelweave.streaming.arrivals import score_published

    store = ModelStore(spark, f"{staging.path}/store")
    config = TrainingConfig(split=SplitSettings(repetitions=1), seed=1)
    swapped = fruit.withColumn(
        "label_id", F.expr("CASE WHEN label_id = '" + "03" * 12 + "' THEN 'late' ELSE 'early' END")
    )
    first, second = (store.save(train(d, config)) for d in (fruit, swapped))
    with pytest.raises(NotFound):
        store.publish("unknown")
    assert store.published() is None
    fresh, source = fruit.select("doc_id", "pages").coalesce(1), f"{staging.path}/fresh"

    def sink(found, number):
        found.write.mode("overwrite").parquet(f"{staging.path}/scores/batch={number}")

    def run(progress):
        stream = spark.readStream.schema(fresh.schema).parquet(source)
        query = (
            score_published(stream, store, f"{staging.path}/choices", sink)
            .option("checkpointLocation", f"{staging.path}/{progress}")
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(180)

    store.publish(first)
    fresh.write.parquet(source)
    run("progress")
    store.publish(second)
    assert store.published() == second
    fresh.write.mode("append").parquet(source)
    run("progress")

    def outcome():
        rows = spark.read.parquet(f"{staging.path}/scores").collect()
        return {n: {(r["model_id"], r["predicted"]) for r in rows if r["batch"] == n} for n in (0, 1)}

    wanted = {0: {(first, "03" * 12), (first, "08" * 12)}, 1: {(second, "late"), (second, "early")}}
    assert outcome() == wanted
    # A stream that lost its progress runs batch 0 again, with the model that was noted for it.
    run("lost")
    assert outcome()[0] == wanted[0]

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyspark.streaming import incremental
from tallyspark.streaming.incremental import Conflict, committed, ingest_files, ingest_invoices, manifests, uncommitted

SCHEMA = "k string, v int"


def folders(*names: str) -> list[str]:
    root = tempfile.mkdtemp(prefix="t1-")
    os.makedirs(os.path.join(root, "landing"))
    return [os.path.join(root, x) for x in names]


def land(landing: str, files: dict[str, str]) -> None:
    for name, text in files.items():
        with open(os.path.join(landing, name), "w", encoding="utf-8") as f:
            f.write(text)


def test_incremental_ingest_each_file_once(spark):
    landing, target, ckpt = folders("landing", "target", "ckpt")
    land(landing, {f"f{i}.csv": f"a{i},1\nb{i},2\n" for i in range(3)})
    for _ in range(2):
        ingest_files(spark, landing, "csv", SCHEMA, target, ckpt)
        assert committed(spark, target).count() == 6
    land(landing, {"f9.csv": "z,9\n"})
    ingest_files(spark, landing, "csv", SCHEMA, target, ckpt)
    out = committed(spark, target)
    assert out.count() == 7 and out.select(F.countDistinct("file_name")).first()[0] == 4


def test_replay_with_a_new_checkpoint_and_filtered_files(spark):
    landing, target, one, two = folders("landing", "target", "one", "two")
    land(landing, {f"f{i}.csv": f"a{i},{i}\n" for i in range(2)})
    for day, ckpt in (("one", one), ("two", two)):
        ingest_files(spark, landing, "csv", SCHEMA, target, ckpt, lambda b, day=day: b.where("v > 0").withColumn("day", F.lit(day)))
    assert [r.day for r in committed(spark, target).collect()] == ["one"]
    assert committed(spark, target, "files").count() == 2  # the file without kept rows as well


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("at", [("_write", 1), ("_write", 2), ("_write", 3), ("_commit", 1), ("after", 1)])
def test_a_kill_at_any_step_and_a_replay_in_other_batches(spark, monkeypatch, at):
    """The second batch dies before, or just after, one of its writes; the files come again with one more, in other
    batches and with another checkpoint.  Each row is there once, and so is each reject."""
    landing, target, ckpt, other = folders("landing", "target", "ckpt", "other")
    split = lambda b: (b.where("v > 0"), b.where("v <= 0"))
    land(landing, {"f0.csv": "a,1\nb,-1\n"})
    ingest_files(spark, landing, "csv", SCHEMA, target, ckpt, split)
    land(landing, {"f1.csv": "c,1\nd,-1\n"})
    name, nth, calls = "_commit" if at[0] == "after" else at[0], at[1], []
    real = getattr(incremental, name)

    def dying(*args):
        calls.append(args)
        if len(calls) == nth:
            if at[0] == "after":
                real(*args)
            elif name == "_write":
                real(args[0].limit(1), args[1])  # part of the data is there
            raise Killed
        return real(*args)

    monkeypatch.setattr(incremental, name, dying)
    with pytest.raises(Exception, match="Killed"):
        ingest_files(spark, landing, "csv", SCHEMA, target, ckpt, split)
    monkeypatch.undo()
    assert sorted(r.k for r in committed(spark, target).collect()) == (["a", "c"] if at[0] == "after" else ["a"])
    land(landing, {"f2.csv": "e,1\nf,-1\n"})
    ingest_files(spark, landing, "csv", SCHEMA, target, other, split, max_files_per_trigger=2)
    ingest_files(spark, landing, "csv", SCHEMA, target, ckpt, split)
    assert sorted(r.k for r in committed(spark, target).collect()) == ["a", "c", "e"]
    assert sorted(r.k for r in committed(spark, target, "rejects").collect()) == ["b", "d", "f"]
    assert committed(spark, target, "files").count() == 3


def test_a_number_of_the_log_is_taken_once(spark):
    landing, target, ckpt = folders("landing", "target", "ckpt")
    with pytest.raises(FileNotFoundError):
        committed(spark, target)
    assert committed(spark, target, schema=SCHEMA).count() == 0 and manifests(spark, target) == []
    land(landing, {"f0.csv": "a,1\n"})
    ingest_files(spark, landing, "csv", SCHEMA, target, ckpt)
    with pytest.raises(Conflict):
        incremental._commit(spark, target, 0, {"rows": "data/other"})
    assert len(manifests(spark, target)) == 1 and uncommitted(spark, target) == []


def test_streaming_invoices_with_rejects(spark):
    landing, target, ckpt = folders("landing", "target", "ckpt")
    xml = ('<Comprobante Folio="{0}" SubTotal="10" Total="11" MetodoPago="PUE"><Complemento>'
           '<TimbreFiscalDigital UUID="U{0}"/></Complemento></Comprobante>')
    land(landing, {"a.xml": xml.format(1), "b.xml": xml.format(2).replace("MetodoPago", "Other")})
    ingest_invoices(spark, landing, target, ckpt, "2024-02-01")
    land(landing, {"c.xml": xml.format(3), "d.xml": xml.format(4).replace("</Complemento>", "")})
    for _ in range(2):
        ingest_invoices(spark, landing, target, ckpt, "2024-02-01")
    assert sorted(r.receipt_number for r in committed(spark, target).collect()) == ["1", "3"]
    bad = {r.source_file: r.reject_reason for r in committed(spark, target, "rejects").collect()}
    assert set(bad) == {"b.xml", "d.xml"} and bad["b.xml"] == "missing:MetodoPago" and "corrupt_xml" in bad["d.xml"]

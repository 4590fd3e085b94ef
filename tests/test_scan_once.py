"""A scan reads the JSON of metadata once, and a scan that meets only known contents writes no texts."""

from pyspark.sql import functions as F

from fleetlens.operators import extract, metadata, scan
from fleetlens.sources.catalogue import built_in

FILES = [("u", "charmcraft.yaml", "name: u\nrequires: {db: {interface: mysql}}\n"), ("u", "src/charm.py", "import ops\n")]


def test_metadata_is_read_once(spark, monkeypatch):
    calls, plain = [], metadata.described
    monkeypatch.setattr(metadata, "described", lambda docs: calls.append(1) or plain(docs))
    made = scan.scan(spark.createDataFrame(FILES, "slug string, path string, text string"), *built_in())
    assert made.facts.where("feature = 'db.mysql' and present").count() == 1 and len(calls) == 1


def test_known_contents_write_no_text(spark, monkeypatch, tmp_path):
    wrote, plain = [], extract.staged
    monkeypatch.setattr(extract, "staged", lambda df: wrote.append(df.columns) or plain(df))
    files = spark.createDataFrame(FILES, "slug string, path string, text string")
    parse = lambda f: extract.facts_of(f, extract.yaml_parser(), f"file://{tmp_path}/known")
    first, n = parse(files)
    assert n == 1 and any("text" in c for c in wrote)
    wrote.clear()
    again, n = parse(files)
    assert n == 0 and not any("text" in c for c in wrote) and again.collect() == first.collect()
    assert parse(files.withColumn("text", F.concat("text", F.lit("# x\n"))))[1] == 1

"""Archives by bytes, names that resolve, long payloads, odd columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica.llm import warc

PAGE = "page_id long, url string, html string"


def test_revisits_name_a_record_that_is_there(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "y" * 200 if i % 3 else f"{i}" * 50) for i in range(40)], PAGE)
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w")).cache()
    ids = {x.id for x in records.collect()}
    revisits = records.where("type = 'revisit'").collect()
    assert len(ids) == 120 and len(revisits) == 25 and {x.refers_to for x in revisits} <= ids
    main = records.where(F.col("id") == revisits[0].refers_to).first()
    assert main.type == "response" and main.payload_digest == revisits[0].payload_digest


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("z"), F.when(F.col("id") % 50 == 0, 300_000).otherwise(2000).cast("int"))).alias("html")).coalesce(1)
    warc.write(pages, str(tmp_path / "w"), archive_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 1 << 20 and len(sizes) <= 20
    got = warc.assemble(warc.read(spark, str(tmp_path / "w")))
    assert got.agg(F.sum("response.payload_bytes")).first()[0] == pages.agg(F.sum(F.octet_length("html"))).first()[0]


@pytest.mark.parametrize("html", ["x" * 3_000_000, "é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 20, "\r\n\r\n\r\n\r\n", "\n"])
def test_payloads_come_back_whole(spark, tmp_path, html):
    warc.write(spark.createDataFrame([(1, "u", html), (2, "u", "other")], PAGE), str(tmp_path / "w"))
    got = {x.response.payload for x in warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {html, "other"}


def test_clashing_columns_and_many_repeated_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 150)] * 300 + [(2, "u", "x" * 150)], PAGE)
    for name in ("payload", "payload_digest", "payload_bytes", "refers_to", "_d", "value"):
        pages = pages.withColumn(name, F.lit(1))
    warc.write(pages, str(tmp_path / "w"))
    got = warc.assemble(warc.read(spark, str(tmp_path / "w")))
    assert got.count() == 301 and got.where("response.type = 'revisit'").count() == 1

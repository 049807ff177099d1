"""Header files that queries write: dealt to many tasks, and read no more often than a query asks."""

from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import functions as F

from voxlake.plans import file_forms, syntax_queries

SF = "/root/testdata/sf0.001"


def scans(frame, capsys):
    frame.explain()
    return capsys.readouterr().out.count("BatchScan element_files")


def test_rows_of_one_partition_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(file_forms, "PART_FILES", 2)
    rows = spark.range(9).coalesce(1)
    folder = file_forms.written(rows, lambda row: (f"{row['id']}", str(TaskContext.get().partitionId()).encode()))
    files = [x for x in Path(folder.removeprefix("file:")).iterdir() if not x.name.startswith(".")]
    assert {x.name for x in files} == set(map(str, range(9))) and len({x.read_bytes() for x in files}) > 1


def test_syntaxes_read_elements_and_report_once(spark, capsys):
    assert scans(syntax_queries.s1_syntaxes(spark, SF).filter(F.col("key") > 0), capsys) == 2


def test_report_reads_files_and_headers_once(spark, capsys):
    assert scans(syntax_queries.s1_file_report(spark, SF), capsys) == 2

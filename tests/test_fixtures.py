"""Derived tables: the same rows as their views, in parts that follow the tables."""

from collections import Counter

from voxlake.operators import catalog, deid
from voxlake.plans import deid_queries
from voxlake.sources import fixtures

SF = "/root/testdata/sf0.001"
PARTS, BYTES = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_elements_are_their_view_in_one_pass(spark, capsys):
    for base in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{SF}/{base}.parquet").createOrReplaceTempView(base)
    expected = Counter(map(tuple, spark.sql(fixtures.with_views("SELECT * FROM fx_elements")).collect()))
    found = fixtures.fixture(spark, SF, "fx_elements")
    found.explain()
    assert capsys.readouterr().out.count("ReadSchema: struct<l_orderkey") == 1
    assert Counter((r.file_id, r.path, r.tag, r.vr, r.value) for r in found.collect()) == expected


def test_parts_follow_the_lines(spark, monkeypatch):
    before = spark.conf.get(PARTS), spark.conf.get(BYTES)
    monkeypatch.setattr(fixtures, "PART_ROWS", 500)
    try:
        lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        sizes = fixtures.fixture(spark, SF, "fx_instances").rdd.glom().map(len).collect()
        assert len(sizes) >= lines // 500 and max(sizes) < 1000
        assert int(spark.conf.get(PARTS)) == -(-lines // 500)
    finally:
        spark.conf.set(PARTS, before[0])
        spark.conf.set(BYTES, before[1])


def test_steps_by_file_need_no_shuffle_of_elements(spark, capsys):
    deid.shift_dates(fixtures.elements(spark, SF), 1, 2, 3, 4).explain()
    plan = capsys.readouterr().out
    above = plan[plan.index("Window") : plan.index("Generate explode")]
    assert "Exchange" not in above


def test_maps_read_the_elements_once(spark, capsys):
    rows = fixtures.elements(spark, SF)
    uids, names, ids = deid.build_maps(rows, salt="s")
    for found, alone in ((uids, deid.build_uid_map(rows, salt="s")), (names, deid.build_name_map(rows, "s")), (ids, deid.build_id_map(rows, salt="s"))):
        assert sorted(found.collect()) == sorted(alone.collect())
    deid.apply_maps(rows, uids, names, ids).explain()
    assert capsys.readouterr().out.count("ReadSchema: struct<l_orderkey") == 1


def test_own_maps_need_no_shuffle_of_elements(spark, capsys):
    deid_queries.d4_apply_maps(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan[: plan.index("Generate explode")] and "file_key" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_chain_heads_leave_the_doubling(spark):
    lengths = {1: 1, 2: 2, 3: 3, 4: 9, 5: 33}
    rows = [(f, 10 * f + 1000 * k, 10 * f + 1000 * (k + 1) if k + 1 < n else 0) for f, n in lengths.items() for k in range(n)] + [(6, 1, 2), (6, 2, 1)]
    found = catalog._chain_heads(spark.createDataFrame(rows, "file_id long, off long, next_off long"))
    assert sorted(map(tuple, found.collect())) == sorted((f, off, 10 * f) for f, off, _ in rows if f != 6)

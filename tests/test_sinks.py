import os

import pytest

from prismata.session import PrismataError
from prismata.sources import sinks


@pytest.mark.parametrize("single", [True, False])
def test_output_is_replaced_whole(spark, tmp_path, single):
    path = str(tmp_path / "out.csv")
    for n in (3, 5):
        sinks.write_table(spark.range(n), path, single)
        assert spark.read.csv(path, header=True).count() == n
        assert os.listdir(tmp_path) == ["out.csv"]


def test_what_was_there_stays_if_the_new_one_is_lost(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    sinks.write_table(spark.range(3), path)
    fs, goal = sinks._fs(path)
    lost = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "lost"))
    with pytest.raises(PrismataError):
        sinks._replace(fs, lost, goal)
    assert spark.read.csv(path, header=True).count() == 3


@pytest.mark.parametrize("parts", [1, 12])
def test_one_csv_file_from_many_tasks(spark, tmp_path, parts):
    rows = [(i, f'text "{i}", more' if i % 3 else None, "é\nline") for i in range(500)]
    df = spark.createDataFrame(rows, '`k,"y` long, text string, other string').repartition(parts)
    plain = str(tmp_path / "plain")
    df.coalesce(1).write.csv(plain, header=True, quote='"', escape='"')
    want = next(p for p in (tmp_path / "plain").iterdir() if p.name.startswith("part-")).read_bytes()
    path = sinks.write_table(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == want and sorted(os.listdir(tmp_path)) == ["out.csv", "plain"]
    sinks.write_table(df.where("false"), path)
    assert (tmp_path / "out.csv").read_bytes() == want.split(b"\n")[0] + b"\n"


def test_an_interrupted_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        sinks.write_table(spark.range(0, 100, 1, 4).selectExpr("IF(id = 99, raise_error('broken'), id) AS id"), path)
    assert spark.read.csv(path, header=True).count() == 3 and os.listdir(tmp_path) == ["out.csv"]


def test_output_is_what_the_input_is(spark, tmp_path):
    from prismata.operators.transform import clean

    rows = spark.range(200).selectExpr("IF(id % 3 = 0, NULL, id * 1.5) AS x", "id % 7 AS y")
    for single in (True, False):
        path = sinks.write_table(rows, str(tmp_path / f"in{single}.csv"), single)
        clean(path, str(tmp_path / f"out{single}.csv"))
        assert os.path.isfile(tmp_path / f"out{single}.csv") == single

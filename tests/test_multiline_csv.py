import pytest
from pyspark.sql import functions as F

import prismata as pr
from prismata.sources.multiline import Cutter
from prismata.sources.readers import read_csv

OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": ""}


@pytest.fixture
def split(spark):
    """Files are read in blocks of some bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_that_span_lines_are_read_by_many_tasks(spark, tmp_path, split, end):
    cells = ["x", "", '"q,"', f'"two{end}lines"', '"a ""b"""', f'"""{end}"""', '"' + f"long{end}" * 60 + '"', 'in"side', f'"junk{end}"after', "é"]
    lines = ['"id"', "one", "two"]
    for name, rest in (("a", end), ("b", f'{end}99,"never{end}closed{end}')):
        rows = [f"{i},{cells[i % 10]},{cells[i * 7 % 10 - 1]}" for i in range(30)]
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        (tmp_path / "t.csv" / f"{name}.csv").write_text(end.join([",".join(lines), *rows]) + rest, newline="")
    path = str(tmp_path / "t.csv")
    got = read_csv(path).df
    assert got.rdd.getNumPartitions() > 10  # a task a file before
    want = spark.read.schema("id long, one string, two string").csv(path, **OPTIONS)
    key = F.struct("id", "one", "two").cast("string")
    plain = lambda df: sorted(r[0] for r in df.select(key).collect())
    assert got.columns[:1] == ["id"] and plain(got) == plain(want) and len(plain(got)) == 61


def test_types_of_fields_that_span_lines(spark, tmp_path, split):
    path = tmp_path / "t.csv"
    path.write_text("id,note,n\n" + "".join(f'{i},"a\n{i}",{"oops" if i == 250 else i}\n' for i in range(300)))
    p = pr.scan(str(path))
    assert (p.num_rows, [c.type_str for c in p.columns]) == (300, ["int", "str", "int"])
    assert p.column("n").type_mismatch_count == 1 and p.column("id").val_max == 299


def test_an_open_record_is_not_read_again_with_each_part():
    cutter = Cutter(",", "\n", False)
    seen = [cutter.add(b'"' + b"x\n" * 50)] + [cutter.add(b"y\n" * 50) for _ in range(99)]
    assert not any(seen) and cutter.add(b'z",1\n2,3\n', True) == [b'"' + b"x\n" * 50 + b"y\n" * 50 * 99 + b'z",1\n', b"2,3\n"] and cutter.tail == b""

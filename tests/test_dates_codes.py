import datetime

import pytest
from pyspark.sql import functions as F

from prismata.operators.transform import encode
from prismata.sources.readers import read_csv


def test_dates_by_votes(spark, tmp_path):
    path = tmp_path / "d.csv"
    rows = ["us,eu,at,bad,few"] + [f"12/{d:02}/2024,{d:02}/{d % 12 + 1:02}/2024,2024-01-{d:02} 10:00:{d:02},{d}-x,{'2024-01-01' if d < 20 else 'text'}" for d in range(1, 29)]
    rows += ["13/13/2024,31/02/2024,2024-01-01,a,b", "NA,,null,b,c"]
    path.write_text("\n".join(rows) + "\n")
    found = read_csv(str(path), infer_dates=True)
    assert dict(found.df.select("us", "eu", "at", "bad", "few").dtypes) == {"us": "date", "eu": "date", "at": "timestamp", "bad": "string", "few": "string"}
    got = found.df.collect()
    assert got[2].us == datetime.date(2024, 12, 3) and got[2].eu == datetime.date(2024, 4, 3) and got[2].at == datetime.datetime(2024, 1, 3, 10, 0, 3)
    assert [got[28][f"__misfit_{c}"] for c in ("us", "eu", "at")] == [True] * 3 and [got[29][f"__misfit_{c}"] for c in ("us", "eu", "at")] == [False] * 3
    assert dict(read_csv(str(path)).df.dtypes)["us"] == "string"


@pytest.mark.parametrize("bucket", [1_000_000, 3])
def test_all_columns_are_encoded_by_one_dictionary(spark, monkeypatch, bucket):
    monkeypatch.setattr("prismata.operators.transform.BUCKET_VALUES", bucket)
    rows = [(i, f"v{i % 7}" if i % 5 else None, "ab"[i % 2], None, i % 3) for i in range(40)] + [(40, "", "é", None, None)]
    df = spark.createDataFrame(rows, "`a.b` long, value string, number string, empty string, code int")
    out, counts = encode(df, ["value", "number", "empty", "code"])
    assert counts == {"value": 8, "number": 3, "empty": 0, "code": 3} and out.columns == df.columns
    want = []
    for column in list(zip(*rows))[1:]:
        order = sorted({x for x in column if x is not None})
        want.append([-1 if x is None else order.index(x) for x in column])
    assert sorted(map(tuple, out.collect())) == [(r[0], *w) for r, w in zip(rows, zip(*want))]
    assert encode(df.where(F.lit(False)), ["value"])[0].count() == 0

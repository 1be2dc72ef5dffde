import json
import random

import pytest
from pyspark.sql import types as T

from supportlens.sources import json_ranges as JR, readers as R

RECORD = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()), T.StructField("c", T.ArrayType(T.StringType()))])
HARD = ["", "\\", '"', '\\"', "[{,:}]", "é ☃ 😀", "\n\t", "\\\\\\", '","', "]", "}" * 9, "x" * 300, '"[' * 40]


def records(n, seed=3):
    draw = random.Random(seed)
    return [{"a": draw.choice(HARD), "b": i, "c": draw.sample(HARD, draw.randrange(4)), "d": {"e": [[1], {"f": draw.choice(HARD)}]}} for i in range(n)]


@pytest.mark.parametrize("range_bytes", [7, 100, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_equal_the_whole_reader(spark, tmp_path, monkeypatch, range_bytes, indent):
    rows = records(6 if range_bytes == 7 else 40)
    monkeypatch.setattr(JR, "PIECE", 64)
    for name, part in (("one", rows), ("empty", []), ("blank", None)):
        (tmp_path / f"{name}.json").write_text("" if part is None else json.dumps(part, indent=indent, ensure_ascii=bool(indent)))
    got = JR.read_json_array(spark, str(tmp_path), RECORD, range_bytes)
    whole = R.read_json_records(spark, str(tmp_path / "one.json"), RECORD, array=True)
    assert got.schema == whole.schema
    key = lambda r: r.b
    assert sorted(got.collect(), key=key) == sorted(whole.collect(), key=key) and got.count() == len(rows)


@pytest.mark.parametrize("range_bytes", [5, 33, 1 << 20])
def test_groups_equal_plain_python(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(JR, "PIECE", 50)
    draw = random.Random(8)
    groups = {f"{word} {i}": [draw.choice(HARD) for _ in range(draw.randrange(6))] for i, word in enumerate(HARD[:8])}
    (tmp_path / "g.json").write_text(json.dumps(groups, indent=2))
    got = JR.read_json_groups(spark, str(tmp_path), T.StringType(), range_bytes).collect()
    assert sorted((r.group, r.item) for r in got) == sorted((g, item) for g, items in groups.items() for item in items)
    nested = {"x": records(6), 'y "': records(5, 4), "none": []}
    (tmp_path / "g.json").write_text(json.dumps(nested))
    got = JR.read_json_groups(spark, str(tmp_path), RECORD, range_bytes).collect()
    assert sorted((r.group, r.item.b, r.item.a) for r in got) == sorted((g, r["b"], r["a"]) for g, rows in nested.items() for r in rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(400)))
    frame = JR.read_json_array(spark, str(tmp_path), RECORD, 2000)
    size = (tmp_path / "a.json").stat().st_size
    assert size > 64_000 and frame.rdd.getNumPartitions() == 8 * 4 and frame.count() == 400


def test_a_cut_file_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(4))[:-5])
    with pytest.raises(Exception, match="ends inside an element"):
        JR.read_json_array(spark, str(tmp_path), RECORD).count()

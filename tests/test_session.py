import os

import pytest

from supportlens.session import materialize, work_folder, work_scope


def test_scope_deletes_its_own_folders(spark):
    outside = work_folder(spark, "outside")
    made = []
    with work_scope(spark):
        kept = materialize(spark.range(5), "kept", outside)
        made.append(work_folder(spark, "never-written"))
        part = materialize(spark.range(3), "inner")
        made.append(part.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
        with work_scope(spark):
            nested = materialize(spark.range(2), "nested").inputFiles()[0].removeprefix("file://")
            assert os.path.exists(nested)
        assert not os.path.exists(nested) and part.count() == 3
    assert not any(os.path.exists(path) for path in made)
    assert kept.count() == 5
    assert os.path.exists(outside.removeprefix("file://"))


def test_scope_deletes_after_an_error(spark):
    with pytest.raises(ZeroDivisionError):
        with work_scope(spark):
            path = materialize(spark.range(3), "failed").inputFiles()[0].removeprefix("file://")
            raise ZeroDivisionError
    assert not os.path.exists(path)


def test_folders_outside_of_a_scope_stay(spark):
    path = materialize(spark.range(3), "stays").inputFiles()[0].removeprefix("file://")
    with work_scope(spark):
        pass
    assert os.path.exists(path)

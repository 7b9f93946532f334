"""The quoted extract is read back from its files; the view is there by name."""

import datetime as dt

import pytest

from churnscope.sources import csv_io
from conftest import SMALL

DDL = "id long, s string, t string, d date, x double"


def test_round_trip_of_quotes_breaks_and_nulls(spark, tmp_path):
    rows = [(1, None, "a\nb", None, 1.5), (2, 'say "x", ok', "back\\slash\\", dt.date(2019, 3, 1), None), (3, "é,;", "' ", dt.date(2099, 12, 31), -0.1)]
    df = spark.createDataFrame(rows, DDL)
    back = csv_io.checked_export(df.repartition(2), str(tmp_path / "x"))
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == rows
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("*.csv"))
    assert '"id","s","t","d","x"' in text and '"2","say ""x"", ok"' in text
    assert csv_io.checked_export(df.limit(0), str(tmp_path / "none")).count() == 0


def test_damaged_extract_is_found(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a", "b", None, 1.0), (2, "c", "d", None, 2.0)], DDL).coalesce(1)
    real = csv_io.export_delimited

    def damaged(change):
        def export(rows, path):
            real(rows, path)
            (file,) = __import__("pathlib").Path(path).glob("part-*.csv")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            file.write_text(change(file.read_text()))

        return export

    for i, change in enumerate((lambda t: t.replace('"2"', '"two"'), lambda t: t.rsplit("\n", 2)[0] + "\n", lambda t: t + '"3","x","y","","1.0"\n')):
        monkeypatch.setattr(csv_io, "export_delimited", damaged(change))
        with pytest.raises(ValueError):
            csv_io.checked_export(df, str(tmp_path / str(i)))


def test_view_has_every_published_column(spark):
    from churnscope.registry import context, load_all

    queries, _ = load_all()
    c = context(spark, SMALL)
    assert queries["feature_view"](c).columns == c.features.columns
    assert spark.table("service_agreement_features_v").count() == c.features.count()

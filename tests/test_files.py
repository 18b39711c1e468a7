"""Sources, sinks and settings on small files."""

import json

from seriesloom.plans import prepare
from seriesloom.sources import config, layouts, sinks, tables


def test_settings_precedence(spark, tmp_path):
    folder = tmp_path / "amazon_forecast_1"
    folder.mkdir()
    row = config.dataset_info(spark, str(folder)).first()
    assert (row["dataset_name"], row["date_col"], row["target_col"]) == ("AMAZON", "date", "daily_sales")
    (folder / "config.json").write_text(json.dumps({"date_col": "day", "target_col": None}))
    (folder / "column_info.json").write_text(json.dumps({"date_col": "other", "target_col": "other"}))
    row = config.dataset_info(spark, str(folder)).first()
    assert (row["date_col"], row["target_col"]) == ("day", "daily_sales")
    custom = tmp_path / "shop_forecast_2"
    custom.mkdir()
    (custom / "column_info.json").write_text(json.dumps({"date_col": "when", "target_col": "sold"}))
    row = config.dataset_info(spark, str(custom)).first()
    assert (row["dataset_name"], row["dataset_type"], row["date_col"], row["target_col"]) == ("SHOP", "custom", "when", "sold")


def test_written_settings_come_back(spark, tmp_path):
    path = config.write_config(spark, {"date_col": "a", "target_col": "b", "steps": 30}, str(tmp_path / "c"))
    assert tuple(config.read_columns(spark, path).first()) == ("a", "b")


def test_unreadable_metrics(spark, tmp_path):
    assert tables.read_metrics(spark, str(tmp_path / "none.csv")).first()["Model"] == "Error loading data"


def test_metric_layouts(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("Model,RMSE,MAE\nARIMA,1.0,2.0\n")
    assert tables.read_metrics(spark, str(path)).columns == ["Model", "RMSE", "MAE"]
    path = tmp_path / "n.csv"
    path.write_text("name,rmse\nsarima,1.0\n")
    assert tables.read_metrics(spark, str(path)).columns == ["Model", "RMSE"]
    path = tmp_path / "o.csv"
    path.write_text("day,rmse\n2024-01-01,1.0\n")
    assert tables.read_metrics(spark, str(path)).columns == ["day", "rmse"]


def test_newest_file_first(spark, tmp_path):
    import os
    for i, name in enumerate(("b_forecast.csv", "a_forecast.csv")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    found = tables.find_files(spark, str(tmp_path), ["*_none.csv", "*_forecast.csv"]).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in found] == ["a_forecast.csv", "b_forecast.csv"]


def test_layout_routing(spark, tmp_path):
    assert layouts.find_layout("car_prices").name == "vehicle_sales" and layouts.find_layout("mine") is None
    columns = [c.strip().split()[0] for c in layouts.LAYOUTS["product_prices"].schema.split(",")]
    raw = spark.createDataFrame([tuple("₹1,099" if "price" in c else "64%" if c == "discount_percentage" else "4" for c in columns)], ", ".join(f"{c} string" for c in columns))
    path = sinks.write_table(raw, str(tmp_path / "p"), fmt="csv")
    frame, ts, y = prepare.prepare_dataset(spark, "amazon", path, order=["product_id"], end="2024-01-31")
    row = frame.first()
    assert (str(row[ts]), row[y], row["discount_percentage"]) == ("2024-01-31", 4396.0, 64.0)


def test_custom_dataset_is_detected(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("when_date,id,amount\n" + "".join(f"2024-01-{i:02d},{i},{i * 1.5}\n" for i in range(1, 31)))
    frame, ts, y = prepare.prepare_dataset(spark, "mine", str(path))
    assert (ts, y) == ("when_date", "amount") and frame.count() == 30

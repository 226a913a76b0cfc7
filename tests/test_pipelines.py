"""The named pipelines on a table with the reference's column layout."""
import pytest

from gearlens.plans import pipelines as PL

B = "engineTransmission_"
COLUMNS = ["appointmentId string", "inspectionStartTime string", "year int", "month int",
           f"{B}battery_value string", f"{B}battery_cc_value_0 string", f"{B}battery_cc_value_1 string",
           f"{B}engineOil_value string", f"{B}engineOil_cc_value_0 string", f"{B}engineOil_cc_value_9 string",
           f"{B}engine_cc_value_0 string", f"{B}engine_cc_value_10 string", f"{B}comments_value_0 string",
           "odometer_reading double", "fuel_type string", "rating_engineTransmission double"]
ROWS = [
    ("a1", "2019-02-03 10:15:00", 2015, 1, "Yes", "Weak", None, "No", "Leaking", None, "Misfiring", None,
     None, 50000.0, "Petrol", 4.0),
    ("a2", "2019-02-04 15:40:00", 2012, 3, "No", "Jump Start", "Weak", "Yes", "Level Low", None, "Over heating",
     None, "Pickup Low", 90000.0, "Diesel", 2.5),
    ("a3", "2019-03-10 16:05:00", 2010, 1, "No", None, "Not Working", "No", None, None, None, None,
     "Radiator Fan not working", 120000.0, "Petrol + CNG", 3.0),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, ", ".join(COLUMNS))


def test_production_feature_list(table):
    ff = PL.production_features(table)
    assert ff.features == [
        "year", "month", "odometer_reading", "inspection_hour", "inspection_mon",
        B + "engineOil_cc_value_9_9", B + "engine_cc_value_10_10", B + "battery_value_Yes_Yes",
        B + "battery_cc_value_Weak", B + "engineOil_cc_value_Level_Low", B + "engine_cc_value_Over_heating",
        B + "comments_value_Radiator_Fan_not_working", "fuel_type_Petrol", "fuel_type_Petrol___CNG"]
    rows = {r.appointmentId: r for r in ff.df.collect()}
    # the Yes roll-up crosses components: battery (a1) and engine oil (a2)
    assert [rows[k][B + "battery_value_Yes_Yes"] for k in ("a1", "a2", "a3")] == [1, 1, 0]
    assert [rows[k][B + "battery_cc_value_Weak"] for k in ("a1", "a2", "a3")] == [1, 1, 0]
    assert all(rows[k][B + "engineOil_cc_value_9_9"] == 0 for k in rows)
    assert (rows["a3"].fuel_type_Petrol___CNG, rows["a3"].inspection_hour, rows["a3"].inspection_mon) == (1, 16, 3)


def test_component_mode_keeps_components(table):
    ff = PL.production_features(table, rollup_mode="component")
    assert B + "battery_value_Yes" in ff.features and B + "engineOil_value_Yes" in ff.features
    assert B + "battery_cc_value_Weak" in ff.features


def test_explore_pipeline(table):
    cleaned = PL.explore_clean(table)
    # the fences of year (2010..2015) and odometer keep every row here
    ff = PL.explore_features(table, cleaned=cleaned)
    assert not any("comments" in f for f in ff.features)
    assert all(not f.startswith(B) or f.endswith("_1") for f in ff.features)
    # the rolled-up 'yes' flag is the constant column the reference drops
    assert not any(f.startswith(B + "battery_cc_value_yes") for f in ff.features)
    assert B + "battery_cc_value_Weak_1" in ff.features
    assert ff.df.count() == 3


def test_large_sides_of_inspections_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Events and slots beyond the fixed bound meet by a shuffle, however small their columns look."""
    from gearlens.sources import driver_tables
    from gearlens.sources.driver_tables import inspections
    monkeypatch.setattr(driver_tables, "HELD_BYTES", 0, raising=False)
    spark.sql("SELECT id AS o_orderkey, 'F' AS o_orderstatus, id * 1.5D AS o_totalprice, DATE'2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(50)") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP'2020-01-02 03:04:05' AS ts, '{\"k\": 40}' AS props FROM range(40)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, 'R' AS l_returnflag, 'O' AS l_linestatus FROM range(45)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = inspections(spark, str(tmp_path))
    assert got.count() == 50 and got.where("inspectionStartTime IS NULL").count() == 10
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

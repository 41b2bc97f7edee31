import datetime
import functools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketline.errors import CleaningError
from basketline.functions import text
from basketline.operators import cleaning, pairing
from tests.frames import raw_frame


def values(frame, column):
    return [row[column] for row in frame.orderBy("ord").collect()]


def counters(raw, cleaned=None):
    table = cleaning.stage_metrics(raw, cleaned if cleaned is not None else cleaning.clean(raw))
    return {(row["stage"], row["metric"]): row["value"] for row in table.collect()}


def test_structure_errors(spark):
    with pytest.raises(CleaningError):
        cleaning.clean("not a frame")
    with pytest.raises(CleaningError, match="missing"):
        cleaning.clean(spark.createDataFrame([("1",)], "InvoiceNo string"))
    frame = raw_frame(spark, [{}])
    with pytest.raises(CleaningError, match="duplicate"):
        cleaning.clean(frame.select("*", "Country"))


def test_output_columns_and_empty_stage_list(spark):
    raw = raw_frame(spark, [{}, {"InvoiceNo": "7002", "Quantity": "2", "UnitPrice": "1.50"}])
    cleaned = cleaning.clean(raw)
    assert cleaned.count() == 2
    added = {"Revenue", "IsCancellation", "IsAdjustment", "IsReturn", "IsNonProduct"}
    assert added <= set(cleaned.columns)
    assert cleaning.clean(raw, ()).columns == raw.columns


@pytest.mark.parametrize(
    ("cell", "whole", "real"),
    [
        ("6", 6, 6.0), ("-6", -6, -6.0), ("6.0", 6, 6.0), ("6e0", 6, 6.0), ("6.5", None, 6.5),
        (" 7 ", 7, 7.0), (" 7　", 7, 7.0), ("1d", None, None), ("1.5f", None, None),
        ("inf", None, None), ("nan", None, None), ("1e400", None, None), ("0x10", None, None),
        ("", None, None), (None, None, None), ("9223372036854775807", 2**63 - 1, 2.0**63),
        ("9223372036854775808", None, 2.0**63), (".5", None, 0.5), ("5.", 5, 5.0),
    ],
)
def test_numbers(spark, cell, whole, real):
    frame = spark.createDataFrame([(cell,)], "cell string")
    tidy = text.normalized(F.col("cell"))
    row = frame.select(text.to_whole_number(tidy), text.to_finite_number(tidy)).first()
    assert tuple(row) == (whole, real)


def test_dates(spark):
    cases = {
        "12/1/2010 8:26": datetime.datetime(2010, 12, 1, 8, 26),
        "2/28/2011 08:05": datetime.datetime(2011, 2, 28, 8, 5),
        "2010-12-01": datetime.datetime(2010, 12, 1),
        "2010-12-01T08:26:11": datetime.datetime(2010, 12, 1, 8, 26, 11),
        "13/1/2010": datetime.datetime(2010, 1, 13),
        "12/1/2010 8:26 PM": datetime.datetime(2010, 12, 1, 20, 26),
        "1 December 2010": datetime.datetime(2010, 12, 1),
        "Dec 1, 2010": datetime.datetime(2010, 12, 1),
        "2/30/2010 8:26": None,
        "13/13/2010": None,
        "soon": None,
    }
    frame = spark.createDataFrame(list(cases.items()), "cell string, expected timestamp_ntz")
    wrong = frame.where(~text.to_timestamp_any(F.col("cell")).eqNullSafe(F.col("expected")))
    assert wrong.collect() == []


def test_null_customers_are_dropped(spark):
    raw = raw_frame(
        spark,
        [{}, {"CustomerID": ""}, {"CustomerID": "not-a-number"}, {"CustomerID": "\u0085311.0\u001c"}],
    )
    cleaned = cleaning.drop_unidentified(cleaning.coerce_types(raw))
    assert values(cleaned, "CustomerID") == ["311", "311"]
    found = counters(raw)
    assert found[("null_customer_drop", "customer_id_rows_dropped")] == 2
    assert found[("type_coercion", "customer_id_missing")] == 1
    assert found[("type_coercion", "customer_id_uncoerced")] == 1


def test_tags(spark):
    raw = raw_frame(
        spark,
        [
            {"InvoiceNo": "7001"},
            {"InvoiceNo": "C7001", "Quantity": "-4"},
            {"InvoiceNo": "A7001", "Quantity": "-1"},
            {"InvoiceNo": "7002", "Quantity": "-2"},
            {"InvoiceNo": "ABC123", "Quantity": "5"},
            {"InvoiceNo": " c7003 ", "Quantity": "5"},
        ],
    )
    cleaned = cleaning.clean(raw)
    assert values(cleaned, "IsCancellation") == [False, True, False, False, False, True]
    assert values(cleaned, "IsAdjustment") == [False, False, True, False, False, False]
    assert values(cleaned, "IsReturn") == [False, True, False, True, False, False]
    found = counters(raw)
    assert found[("cancellation_tagging", "cancellations")] == 2
    assert found[("cancellation_tagging", "cancellations_without_negative_quantity")] == 1
    assert found[("cancellation_tagging", "paired_cancellations")] == 1


def test_return_is_paired(spark):
    raw = raw_frame(
        spark,
        [
            {"InvoiceNo": "7001"},
            {"InvoiceNo": "C7001", "Quantity": "-4", "InvoiceDate": "5/7/2025 9:00"},
        ],
    )
    assert values(cleaning.clean(raw), "PairedInvoiceNo") == [None, "7001"]
    assert counters(raw)[("cancellation_tagging", "paired_returns")] == 1


def test_ineligible_rows_are_counted(spark):
    raw = raw_frame(
        spark,
        [
            {"Quantity": "-4", "InvoiceDate": "bad"},
            {"Quantity": "-4", "UnitPrice": "bad"},
            {"InvoiceDate": "bad"},
            {"Quantity": "bad", "InvoiceDate": "bad"},
            {"StockCode": " "},
            {"Quantity": "bad"},
            {"InvoiceNo": "C1", "InvoiceDate": "bad"},
        ],
    )
    found = counters(raw)
    assert found[("cancellation_tagging", "pairing_ineligible_returns")] == 2
    assert found[("cancellation_tagging", "pairing_ineligible_originals")] == 3


def test_revenue_and_non_products(spark):
    raw = raw_frame(
        spark,
        [
            {"Quantity": "3", "UnitPrice": "2.00"},
            {"StockCode": "POST", "Quantity": "0"},
            {"StockCode": "M", "UnitPrice": "x"},
        ],
    )
    cleaned = cleaning.clean(raw)
    assert values(cleaned, "Revenue") == [6.0, 0.0, None]
    assert values(cleaned, "IsNonProduct") == [False, True, True]
    found = counters(raw)
    assert found[("revenue_derivation", "zero_revenue_rows")] == 1
    assert found[("non_product_tagging", "non_product_rows")] == 2


def stack_pairs(rows):
    """Plain stack per key: what pairing must equal."""
    open_sales, result = {}, {}
    for place, customer, minute, quantity, price in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (customer, abs(quantity), price)
        if quantity > 0:
            open_sales.setdefault(key, []).append(f"{place}")
        elif open_sales.get(key):
            result[place] = open_sales[key].pop()
    return result


ROWS = st.lists(
    st.tuples(
        st.sampled_from(["1", "2"]), st.integers(0, 6), st.sampled_from([1, -1, 1, -1, 2, -2]),
        st.sampled_from([1.0, 1.5]),
    ),
    min_size=1,
    max_size=60,
)


def pair(spark, rows, hot_rows):
    lines = spark.createDataFrame(
        [
            (f"{place}", "S", quantity, datetime.datetime(2020, 1, 1, 0, minute), price, customer,
             False, False, quantity < 0, place)
            for place, customer, minute, quantity, price in rows
        ],
        "InvoiceNo string, StockCode string, Quantity long, InvoiceDate timestamp_ntz, "
        "UnitPrice double, CustomerID string, IsCancellation boolean, IsAdjustment boolean, "
        "IsReturn boolean, ord long",
    )
    paired = pairing.pair_returns(lines, hot_rows=hot_rows)
    assert paired.count() == len(rows)
    found = paired.where("PairedInvoiceNo is not null").select("ord", "PairedInvoiceNo")
    return {row["ord"]: row["PairedInvoiceNo"] for row in found.collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(drawn=ROWS)
def test_pairing_equals_a_stack(spark, drawn):
    rows = [(place, *rest) for place, rest in enumerate(drawn)]
    assert pair(spark, rows, pairing.HOT_KEY_ROWS) == stack_pairs(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(drawn=ROWS)
def test_pairing_in_blocks_equals_a_stack(spark, drawn):
    rows = [(place, *rest) for place, rest in enumerate(drawn)]
    assert pair(spark, rows, 3) == stack_pairs(rows)


def test_pairing_in_shares_equals_a_stack(spark, monkeypatch):
    """Many rows are shuffled in shares of the keys, whose returns are written; 0 and -0 are one price."""
    draw, names, plain = random.Random(4), [], pairing.stored
    rows = [(n, str(draw.randint(1, 9)), draw.randint(0, 20), draw.choice([1, -1, 2, -2]), draw.choice([0.0, -0.0, 1.5])) for n in range(200)]
    monkeypatch.setattr(pairing, "SHARED_ROWS", len(rows) - 1)
    monkeypatch.setattr(pairing, "stored", lambda frame, name: names.append(name) or plain(frame, name))
    assert pair(spark, rows, pairing.HOT_KEY_ROWS) == stack_pairs(rows)
    assert names.count("paired-returns") == pairing.KEY_SHARES
    monkeypatch.setattr(pairing, "SHARED_ROWS", len(rows))
    assert pair(spark, rows, pairing.HOT_KEY_ROWS) == stack_pairs(rows)
    assert names.count("paired-returns") == pairing.KEY_SHARES
    monkeypatch.setattr(pairing, "SHARED_ROWS", 0)
    assert pair(spark, rows, 6) == stack_pairs(rows)  # some keys are large


def test_one_key_spread_over_blocks(spark):
    """All sales first, then all returns: every match crosses block edges."""
    many = 400
    rows = [(n, "1", n // 60, 1, 1.0) for n in range(many)]
    rows += [(many + n, "1", 10 + n // 60, -1, 1.0) for n in range(many + 5)]
    assert pair(spark, rows, 50) == stack_pairs(rows)


def test_hot_keys_are_counted_exactly(spark, monkeypatch):
    blocks = []
    plain = pairing._pair_by_block
    monkeypatch.setattr(pairing, "_pair_by_block", lambda frame, n: blocks.append(n) or plain(frame, n))
    rows = [(n, "1", n // 60, 1, 1.0) for n in range(7)] + [(9, "2", 1, 1, 1.0)]
    assert pair(spark, rows, 7) == stack_pairs(rows) and blocks == []
    assert pair(spark, rows, 3) == stack_pairs(rows) and blocks == [3]


def test_cleaning_nothing(spark):
    assert cleaning.clean(raw_frame(spark, [{}]).limit(0)).count() == 0
    assert cleaning.clean(raw_frame(spark, [{"CustomerID": None}])).count() == 0


def test_pairing_shuffles_once(spark, small):
    from basketline.sources.tables import typed_lines

    paired = pairing.pair_returns(typed_lines(spark, small, country=False))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = paired.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(CustomerID") == 1


def test_custom_stage_list(spark):
    codes = functools.partial(cleaning.tag_non_products, codes=("LOAF",))
    frame = cleaning.clean(raw_frame(spark, [{}]), (cleaning.coerce_types, codes))
    assert frame.first()["IsNonProduct"] is True


def test_partitions_do_not_grow_with_blocks(spark, monkeypatch):
    seen, plain = {}, pairing.written
    monkeypatch.setattr(pairing, "written", lambda frame, name: seen.update({name: plain(frame, name)}) or seen[name])
    rows = [(n, "1", n // 60, 1, 1.0) for n in range(60)] + [(60 + n, "1", 10 + n // 60, -1, 1.0) for n in range(60)]
    assert pair(spark, rows, 4) == stack_pairs(rows)
    blocks = [r["_block"] for r in seen["pair-blocks"].select("_block").distinct().collect()]
    assert len(blocks) == 30 and {block >> 33 for block in blocks} == {0}


def test_only_whole_returns_and_keys_of_sales_are_moved(spark):
    lines = spark.createDataFrame(
        [("1", "S", "loaf", 2, datetime.datetime(2020, 1, 1), 1.5, "7", False, False, False, 1),
         ("C2", "S", "back", -2, datetime.datetime(2020, 1, 2), 1.5, "7", True, False, True, 2),
         ("3", "S", "free", 2, None, 1.5, "7", False, False, False, None)],
        "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp_ntz, "
        "UnitPrice double, CustomerID string, IsCancellation boolean, IsAdjustment boolean, IsReturn boolean, ord long",
    )
    paired = pairing.pair_returns(lines)
    found = {row["InvoiceNo"]: (row["Description"], row["Quantity"], row["PairedInvoiceNo"]) for row in paired.collect()}
    assert found == {"1": ("loaf", 2, None), "C2": ("back", -2, "1"), "3": ("free", 2, None)}
    assert paired.columns == [*lines.columns, "PairedInvoiceNo"]
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Window"):]
    assert plan.lstrip().startswith("Union") and "_delta#" in moved and "_row#" in moved


def test_prices_to_four_decimals(spark):
    prices = [0.0, -0.0, 1.5, 2.00005, 2.00015, 0.00005, 1e-9, 12345678.12345, 1e300, 999999.9999, float("nan"), None, -3.33335]
    frame = spark.createDataFrame([(p,) for p in prices], "p double")
    same = pairing._to_four_decimals(F.col("p")).eqNullSafe(F.bround("p", 4))
    assert frame.where(~same).collect() == []


def test_tidy_cells_and_ids(spark):
    cells = {"a": "a", " a": "a", "a ": "a", "　": None, "": None, "café": "café", "a\x01": "a\x01", "a b\n": "a b", "~": "~", "\x7f": "\x7f"}
    frame = spark.createDataFrame(list(cells.items()), "cell string, expected string")
    assert frame.where(~text.normalized(F.col("cell")).eqNullSafe(F.col("expected"))).collect() == []
    ids = {"17850": "17850", "017": "017", " 5.0 ": "5", "x1": None, "": None, "5\n": "5", "٣": None}
    frame = spark.createDataFrame(list(ids.items()), "cell string, expected string")
    assert frame.where(~text.to_customer_id(F.col("cell")).eqNullSafe(F.col("expected"))).collect() == []
    dates = ["1/1/0000 0:00", "2/29/2000 23:59", "1/1/2000 24:00", "12/31/9999 9:9", "0/1/2000 1:1", "1/1/2000 1:60"]
    frame = spark.createDataFrame([(d,) for d in dates], "cell string")
    layout = F.try_to_timestamp("cell", F.lit("M/d/yyyy H:m")).cast("timestamp_ntz")
    assert frame.where(~text.to_timestamp_any(F.col("cell")).eqNullSafe(layout)).collect() == []

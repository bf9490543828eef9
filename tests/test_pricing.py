import pytest
from pyspark.sql import functions as F

from wicker.operators import pricing as P

RULE = """id bigint, product_id bigint, combination_id bigint, shop_id bigint, currency_id bigint, country_id bigint,
 group_id bigint, customer_id bigint, cart_id bigint, price decimal(20,6), from_quantity bigint, reduction decimal(20,6),
 reduction_tax int, reduction_type string, valid_from string, valid_to string, priority int"""
AS_OF = "2026-01-15 00:00:00"


def rules(spark, *overs):
    from decimal import Decimal

    base = dict(
        id=1, product_id=7, combination_id=0, shop_id=0, currency_id=0, country_id=0, group_id=0, customer_id=0, cart_id=0,
        price=Decimal(-1), from_quantity=1, reduction=Decimal("0.1"), reduction_tax=1, reduction_type="percentage",
        valid_from=None, valid_to=None, priority=None,
    )
    return spark.createDataFrame([tuple((base | {"id": i + 1} | o).values()) for i, o in enumerate(overs)], RULE)


def requests(spark, n=1):
    return spark.createDataFrame(
        [(i, 7, 3, 5, 1, 1, 1, 1, 0) for i in range(n)],
        """request_id int, product_id bigint, combination_id bigint, quantity bigint, shop_id bigint, currency_id bigint,
           country_id bigint, group_id bigint, customer_id bigint""",
    )


@pytest.mark.parametrize(
    "overs, chosen",
    [
        ([{}, {"combination_id": 3}], 2),
        ([{"combination_id": 3}, {"shop_id": 1, "from_quantity": 5}], 1),
        ([{"from_quantity": 2}, {"from_quantity": 5}, {"from_quantity": 6}], 2),
        ([{"group_id": 1}, {"currency_id": 1, "country_id": 1}], 2),
        ([{"valid_from": "2026-01-01 00:00:00"}, {"valid_from": "2025-01-01 00:00:00"}], 1),
        ([{"valid_to": "2026-01-14 00:00:00"}, {"valid_from": "2026-01-16 00:00:00"}, {"valid_to": AS_OF}], 3),
        ([{"cart_id": 4}, {"combination_id": 9}, {"customer_id": 8}], None),
        ([{}, {}], 2),
        ([{"valid_from": "0000-00-00 00:00:00", "valid_to": "0000-00-00 00:00:00"}], 1),
        ([{"valid_from": "soon"}], None),
    ],
)
def test_rule_selection(spark, overs, chosen):
    got = P.select_price_rule(requests(spark), rules(spark, *overs), AS_OF).first()
    assert got.rule_id == chosen
    assert got.ambiguous_with == (1 if overs == [{}, {}] else None)
    assert got.invalid_dates == (1 if overs == [{"valid_from": "soon"}] else 0)


def test_many_requests_of_one_context(spark):
    got = P.select_price_rule(requests(spark, 500), rules(spark, {}, {"combination_id": 3}), AS_OF)
    assert got.count() == 500 and got.filter("rule_id <> 2").count() == 0


@pytest.mark.parametrize(
    "base, rule, final, warnings",
    [
        ("1000", None, 1190, []),
        ("1000", {}, 1071, []),
        ("1000", {"price": "500"}, 536, []),
        ("1000", {"reduction": "90.5", "reduction_type": "amount"}, 1099, []),
        ("10", {"reduction": "90", "reduction_type": "amount"}, 0, ["SPECIFIC_PRICE_EXCEEDS_BASE_PRICE"]),
        ("1000", {"reduction": "1.5"}, 1190, ["SPECIFIC_PRICE_INVALID_REDUCTION"]),
        ("1000", {"reduction": "-1"}, 1190, ["SPECIFIC_PRICE_INVALID_REDUCTION"]),
        ("1000", {"reduction_type": "gift"}, 1190, ["SPECIFIC_PRICE_UNSUPPORTED_REDUCTION_TYPE"]),
        ("-1", None, None, ["CATALOG_INVALID_BASE_PRICE", "CATALOG_PRICE_UNAVAILABLE"]),
        (None, None, None, ["CATALOG_INVALID_BASE_PRICE", "CATALOG_PRICE_UNAVAILABLE"]),
    ],
)
def test_catalogue_price(spark, base, rule, final, warnings):
    from decimal import Decimal

    over = {k: Decimal(v) if k in ("price", "reduction") else v for k, v in (rule or {}).items()}
    use = rules(spark, over) if rule is not None else rules(spark, {"cart_id": 1})
    df = requests(spark).withColumn("base_price_net", F.lit(base).cast("decimal(20,6)"))
    df = df.withColumn("impact_net", F.lit(0).cast("decimal(20,6)"))
    got = P.commercial_price(P.select_price_rule(df, use, AS_OF)).first()
    assert got.final_gross == final and got.price_warnings == warnings


def test_availability(spark):
    cases = [
        (False, True, 5.0, "inactive"), (None, True, 5.0, "unknown"), (True, None, 5.0, "unknown"),
        (True, False, 5.0, "unavailable_for_order"), (True, True, None, "unknown"), (True, True, 2.9, "available"),
        (True, True, 0.0, "out_of_stock"), (True, True, -2.5, "out_of_stock"),
    ]
    df = spark.createDataFrame(cases, "active boolean, available_for_order boolean, stock_quantity double, want string")
    got = P.availability(df).collect()
    assert all(r.status == r.want and r.purchasable == (r.want == "available") for r in got)
    assert [r.stock_quantity for r in got][-3:] == [2, 0, -2]


def test_rules_above_all_requests_are_dropped_before_the_join(spark):
    from wicker.sources import catalog as Cat

    overs = [{}, {"from_quantity": 6}, {"group_id": 2}, {"group_id": 1}, {"customer_id": 3}, {"shop_id": -1}, {"currency_id": None}, {"country_id": 4}, {"from_quantity": None}]
    named = rules(spark, *overs)
    named = named.select(*[F.col(c).alias(f"rule_{c}") for c in named.columns])
    left = named.filter(Cat._in_range(requests(spark)))
    assert sorted(r.rule_id for r in left.collect()) == [1, 4, 6]

    asked = requests(spark, 2).withColumn("group_id", F.when(F.col("request_id") == 0, -3).cast("bigint"))
    found = Cat.price_rules_scoped(asked, rules(spark, {"group_id": -3}, {"group_id": 1}, {}, {"group_id": None}))
    assert sorted((r.request_id, r.rule_id) for r in found.collect()) == [(0, 1), (0, 3), (1, 3)]
    none = asked.withColumn("group_id", F.lit(None).cast("bigint"))
    assert sorted((r.request_id, r.rule_id) for r in Cat.price_rules_scoped(none, rules(spark, {"group_id": 1}, {})).collect()) == [(0, 2), (1, 2)]
    assert Cat.price_rules_scoped(asked.limit(0), rules(spark, {})).count() == 0


def stored_frames(monkeypatch):
    """Names and frames given to the stages of prices, catalogue views and search from now on."""
    from wicker import session
    from wicker.plans import q_compose

    frames, store = {}, session.stage_table

    def note(df, name, **options):
        frames[name] = df
        return store(df, name, **options)

    for place in (P, session, q_compose):
        monkeypatch.setattr(place, "stage_table", note)
    return frames


def test_truth_reads_variants_once_and_contexts_from_the_references(spark, monkeypatch):
    from wicker.plans.q_catalog import truth

    frames = stored_frames(monkeypatch)
    found = truth(spark, "/root/testdata/sf0.001")
    assert [f for f in frames["contexts"].inputFiles() if "lineitem" in f] == []
    assert [f for f in found.inputFiles() if "lineitem" in f] == []
    assert "variants" in frames and found.count() > 0


def test_search_stores_what_it_reads_of_the_truth(spark, monkeypatch):
    from wicker.operators import compose as Z
    from wicker.plans import q_compose

    frames = stored_frames(monkeypatch)
    q_compose.search_inputs(spark, "/root/testdata/sf0.001")
    assert frames["truth"].columns == Z.FACTS and "description" not in Z.FACTS
